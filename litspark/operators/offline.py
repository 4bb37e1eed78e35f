"""Clients and extractors that need no network: for tests, dry runs and benchmarks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from litspark.operators.inference import Client

def connect_offline() -> Client:
    """A client that answers with the prompt's length and fails on one prompt in sixteen.

    Which ones depends on the prompt's digest alone, so a run can be repeated.
    """

    def complete(request: dict) -> dict:
        size = len(request["prompt"])
        if hashlib.md5(request["prompt"].encode()).hexdigest()[0] == "0":
            raise ValueError("refused")
        return {
            "text": f"{request['model']} read {size} characters",
            "tokens": size // 4,
            "raw": {"size": size, "params": request["params"]},
        }

    return complete


class TaskLost(BaseException):
    """Ends a task as a lost executor does: it is no error of a call."""


def connect_dying(after: int) -> Callable[[], Client]:
    """Clients like the offline one that take their task with them after so many calls."""

    def connect() -> Client:
        answer, left = connect_offline(), after

        def complete(request: dict) -> dict:
            nonlocal left
            if not left:
                raise TaskLost
            left -= 1
            return answer(request)

        return complete

    return connect


_TAG = re.compile(r"<[^>]*>")


def html_pages(content: bytes) -> list[str]:
    """Text of an HTML document without its tags; bytes that are not UTF-8 raise."""
    return [_TAG.sub(" ", content.decode("utf-8"))]
