"""Text extraction from document files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.operators.skew import lookup_join

# An extractor takes a file's bytes and returns its pages' texts.
Extractor = Callable[[bytes], list[str]]


def _extract(extract: Callable, item: bytes | str) -> tuple[str | None, str, str | None]:
    try:
        text = "\n".join(page or "" for page in extract(item))
    except Exception as error:  # a broken file is a row of its own, the rest goes on
        return None, "error", str(error)
    return (text, "extracted", None) if text.strip() else (None, "skipped", None)


def load_path(path: str) -> bytes:
    """A file's bytes from any storage Arrow knows (``file:``, ``hdfs:``, ``s3:`` ...)."""
    uri = path if "://" in path else re.sub("^file:/*", "/", path)
    storage, name = fs.FileSystem.from_uri(uri)
    with storage.open_input_file(name) as stream:
        return stream.read()


def extract_text(
    files: DataFrame,
    extractor: Extractor,
    plan: DataFrame | None = None,
    load: Callable[[str], bytes] | None = None,
) -> DataFrame:
    """Text and outcome per file.

    ``files`` has ``file_name`` and ``content``. With ``load`` it has ``file_name`` and ``path``
    instead, and tasks read the bytes themselves: then a plan is applied to names alone, and
    contents are neither read for existing files nor moved between executors.

    With a ``plan`` (see ``extract_plan``) files already extracted are reported as existing.
    """
    source = "content" if load is None else "path"
    columns = "file_name string, text string, outcome string, error string"

    def extract(item: bytes | str) -> list[str]:
        return extractor(bytes(item) if load is None else load(item))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_extract(extract, item) for item in batch[source]]
            out = pd.DataFrame(found, columns=["text", "outcome", "error"])
            out.insert(0, "file_name", batch["file_name"].to_numpy())
            yield out

    if plan is None:
        return files.select("file_name", source).mapInPandas(run, columns)
    existing = plan.where("outcome = 'existing'").select("file_name").distinct()
    done = lookup_join(files.select("file_name"), existing, "file_name", "left_semi").select(
        "file_name",
        F.lit(None).cast("string").alias("text"),
        F.lit("existing").alias("outcome"),
        F.lit(None).cast("string").alias("error"),
    )
    todo = lookup_join(files.select("file_name", source), existing, "file_name", "left_anti")
    return todo.mapInPandas(run, columns).unionByName(done)
