"""Search over records: keywords, years, open access, limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions.text import as_col

NOT_WORD = r"[^\p{L}\p{N}]+"


def searchable(*columns: Column | str) -> Column:
    """Lower-cased words of the columns with one space around each."""
    joined = F.concat_ws(" ", *[as_col(c) for c in columns])
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(joined), NOT_WORD, " "), F.lit(" "))


def _tokens(query: str) -> list[tuple[str, str, int]]:
    """(kind, words, place) of each part of a query; a term without words is left out.

    Kinds are ``term``, ``AND``, ``OR``, ``NOT``, ``(`` and ``)``. Marks in a quoted phrase or in the
    middle of a word belong to it.
    """
    out: list[tuple[str, str, int]] = []
    at = 0

    def term(text: str, place: int) -> None:
        words = " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())
        if words:
            out.append(("term", words, place))
        elif out and out[-1][0] == "NOT":
            out.pop()

    while at < len(query):
        mark, place = query[at], at
        at += 1
        if mark.isspace():
            continue
        if mark == '"':
            end = query.find('"', at)
            if end < 0:
                raise ValueError(f"quote at {place} of the query is not closed")
            term(query[at:end], place)
            at = end + 1
        elif mark in "()":
            out.append((mark, "", place))
        elif mark in "+|":
            out.append(("AND" if mark == "+" else "OR", "", place))
        elif mark == "-" and at < len(query) and not query[at].isspace() and query[at] != ")":
            out.append(("NOT", "", place))
        else:
            while at < len(query) and not query[at].isspace() and query[at] not in '()+|"':
                at += 1
            word = query[place:at]
            if word in ("AND", "OR", "NOT"):
                out.append((word, "", place))
            else:
                term(word, place)
    return out


def query_condition(query: str, text: Column) -> Column:
    """A query as a condition on ``text`` (from :func:`searchable`)."""
    return read_query(query, lambda words: F.contains(text, F.lit(f" {words} ")))


def query_terms(query: str) -> list[str]:
    """Terms and phrases of a query, each as words with one space between."""
    return list(dict.fromkeys(words for kind, words, _ in _tokens(query) if kind == "term"))


def read_query(query: str, leaf: Callable):
    """A query over what ``leaf`` gives for a term or phrase, put together by ``&``, ``|`` and ``~``.

    NOT binds closest, then AND, then OR; terms side by side must both be there. Raises a
    ``ValueError`` that names the place where a query can't be read.
    """
    tokens = _tokens(query)
    if not tokens:
        raise ValueError(f"the query {query!r} has no words")
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else "end"

    def fail() -> ValueError:
        where = f"at {tokens[at][2]} of" if at < len(tokens) else "at the end of"
        return ValueError(f"a term is missing {where} the query {query!r}")

    def either():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            left = left | both()
        return left

    def both():
        nonlocal at
        left = one()
        while peek() in ("AND", "NOT", "term", "("):
            at += peek() == "AND"
            left = left & one()
        return left

    def one():
        nonlocal at
        kind = peek()
        if kind == "NOT":
            at += 1
            return ~one()
        if kind == "(":
            opened = tokens[at][2]
            at += 1
            inner = either()
            if peek() != ")":
                raise ValueError(f"the bracket at {opened} of the query {query!r} is not closed")
            at += 1
            return inner
        if kind != "term":
            raise fail()
        at += 1
        return leaf(tokens[at - 1][1])

    condition = either()
    if at < len(tokens):
        raise fail()
    return condition


def keyword_filter(
    df: DataFrame, query: str, columns: tuple[str, ...] = ("title", "abstract")
) -> DataFrame:
    """Rows whose title and abstract match a query with AND, OR, NOT, phrases and groups.

    The searchable text is built once per row: ``exists`` over a one-element array keeps the
    optimizer from copying it into every term.
    """
    return df.where(F.exists(F.array(searchable(*columns)), lambda t: query_condition(query, t)))


def year_filter(df: DataFrame, year: str | None, only_open_access: bool = False) -> DataFrame:
    """Years as ``2020-2025`` or ``2023``, and open access only where asked for.

    The bounds are plain numbers in the plan, so that they reach a Parquet scan.
    """
    first, _, last = (year or "").partition("-")
    if first.strip():
        low = int(first)
        high = int(last.split("-")[0]) if last.split("-")[0].strip() else low
        df = df.where(F.col("year").between(low, high))
    if only_open_access:
        df = df.where(F.col("isOpenAccess"))
    return df


def limited(
    df: DataFrame, order: list[str | Column], limit: int | None = None, cap: int | None = None
) -> DataFrame:
    """The first rows in order: as many as the tighter of limit and cap allows, all without either."""
    given = [n for n in (limit, cap) if n is not None]
    return df.orderBy(*order).limit(min(given)) if given else df.orderBy(*order)


def truncated(page_meta: DataFrame, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """One row: whether the cap, not the caller's limit, cut the results (``count`` per page)."""
    if cap is None or (limit is not None and limit < cap):
        return page_meta.sparkSession.range(1).select(F.lit(False).alias("truncated"))
    return page_meta.agg(F.coalesce(F.max("count") > cap, F.lit(False)).alias("truncated"))


def matches(
    df: DataFrame, query: str | None = None, year: str | None = None, only_open_access: bool = False
) -> DataFrame:
    """All rows of a search: cheap conditions first, then keywords."""
    rows = year_filter(df, year, only_open_access)
    return keyword_filter(rows, query) if query else rows


def search_corpus(
    df: DataFrame,
    query: str | None = None,
    year: str | None = None,
    only_open_access: bool = False,
    limit: int | None = None,
    order: tuple[str, ...] = ("ord",),
) -> DataFrame:
    """A search over stored records; every match unless the caller sets a limit."""
    return limited(matches(df, query, year, only_open_access), list(order), limit)


def capped_search(
    df: DataFrame,
    cap: int,
    query: str | None = None,
    year: str | None = None,
    only_open_access: bool = False,
    limit: int | None = None,
    order: tuple[str, ...] = ("ord",),
) -> tuple[DataFrame, DataFrame]:
    """A search under an engine's quota: its rows, and one row telling whether the quota cut them.

    The matches are counted at once. A limit passes all rows through one task, so it is set only
    where there are more matches than it allows.
    """
    found = matches(df, query, year, only_open_access)
    n = found.count()
    total = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("count"))
    if n <= min(x for x in (limit, cap) if x is not None):
        return limited(found, list(order)), truncated(total, limit, cap)
    return limited(found, list(order), limit, cap), truncated(total, limit, cap)
