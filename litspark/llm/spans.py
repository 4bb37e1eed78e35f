"""Byte spans as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start: bigint, end: bigint>>"


def union(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        apart = (F.size(done) == 0) | (last["end"] < s["start"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(grown)

    empty = F.array().cast(_SPANS)
    return F.aggregate(spans, empty, add)


def kept_bytes(text: Column, spans: Column) -> Column:
    """What is left of a text, as binary: single bytes of a character may be gone."""
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    whole = spans.isNull()
    n = F.octet_length(body)
    spans = F.coalesce(spans, F.array().cast(_SPANS))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(n.cast("bigint")))
    cut = lambda a, b: F.substring(body, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    return F.when(whole, body).otherwise(F.array_join(F.zip_with(starts, ends, cut), "").cast("binary"))
