"""Offsets under whitespace normalisation, and windows of pages for a limited context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters a window holds; pages of a block, within which windows are packed.
LIMIT, BLOCK = 3000, 256


def normalized_offset(text: Column, at: Column) -> Column:
    """Where the character at `at` (from 0, not whitespace) stands once whitespace is collapsed."""
    prefix = F.substring(text, F.lit(1), at)
    return F.length(F.regexp_replace(F.regexp_replace(prefix, f"^[{T.SPACE}]+", ""), f"[{T.SPACE}]+", " "))


def normalized_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a span once whitespace is collapsed; null for a span of whitespace only."""
    quote = F.substring(text, start + 1, end - start)
    lead = F.length(quote) - F.length(F.regexp_replace(quote, f"^[{T.SPACE}]+", ""))
    tail = F.length(quote) - F.length(F.regexp_replace(quote, f"[{T.SPACE}]+$", ""))
    first, last = start + lead, end - tail - 1
    return F.when(T.compact(quote) != "", F.struct(normalized_offset(text, first).alias("start"), (normalized_offset(text, last) + 1).alias("end")))


def page_windows(sizes: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(source_id, page_number, window) of pages (source_id, page_number, size): filled greedily in page order up to `limit`.

    A page above the limit has a window of its own. Windows are numbered within
    blocks of `block` page numbers, so that no source is folded as a whole.
    """
    b = F.floor(F.col("page_number") / block).cast("int")
    g = sizes.groupBy("source_id", b.alias("block")).agg(F.array_sort(F.collect_list(F.struct("page_number", F.col("size").cast("bigint").alias("size")))).alias("p"))
    zero = F.struct(F.lit(0).alias("window"), F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<struct<page_number:int,window:int>>)").alias("out"))

    def add(s, x):
        fits = (s["used"] == 0) | (s["used"] + x["size"] <= limit)
        w = F.when(fits, s["window"]).otherwise(s["window"] + 1)
        return F.struct(w.alias("window"), F.when(fits, s["used"] + x["size"]).otherwise(x["size"]).alias("used"), F.array_append(s["out"], F.struct(x["page_number"].alias("page_number"), w.alias("window"))).alias("out"))

    x = g.select("source_id", "block", F.explode(F.aggregate("p", zero, add, lambda s: s["out"])).alias("o"))
    return x.select("source_id", F.col("o.page_number").alias("page_number"), F.concat_ws(":", "block", "o.window").alias("window"))
