"""Evidence spans: exact location, coverage by retrieved units, irrelevant context, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exact(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans (span_id, source_id, page_number, start_char, end_char, quote) with `exact`: whether the page holds the quote at its offsets."""
    j = spans.join(pages, ["source_id", "page_number"], "left")
    here = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return j.select("span_id", F.coalesce((F.col("start_char") >= 0) & (F.col("end_char") <= F.length("text")) & (here == F.col("quote")), F.lit(False)).alias("exact"))


def located(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Where a quote stands in its whitespace-collapsed page, if it stands there exactly once (occurrences don't overlap)."""
    q, t = T.collapsed(F.col("quote")), T.collapsed(F.coalesce("text", F.lit("")))
    j = spans.join(pages, ["source_id", "page_number"], "left").withColumn("q", q).withColumn("t", t)
    times = F.when(F.length("q") > 0, (F.length("t") - F.length(F.replace("t", F.col("q"), F.lit("")))) / F.length("q")).otherwise(0).cast("int")
    return j.select("span_id", times.alias("times"), F.when(times == 1, F.instr("t", F.col("q")) - 1).alias("start"))


def coverage(evidence: DataFrame, retrieved: DataFrame, cuts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query_id, cov_k.., irrelevant, retrieved_chars) of evidence (query_id, span_id, page_id, start_char, end_char) and retrieved units (query_id, page_id, start, end, rank).

    A span is covered by a single unit on its page that contains it; a query is
    covered if all its spans are. Irrelevant characters are those of units
    outside the spans of their page.
    """
    inside = (F.col("start") <= F.col("start_char")) & (F.col("end") >= F.col("end_char"))
    first = evidence.join(retrieved, ["query_id", "page_id"], "left").groupBy("query_id", "span_id").agg(F.min(F.when(inside, F.col("rank"))).alias("first"))
    covered = first.groupBy("query_id").agg(*[F.min(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"cov_{k}") for k in cuts])
    cut = F.greatest(F.lit(0), F.least("end", "end_char") - F.greatest("start", "start_char"))
    part = retrieved.join(evidence.select("query_id", "page_id", "start_char", "end_char"), ["query_id", "page_id"], "left")
    unit = part.groupBy("query_id", "rank").agg(F.first(F.col("end") - F.col("start")).alias("size"), F.sum(F.coalesce(cut, F.lit(0))).alias("hit"))
    waste = unit.groupBy("query_id").agg(F.sum(F.greatest(F.lit(0), F.col("size") - F.col("hit"))).alias("irrelevant"), F.sum("size").alias("retrieved_chars"))
    return covered.join(waste, "query_id", "left").fillna(0, ["irrelevant", "retrieved_chars"])


def within_budget(items: Column, budget: int) -> Column:
    """Of an ordered array of structs (rank, size): the ranks kept, skipping what doesn't fit and going on."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<int>)").alias("kept"))
    fits = lambda s, x: s["used"] + x["size"] <= budget
    return F.aggregate(
        items, zero,
        lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["size"]).alias("used"), F.array_append(s["kept"], x["rank"]).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at the half-even rounded index of the sorted array; null if it's empty."""
    return F.get(F.sort_array(values), F.bround((F.size(values) - 1) * percent / 100).cast("int"))
