"""Evaluation over isolated corpora: every case or document is a corpus of its own, and all are searched at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import RRF
from .lexical import B, EPSILON, K1


def lexical_hits(units: DataFrame, questions: DataFrame, terms: list[str] = ()) -> DataFrame:
    """(case_id, q_idx, unit_id, seq, score, rank) of units (case_id, unit_id, seq, text) for questions (case_id, q_idx, question).

    Statistics are counted within each case. Where no score of a question is
    positive, units are ranked by the distinct tokens in common instead.
    """
    u = units.select("case_id", "unit_id", "seq", T.lexical_tokens(F.coalesce("text", F.lit("")), list(terms)).alias("tokens"))
    total = u.groupBy("case_id").agg(F.count("*").alias("n_units"), F.avg(F.size("tokens")).alias("mean"))
    df = u.select("case_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("case_id", "token").agg(F.count("*").alias("n")).join(total, "case_id")
    raw = F.log(F.col("n_units") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    idf = df.withColumn("raw", raw).withColumn("mean_raw", F.avg(raw).over(Window.partitionBy("case_id")))
    idf = idf.select("case_id", "token", "mean", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")).alias("w"))
    q = questions.select("case_id", "q_idx", F.explode(T.lexical_tokens(F.coalesce("question", F.lit("")), list(terms))).alias("token")).groupBy("case_id", "q_idx", "token").agg(F.count("*").alias("times"))
    tf = u.select("case_id", "unit_id", "seq", F.size("tokens").alias("len"), F.explode("tokens").alias("token")).groupBy("case_id", "unit_id", "seq", "token").agg(F.count("*").alias("f"), F.first("len").alias("len"))
    part = F.col("times") * F.col("w") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    s = tf.join(q, ["case_id", "token"]).join(idf, ["case_id", "token"]).groupBy("case_id", "q_idx", "unit_id", "seq").agg(F.round(F.sum(part), 9).alias("bm25"), F.count("*").cast("double").alias("shared"))
    best = F.max("bm25").over(Window.partitionBy("case_id", "q_idx"))
    s = s.withColumn("best", best).withColumn("score", F.when(F.col("best") > 0, F.col("bm25")).otherwise(F.col("shared"))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("case_id", "q_idx").orderBy(F.desc("score"), "seq"))
    return s.select("case_id", "q_idx", "unit_id", "seq", "score", rank.alias("rank"))


def vector_hits(units: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The same for vectors: the best k of each question within its case; zero questions give none; ties go to the later unit."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    j = questions.select("case_id", "q_idx", F.col("vector").alias("qv")).join(units.select("case_id", "unit_id", "seq", F.col("vector").alias("uv")), "case_id")
    j = j.withColumn("qn", norm(F.col("qv"))).withColumn("un", norm(F.col("uv"))).where("qn > 0")
    dot = F.aggregate(F.zip_with("qv", "uv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    j = j.withColumn("score", F.round(F.when(F.col("un") > 0, dot / (F.col("qn") * F.col("un"))).otherwise(0.0), 9))
    rank = F.row_number().over(Window.partitionBy("case_id", "q_idx").orderBy(F.desc("score"), F.desc("seq")))
    return j.withColumn("rank", rank).where(F.col("rank") <= k).select("case_id", "q_idx", "unit_id", "seq", "score", "rank")


def fused_hits(vector: DataFrame | None, lexical: DataFrame, k: int) -> DataFrame:
    """(case_id, unit_id, final_score, rank) of both kinds of hits over all expansions; ties go to what was seen first."""
    parts = lexical.withColumn("m", F.lit(1))
    if vector is not None:
        parts = vector.withColumn("m", F.lit(0)).unionByName(parts)
    f = parts.groupBy("case_id", "unit_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 12).alias("final_score"), F.min(F.struct("q_idx", "m", "rank")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("final_score"), "seen"))
    return f.withColumn("rank", rank).where(F.col("rank") <= k).drop("seen")


def judged(hits: DataFrame, units: DataFrame, cases: DataFrame, depth: int = 3) -> DataFrame:
    """(case_id, expected_rank, passed): the first hit whose title is expected, or holds one of the expected terms; it must be the first."""
    j = cases.select("case_id", "expected_section", "expected_terms").join(hits.join(units.select("case_id", "unit_id", "section_title"), ["case_id", "unit_id"]), "case_id", "left")
    term = F.exists(F.coalesce("expected_terms", F.expr("cast(array() as array<string>)")), lambda t: F.contains(F.col("section_title"), t))
    match = (F.col("section_title") == F.col("expected_section")) | term
    r = j.groupBy("case_id").agg(F.min(F.when(F.coalesce(match, F.lit(False)) & (F.col("rank") <= depth), F.col("rank"))).alias("expected_rank"))
    return r.select("case_id", "expected_rank", F.coalesce(F.col("expected_rank") <= 1, F.lit(False)).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, passes, and those with the expected unit first and among the first three."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.coalesce(F.col("expected_rank") <= 1, F.lit(False))).alias("top1"), F.count_if(F.coalesce(F.col("expected_rank") <= 3, F.lit(False))).alias("top3"))


def one_strategy(units: DataFrame, expected: str) -> DataFrame:
    """One row (units, strategies, compatible): whether all units come from the one strategy that the index was made with."""
    n = units.agg(F.count("*").alias("units"), F.count_distinct(F.coalesce("strategy", F.lit(""))).alias("strategies"), F.count_if(F.coalesce("strategy", F.lit("")) == expected).alias("same"))
    return n.select("units", "strategies", (F.col("same") == F.col("units")).alias("compatible"))
