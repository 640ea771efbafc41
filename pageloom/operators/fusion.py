"""Reciprocal rank fusion of the hits of several queries and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the usual constant of reciprocal rank fusion.
RRF = 60


def fuse(hits: DataFrame, k: int = RRF) -> DataFrame:
    """Of hits (query_id, q_idx, method, method_order, doc_id, rank, score): one row a query and document.

    Sums 1 / (k + rank) over query expansions and methods, keeps the best score
    of each method, and numbers by sum; ties go to what was seen first (by
    expansion, method, rank).
    """
    seen = F.min(F.struct("q_idx", "method_order", "rank"))
    best = lambda m: F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"{m}_score")
    f = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("final_score"), best("vector"), best("lexical"), F.count("*").alias("n_details"), seen.alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "seen", "doc_id")
    return f.withColumn("rank", F.row_number().over(order)).drop("seen")


def strength(score):
    """Bucket of a fused score."""
    return F.when(score >= 0.03, "high").when(score >= 0.015, "medium").otherwise("low")
