"""Lexical search over tokens (Okapi weights) and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The published defaults, and the share of the mean weight that replaces negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of (query, token) that may be sent to every worker; beyond, postings are joined by shuffle.
SENT_TOKENS = 200_000


def corpus_stats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, tokens): (token, n) document frequencies, counted before the shuffle; and one row (n_docs, mean_length).

    Both come from one pass over the tokens, whose exchange all uses share: each
    document has a row without a token, which brings its length.
    """
    none = F.array(F.lit(None).cast("string"))
    # explode_outer: for explode the planner adds a filter on the array's size, which makes the tokens twice
    each = docs.select(F.size("tokens").alias("length"), F.explode_outer(F.concat(none, F.array_distinct("tokens"))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.when(F.col("token").isNull(), F.col("length"))).alias("lengths"))
    # told apart by an aggregate, so that the filters stay above the exchange
    df, totals = counts.where("lengths is null").select("token", "n"), counts.where("lengths is not null")
    return df, totals.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_docs"), (F.max("lengths") / F.max("n")).alias("mean_length"))


def weights(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(token, weight): inverse document frequencies; negative ones become EPSILON times the mean over the vocabulary."""
    raw = F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    each = df.join(F.broadcast(totals.select("n_docs"))).select("token", raw.alias("raw"))  # one row
    mean = each.agg(F.avg("raw").alias("mean"))
    return each.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("weight"))


def scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) > 0 for queries (query_id, tokens), counting repeated query tokens.

    Only postings of query tokens are made: the token rows of a document are
    filtered by the queries' tokens before anything is shuffled.
    """
    q = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    # frequent tokens have postings in most documents: small sides are sent, so that no task gets all of a token
    few = q.count() <= SENT_TOKENS
    sent = F.broadcast if few else (lambda df: df)
    asked = sent(q.select("token").distinct())
    df, totals = corpus_stats(docs)
    posting = (
        docs.select("doc_id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("token"))
        .join(asked, "token", "left_semi")
        .groupBy("doc_id", "token").agg(F.count("*").alias("f"), F.first("length").alias("length"))
    )
    w = sent(weights(df, totals).join(asked, "token", "left_semi"))
    score = F.col("times") * F.col("weight") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    hit = posting.join(w, "token").join(F.broadcast(totals.select("mean_length"))).join(sent(q), "token")
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score")).where("score > 0")


def overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): distinct tokens in common, the fallback where no lexical score is positive."""
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    sent = F.broadcast if q.count() <= SENT_TOKENS else (lambda df: df)
    asked = sent(q.select("token").distinct())
    d = docs.select("doc_id", F.explode_outer(F.array_distinct("tokens")).alias("token")).join(asked, "token", "left_semi")
    return d.join(sent(q), "token").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def top_k(hits: DataFrame, k: int, *, by: str = "score", tie="doc_id", key: str = "query_id") -> DataFrame:
    """The k best rows a query with their rank from 1."""
    order = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
