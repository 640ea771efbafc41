"""Fused rankings against full ones, and searches within sources."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import evaluate, fused, fusion, lexical, vector
from pageloom.plans import registry, selection

DATA, ASKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(ASKED), reason="no test tables")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def made(spark, n, seed=0):
    """Pages, and asks of two or three rankings, of few enough words that most are long."""
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.15)), 60)}"
    docs = spark.createDataFrame([(i, 0, " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(n)], "page_id bigint, start int, text string")
    asks = spark.createDataFrame([(a, i, [" ".join(word() for _ in range(3))]) for a in range(8) for i in range(2 + a % 2)], "ask bigint, q_idx int, texts array<string>")
    return docs, asks


def test_fused_without_the_full_rankings(spark):
    docs, asks = made(spark, 900)
    near = asks.where("ask < 4").select("ask", "q_idx", (F.col("ask") * 7 + F.col("q_idx")).alias("page_id"), F.lit(0).alias("start"), F.lit(1).alias("rank"))
    q = asks.select(F.struct("ask", "q_idx").alias("query_id"), T.lexical_tokens(F.element_at("texts", 1)).alias("tokens"))
    full = lexical.scores(docs.select(F.col("page_id").alias("doc_id"), T.lexical_tokens(F.col("text")).alias("tokens")), q)
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    assert full.agg(F.max("rank")).first()[0] > (fusion.RRF + 1) * 3  # longer than the tops
    hits = full.select(F.col("query_id.ask").alias("query_id"), "query_id.q_idx", F.lit("lexical").alias("method"), F.lit(1).alias("method_order"), "doc_id", "rank", "score")
    hits = hits.unionByName(near.select(F.col("ask").alias("query_id"), "q_idx", F.lit("vector").alias("method"), F.lit(0).alias("method_order"), F.col("page_id").alias("doc_id"), "rank", F.lit(1.0).alias("score")))
    want = rows(fusion.fuse(hits).where("rank <= 1"), "query_id", "doc_id", "final_score", "n_details", "rank")
    assert rows(fused.best(docs, asks, 1, near), "ask", "page_id", "final_score", "n_details", "rank") == want


def test_a_corpus_of_one_task(spark):
    docs, asks = made(spark, 200, 1)
    units = docs.select(F.lit(0).alias("one"), F.col("page_id").alias("unit_id"), F.col("page_id").alias("seq"), "text").join(asks.select(F.col("ask").alias("case_id")).distinct())
    q = asks.select(F.col("ask").alias("case_id"), "q_idx", F.element_at("texts", 1).alias("question"))
    want = rows(evaluate.fused_hits(None, evaluate.lexical_hits(units, q), 3), "case_id", "rank", "unit_id")
    texts = [r.text for r in docs.orderBy("page_id").collect()]
    of = {}
    for r in asks.orderBy("ask", "q_idx").collect():
        of.setdefault(r.ask, []).append(tuple(r.texts))
    got = fused.alone(texts, fused.np.arange(len(texts)), list(of.values()), 3)
    assert sorted((a, n, i) for a, x in zip(of, got) for n, i in enumerate(x, 1)) == want
    # nothing positive: a single unit, by tokens in common; and texts without any token
    assert fused.alone(["a b"], fused.np.arange(1), [[("a",)], [("z",)], []], 3) == [[0], [], []]
    assert fused.alone(["", ""], fused.np.arange(2), [[("a",)]], 3) == [[]]


def test_nearest_vectors(spark, monkeypatch):
    q = spark.createDataFrame([(i, f"q{i % 5}") for i in range(7)], "query_id bigint, t string").select("query_id", T.hash_vector(F.col("t")).alias("vector"))
    u = spark.range(500).select(F.col("id").alias("unit_id"), T.hash_vector(F.concat(F.lit("u"), (F.col("id") % 400).cast("string"))).alias("vector"))
    assert rows(vector.nearest(q, u, 4), "query_id", "rank", "unit_id", "score") == rows(vector.cosine_topk(q, u, 4), "query_id", "rank", "unit_id", "score")


@tables
def test_all_cases_are_searched_in_their_sources(spark, monkeypatch):
    found = rows(registry.QUERIES["source_evaluation"](spark, ASKED), "case_id", "expected_rank", "passed")
    cases = spark.read.parquet(f"{ASKED}/evidence_span.parquet").where("span_kind = 'evidence'").select("case_id").distinct().count()
    assert len(found) == cases > 100
    # the largest source as a corpus of its own
    monkeypatch.setattr(selection.fused, "ALONE", 100)
    assert rows(registry.QUERIES["source_evaluation"](spark, ASKED), "case_id", "expected_rank", "passed") == found


@tables
@pytest.mark.parametrize("name", ["source_evaluation", "source_evaluation_summary", "rrf_fusion"])
def test_full_rankings_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, ASKED)._jdf.queryExecution().optimizedPlan().toString()
    # no row of each question and word, or page with a word in common
    assert "InArrow" in plan and "token#" not in plan
