"""Search by words against brute force, and what it shuffles."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import lexical, ranking
from pageloom.plans import registry

#: The second folder has cases whose numbers are divisible by 50.
DATA, ASKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TEXTS = ["", "保A1险b 金", "a a B", "一x鿿y㐀", "𠀀保퟿险é", "Versicherungsnehmer " * 3 + "Versicherungsnehmex", "0" * 11 + " " + "0" * 10, "条款\0条款\n条 款", "x" * 5000, "保保保险"]


def numbers(texts):
    """Tokens of each text as numbers, with their frequencies."""
    p = ranking.postings(texts)
    out = [Counter() for _ in texts]
    for i, c in enumerate(p.codes):
        for j in range(p.starts[i], p.starts[i + 1]):
            out[p.row[j]][int(c)] = int(p.f[j])
    assert [sum(x.values()) for x in out] == list(p.lengths)
    return out


def test_numbers_stand_for_lexical_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", T.lexical_tokens(F.col("t")).alias("x")).collect()
    words = [Counter(r.x) for r in sorted(rows, key=lambda r: r.i)]
    got = numbers(TEXTS)
    assert [sorted(x.values()) for x in got] == [sorted(x.values()) for x in words]
    # equal tokens have equal numbers in other texts, different ones different numbers
    every = sorted({w for x in words for w in x})
    each = [next(iter(numbers([w])[0])) for w in every if len(w) == 1 or w.isascii()]
    assert len(set(each)) == len(each) and set(each) <= {c for x in got for c in x}


def brute(docs, bags, k):
    df = Counter(w for x in docs for w in x)
    n, mean = len(docs), sum(sum(x.values()) for x in docs) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    weight = {w: low if v < 0 else v for w, v in raw.items()}
    out = {}
    for i, b in enumerate(bags):
        s = {}
        for d, x in enumerate(docs):
            size = sum(x.values())
            s[d] = round(sum(t * weight[w] * x[w] * 2.5 / (x[w] + 1.5 * (0.25 + 0.75 * size / mean)) for w, t in b.items() if w in x), 6)
        out[i] = [(d, s[d]) for d in sorted(s, key=lambda d: (-s[d], d)) if s[d] > 0][:k]
    return out, weight, mean


@pytest.mark.parametrize("seed", range(6))
def test_chunks_keep_the_best(monkeypatch, seed):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.08)), 200)}"
    texts = [" ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(900)]
    texts += texts[:60]  # equal scores
    asked = [[" ".join(word() for _ in range(r.randrange(1, 9)))] for _ in range(40)] + [["none"], ["w0"], ["w0 w1 w1 w2"]]
    k = r.choice((1, 3, 20))
    want, weight, mean = brute([Counter(t.split()) for t in texts], [Counter(" ".join(x).split()) for x in asked], k)
    monkeypatch.setattr(ranking, "TOGETHER", 4000)
    monkeypatch.setattr(ranking, "CHUNK", 300)
    b = ranking.bags(asked, False)
    place = {int(ranking.postings([w]).codes[0]): v for w, v in weight.items()}
    weights = np.array([place.get(int(c), 0.0) for c in b.asked])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["page_id", "start", "text"])
    hits = defaultdict(list)
    sent = 0
    for x in ranking._searched(b, weights, mean, k, False)([batch]):
        sent += x.num_rows
        for h in x.to_pylist():
            hits[h["bag"]].append((h["page_id"], h["score"]))
    for i in range(len(asked)):
        got = sorted(hits[i], key=lambda h: (-h[1], h[0]))[:k]
        assert [d for d, _ in got] == [d for d, _ in want[i]] and np.allclose([s for _, s in got], [s for _, s in want[i]], atol=1e-6)
    assert sent <= k * len(asked) * 4  # at most k a question and chunk leave a task


def test_best_is_that_of_all_scores(spark):
    docs = [(1, "a b a c 保险金"), (2, "a d 保险"), (3, "d d e"), (4, ""), (5, "a a a a"), (6, "d d e"), (None, "c 险金")]
    d = spark.createDataFrame(docs, "page_id bigint, text string").withColumn("start", F.lit(0))
    q = spark.createDataFrame([(7, "a c c zz"), (8, "d"), (9, "保险"), (9, "金"), (10, ""), (11, None), (12, "d")], "query_id bigint, question string")
    got = {(r.query_id, r.page_id, r.score, r["rank"]) for r in ranking.best(d, q, 2).collect()}
    tok = d.select(F.col("page_id").alias("doc_id"), T.lexical_tokens(F.col("text")).alias("tokens"))
    # the rows of one query_id are one bag
    qs = q.select("query_id", F.explode(T.lexical_tokens(F.col("question"))).alias("t")).groupBy("query_id").agg(F.collect_list("t").alias("tokens"))
    assert got == {(r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.top_k(lexical.scores(tok, qs), 2).collect()} and len(got) > 6
    same = {(r.query_id, r.page_id, r.score, r["rank"]) for r in ranking.best(d, q, 2, binary=True).collect()}
    assert same == {(r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.top_k(lexical.overlap(tok, qs), 2).collect()}


def shuffles_no_pairs(df):
    """Whether no row of each question and document is grouped or shuffled: only a task's best are."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow" in plan and not [x for x in plan.split("\n") if "Aggregate [query_id" in x and ("doc_id" in x.split("]")[0] or "page_id" in x.split("]")[0]) and "rank" not in x]


@tables
@pytest.mark.parametrize("name", ["bm25_topk", "overlap_fallback", "rerank_topk", "coverage_at_k", "coverage_by_stratum", "token_budget_fold", "hard_negative_confusion", "irrelevant_context", "strategy_cases", "strategy_guardrails", "strategy_choice"])
def test_searches_shuffle_the_best_only(spark, name):
    assert shuffles_no_pairs(registry.QUERIES[name](spark, ASKED))


@tables
@pytest.mark.parametrize("name", ["bm25_topk", "coverage_at_k"])
def test_all_cases_are_asked(spark, name):
    of = "silver_case" if name == "bm25_topk" else "evidence_span"
    cases = spark.read.parquet(f"{DATA}/{of}.parquet").where("span_kind = 'evidence'" if of == "evidence_span" else "true").select(F.regexp_extract("case_id", "([0-9]+)$", 1).cast("bigint")).distinct().count()
    assert registry.QUERIES[name](spark, DATA).select("query_id").distinct().count() == cases > 1
    assert "% 50" not in registry.SQL[name]
