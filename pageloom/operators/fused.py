"""Exact fusion of full rankings by words, without the full rankings.

A document's part from a ranking is 1 / (RRF + rank), so one that isn't near
the top of any ranking can't be among the best. Of each ranking the top is
found as in `ranking`; the few documents that could still be among the best
get their exact place in the other rankings by counting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .fusion import RRF
from .lexical import B, EPSILON, K1

#: Pages of a corpus that are ranked in one task at most.
ALONE = 5_000
#: What rounding of a fused score may change at most.
SLACK = 1e-8


def _placed(asked, weights, mean, places, wanted: list[np.ndarray], pages: np.ndarray, starts: np.ndarray):
    """From batches to (bag, page_id, start, score) of the documents wanted of each bag, places in `pages` and `starts`."""
    where = {(p, s): i for i, (p, s) in enumerate(zip(pages.tolist(), starts.tolist()))}
    bags_of = {}
    for b, docs in enumerate(wanted):
        for d in docs.tolist():
            bags_of.setdefault(d, []).append(b)

    def run(batches):
        for chunk, (page, start, _, _) in ranking._chunks(batches, asked, weights, mean, False, places):
            here = {}
            for i, at in enumerate(zip(page.tolist(), start.tolist())):
                for b in bags_of.get(where.get(at), ()):
                    here.setdefault(b, []).append(i)
            for b, at in here.items():
                t = slice(asked.starts[b], asked.starts[b + 1])
                score = chunk.scores(asked.token[t].tolist(), asked.times[t].tolist())[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b), pa.int32()), pa.array(page[at]), pa.array(start[at], pa.int64()), pa.array(score)], ["bag", "page_id", "start", "score"])

    return run


def _counted(asked, weights, mean, places, marks: dict[int, tuple]):
    """From batches to (bag, page_id, start, better): documents before each of a bag's marks (scores, pages, starts)."""

    def run(batches):
        better = {b: np.zeros(len(m[0]), np.int64) for b, m in marks.items()}
        for chunk, (page, start, _, _) in ranking._chunks(batches, asked, weights, mean, False, places):
            for b, (score, p, s) in marks.items():
                t = slice(asked.starts[b], asked.starts[b + 1])
                x = chunk.scores(asked.token[t].tolist(), asked.times[t].tolist())
                sort = np.sort(x)
                better[b] += len(x) - np.searchsorted(sort, score, "right")
                for i in np.flatnonzero(np.searchsorted(sort, score, "right") > np.searchsorted(sort, score, "left")):
                    tied = x == score[i]
                    better[b][i] += np.count_nonzero(tied & ((page < p[i]) | (page == p[i]) & (start < s[i])))
        for b, n in better.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b), pa.int32()), pa.array(marks[b][1]), pa.array(marks[b][2], pa.int64()), pa.array(n)], ["bag", "page_id", "start", "better"])

    return run


def best(docs: DataFrame, asks: DataFrame, k: int, near: DataFrame | None = None, places: int = ranking.PLACES) -> DataFrame | None:
    """(ask, page_id, start, final_score, n_details, rank) of the k best documents of every ask by the sum of 1 / (RRF + rank) over its rankings.

    `docs` are (page_id, start, text) without a null page_id, `asks` (ask, q_idx, texts), each a ranking of all documents that score above 0 for the bag of
    words `texts`; ties by page_id, start. `near` (ask, q_idx, page_id, start, rank) are the hits of further, shorter rankings. Fused ties go to what was seen
    first (by q_idx, `near` first, rank). None if a weight is negative, for which the search isn't made.
    """
    spark = docs.sparkSession
    d = docs.select("page_id", "start", "text")
    # an ask's rankings are few; k documents have at least 1 / (RRF + k) each if any ranking is that long, so one that is beyond `top` in all of n rankings has less
    asks = asks.persist()
    n = asks.groupBy("ask").agg(F.count("*").alias("n"))
    lists = sorted((tuple(r.texts), r.n) for r in asks.join(n, "ask").groupBy("texts").agg(F.max("n").alias("n")).collect())
    top = np.array([(RRF + k) * n for _, n in lists], np.int64)
    asked = ranking.bags([list(t) for t, _ in lists], False)
    known = ranking.statistics(d, asked.asked)
    if not len(lists) or known.weights.min(initial=0) < 0:
        asks.unpersist()
        return None
    mean = known.tokens / max(1, known.n_docs) or 1.0
    named = spark.createDataFrame(pa.table({"bag": pa.array(range(len(lists)), pa.int32()), "top": pa.array(top), "texts": pa.array([list(t) for t, _ in lists], pa.list_(pa.string()))}))
    of = asks.join(F.broadcast(named), "texts").select("ask", "q_idx", "bag", "top")
    order = Window.partitionBy("bag").orderBy(F.desc("score"), "page_id", "start")
    hits = d.mapInArrow(ranking._searched(asked, known.weights, mean, top, False, places), ranking._HIT).select("bag", "page_id", "start", "score")
    limit = int(top.max())
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).join(F.broadcast(named.select("bag", "top")), "bag").where(F.col("rank") <= F.col("top"))
    tops = hits.select("bag", "page_id", "start", "rank").persist()
    full = tops.groupBy("bag").agg(F.count("*").alias("found"))
    part = 1 / (RRF + F.col("rank"))
    seen = of.join(tops, "bag").select("ask", "q_idx", F.lit(1).alias("m"), "bag", "page_id", "start", "rank")
    if near is not None:
        seen = seen.unionByName(near.select("ask", "q_idx", F.lit(0).alias("m"), F.lit(None).cast("int").alias("bag"), "page_id", "start", "rank"))
    least = seen.groupBy("ask", "page_id", "start").agg(F.sum(part).alias("low"), F.collect_set("bag").alias("bags"))
    # rankings that go on beyond their top
    longer = of.join(full, "bag").where(F.col("found") >= F.col("top")).groupBy("ask").agg(F.collect_list(F.struct("bag", "top")).alias("longer"))
    least = least.join(longer, "ask", "left").withColumn("open", F.filter(F.coalesce("longer", F.expr("cast(array() as array<struct<bag:int,top:bigint>>)")), lambda x: ~F.array_contains("bags", x["bag"])))
    least = least.withColumn("high", F.col("low") + F.aggregate("open", F.lit(0.0), lambda s, x: s + 1 / (RRF + 1 + x["top"])))
    of_ask = Window.partitionBy("ask")
    least = least.withColumn("n", F.row_number().over(of_ask.orderBy(F.desc("low"), "page_id", "start")))
    bound = F.coalesce(F.max(F.when(F.col("n") == k, F.col("low"))).over(of_ask), F.lit(0.0))
    kept = least.withColumn("bound", bound).where(F.col("high") >= F.col("bound") - SLACK).select("ask", "page_id", "start", "open").persist()
    unknown = kept.select(F.explode("open.bag").alias("bag"), "page_id", "start").distinct().toArrow()
    final = seen.join(kept.select("ask", "page_id", "start"), ["ask", "page_id", "start"]).select("ask", "q_idx", "m", "page_id", "start", "rank")
    if unknown.num_rows:
        bag, page, start = (unknown[c].to_numpy() for c in ("bag", "page_id", "start"))
        both, at = np.unique(np.stack((page, start), 1), axis=0, return_inverse=True)
        wanted = [at[bag == b].ravel() for b in range(len(lists))]
        few = spark.createDataFrame(pa.table({"page_id": pa.array(np.unique(page))}))
        scored = d.join(F.broadcast(few), "page_id", "left_semi").mapInArrow(_placed(asked, known.weights, mean, places, wanted, both[:, 0], both[:, 1]), "bag int, page_id bigint, start bigint, score double").where("score > 0").toArrow()
        bag, page, start, score = (scored[c].to_numpy() for c in ("bag", "page_id", "start", "score"))
        marks = {int(b): tuple(x[bag == b] for x in (score, page, start)) for b in np.unique(bag)}
        if marks:
            counts = d.mapInArrow(_counted(asked, known.weights, mean, places, marks), "bag int, page_id bigint, start bigint, better bigint")
            ranks = counts.groupBy("bag", "page_id", "start").agg((F.sum("better") + 1).cast("int").alias("rank"))
            more = kept.select("ask", "page_id", "start", F.explode("open.bag").alias("bag")).join(ranks, ["bag", "page_id", "start"])
            final = final.unionByName(more.join(of.select("ask", "q_idx", "bag"), ["ask", "bag"]).select("ask", "q_idx", F.lit(1).alias("m"), "page_id", "start", "rank"))
    f = final.groupBy("ask", "page_id", "start").agg(F.round(F.sum(part), 9 if places == ranking.PLACES else 12).alias("final_score"), F.count("*").alias("n_details"), F.min(F.struct("q_idx", "m", "rank")).alias("seen"))
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("final_score"), "seen", "page_id", "start")))
    found = f.where(F.col("rank") <= k).drop("seen").toArrow()  # k rows an ask; no plan grows on those behind them
    for x in (asks, tops, kept):
        x.unpersist()
    return spark.createDataFrame(found)


def alone(texts: list[str], order: np.ndarray, asks: list[list[tuple]], k: int) -> list[list[int]]:
    """The k best texts of every ask, each a list of bags of words, by the sum of 1 / (RRF + rank); ties by `order`.

    Scores are rounded to nine places; where none of a bag is positive, the tokens in common count.
    """
    p = ranking.postings(texts)
    n, df = len(texts), np.diff(p.starts)
    raw = np.log(n - df + 0.5) - np.log(df + 0.5)
    w = np.where(raw < 0, EPSILON * raw.mean() if len(raw) else 0.0, raw)
    mean = p.lengths.mean() or 1.0
    bag_of = {}
    for a in asks:
        for t in a:
            bag_of.setdefault(t, len(bag_of))
    b = ranking.bags([list(t) for t in bag_of], False)
    at = np.minimum(np.searchsorted(p.codes, b.asked), max(0, len(p.codes) - 1))
    there = p.codes[at] == b.asked if len(p.codes) else np.zeros(len(at), bool)
    ranks = np.zeros((len(bag_of), n), np.int32)
    for i in range(len(bag_of)):
        here = [(at[t], m) for t, m in zip(b.token[b.starts[i] : b.starts[i + 1]], b.times[b.starts[i] : b.starts[i + 1]]) if there[t]]
        if not here:
            continue
        where = [slice(p.starts[t], p.starts[t + 1]) for t, _ in here]
        row, f = np.concatenate([p.row[x] for x in where]), np.concatenate([p.f[x] for x in where])
        value = np.repeat([m * w[t] for t, m in here], [x.stop - x.start for x in where])
        score = ranking.rounded(np.bincount(row, value * f * (K1 + 1) / (f + K1 * (1 - B + B * p.lengths[row] / mean)), n), 9)
        if not (score > 0).any():
            score = np.bincount(row, minlength=n).astype(float)
        found = np.flatnonzero(score > 0)
        by = found[np.lexsort((order[found], -score[found]))]
        ranks[i, by] = np.arange(1, len(by) + 1)
    part = np.where(ranks > 0, 1 / (RRF + ranks), 0.0)
    out, done = [], {}
    for a in asks:
        if (key := tuple(a)) not in done:
            mine = [bag_of[t] for t in a]
            total = ranking.rounded(part[mine].sum(0), 12) if mine else np.zeros(n)
            found = np.flatnonzero(total > 0)
            if len(found) > k:
                found = found[total[found] >= np.partition(total[found], len(found) - k)[len(found) - k]]
            r = ranks[mine][:, found]
            first = (r > 0).argmax(0) if len(found) else found
            done[key] = found[np.lexsort((r[first, np.arange(len(found))], first, -total[found]))][:k].tolist() if len(found) else []
        out.append(done[key])
    return out
