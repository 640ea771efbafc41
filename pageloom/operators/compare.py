"""Comparing strategies: paired bootstrap intervals, guardrails, selection."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import sent_if_small

#: Ranges that a key's values are cut into.
RANGES = 256
#: The checks of a candidate against the baseline: the number that is checked, how, and its bound.
CHECKS = (
    ("coverage_at_3_low", ">=", -0.01), ("coverage_budget_low", ">=", -0.01), ("boundary_gain", ">=", 0.05), ("boundary_low", ">", 0.0), ("confusion_high", "<=", 0.01),
    ("irrelevant_high", "<=", 0.02), ("token_ratio", "<=", 1.15), ("unit_ratio", "<=", 1.25), ("latency_ratio", "<=", 2.0), ("invariants", ">=", 1.0),
)
#: Draws of the bootstrap and its seed.
DRAWS, SEED = 2000, 0


@lru_cache(16)
def _resamples(n: int, draws: int, seed: int) -> np.ndarray:
    """Index table of the resamples; it depends on the numbers only."""
    r = random.Random(seed)
    return np.array([[r.randrange(n) for _ in range(n)] for _ in range(draws)], np.int32)


def paired_interval(values: list[float], draws: int = DRAWS, seed: int = SEED) -> tuple[float, float, float]:
    """Mean of paired differences and its 95 % percentile interval; zeros for none."""
    if not values:
        return 0.0, 0.0, 0.0
    v = np.asarray(values, float)
    means = np.sort(v[_resamples(len(v), draws, seed)].mean(1))
    return float(v.mean()), float(means[int(0.025 * (draws - 1))]), float(means[int(0.975 * (draws - 1))])


def paired_intervals(pairs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(name, n, mean, low, high) of pairs (name, case_id, difference). A name's cases are those of one benchmark, a few hundred."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("case_id", "ascending")])
        m, lo, hi = paired_interval(t["difference"].to_pylist(), draws)
        return pa.table({"name": t["name"].slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "mean": [round(m, 9)], "low": [round(lo, 9)], "high": [round(hi, 9)]})

    return pairs.select("name", "case_id", "difference").groupBy("name").applyInArrow(one, "name string, n bigint, mean double, low double, high double")


def guardrails(metrics: DataFrame, checks: list[tuple[str, str, str, float]]) -> DataFrame:
    """(candidate, name, value, bound, passed) of wide `metrics` (candidate, ...) by checks (name, column, 'min' or 'max', bound); a missing value fails."""
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(float(b)).alias("bound"),
            F.coalesce((F.col(c) >= b) if way == "min" else (F.col(c) <= b), F.lit(False)).alias("passed"),
        )
        for n, c, way, b in checks
    ])
    return metrics.select("candidate", F.explode(rows).alias("x")).select("candidate", "x.*")


def running_counts(values: DataFrame, key: str, value: str, n: str, ranges: int = RANGES) -> DataFrame:
    """`values` (key, value, n), one row a value of a key, with `upto`, the sum of n up to it, and `total`.

    A key's values are cut into ranges at approximate quantiles; sums run within a range and over the ranges, never over all values of a key.
    """
    cuts = values.groupBy(key).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("_cuts"))
    x = values.join(sent_if_small(cuts), key).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = x.groupBy(key, "_range").agg(F.sum(n).alias("_n"))
    along = Window.partitionBy(key)
    before = sums.select(key, "_range", (F.sum("_n").over(along.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(along).alias("total"))
    inside = F.sum(n).over(Window.partitionBy(key, "_range").orderBy(value))
    return x.withColumn("_inside", inside).join(sent_if_small(before), [key, "_range"]).select(key, value, n, (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def strategy_checks(cases: DataFrame, totals: DataFrame, baseline: str, draws: int = DRAWS) -> DataFrame:
    """(candidate, name, value, bound, passed) of every strategy but the baseline, by CHECKS.

    `cases` are (strategy, case_id, cov_3, cov_budget, boundary, hard, confusion, irrelevant), `totals` (strategy, tokens, units, latency, invariants).
    Intervals are of paired differences over the cases; a check without cases, or whose value is missing, fails.
    """
    cols = ["cov_3", "cov_budget", "confusion", "irrelevant"]
    base = cases.where(F.col("strategy") == baseline).select("case_id", *[F.col(c).alias(f"b_{c}") for c in cols], F.col("hard").alias("b_hard"))
    j = cases.where(F.col("strategy") != baseline).join(base, "case_id")
    gain = lambda name, c, when: F.when(when, F.struct(F.lit(name).alias("metric"), (F.col(c).cast("double") - F.col(f"b_{c}").cast("double")).alias("difference")))
    rows = F.array_compact(F.array(
        gain("cov_3", "cov_3", F.lit(True)), gain("cov_budget", "cov_budget", F.lit(True)), gain("boundary", "cov_budget", F.coalesce("boundary", F.lit(False))),
        gain("confusion", "confusion", F.coalesce("b_hard", F.lit(False))), gain("irrelevant", "irrelevant", F.lit(True)),
    ))
    pairs = j.select("strategy", "case_id", F.explode(rows).alias("x")).select(F.concat_ws("\n", "strategy", "x.metric").alias("name"), "case_id", "x.difference")
    part = F.split("name", "\n")
    v = paired_intervals(pairs, draws).select(part[0].alias("strategy"), part[1].alias("metric"), "mean", "low", "high")
    at = lambda metric, c, name: F.max(F.when(F.col("metric") == metric, F.col(c))).alias(name)
    wide = v.groupBy("strategy").agg(
        at("cov_3", "low", "coverage_at_3_low"), at("cov_budget", "low", "coverage_budget_low"), at("boundary", "mean", "boundary_gain"), at("boundary", "low", "boundary_low"),
        at("confusion", "high", "confusion_high"), at("irrelevant", "high", "irrelevant_high"),
    )
    of = totals.where(F.col("strategy") == baseline).select(F.col("tokens").alias("b_tokens"), F.col("units").alias("b_units"), F.col("latency").alias("b_latency"))  # one row
    t = totals.where(F.col("strategy") != baseline).join(F.broadcast(of))
    ratio = lambda c, name: T.ratio(F.col(c).cast("double"), F.col(f"b_{c}").cast("double")).alias(name)
    t = t.select("strategy", ratio("tokens", "token_ratio"), ratio("units", "unit_ratio"), ratio("latency", "latency_ratio"), F.col("invariants").cast("double").alias("invariants")).join(wide, "strategy", "left")
    holds = {">=": lambda c, b: c >= b, ">": lambda c, b: c > b, "<=": lambda c, b: c <= b}
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(b).alias("bound"), F.coalesce(holds[how](F.col(n), b), F.lit(False)).alias("passed")) for n, how, b in CHECKS])
    return t.select(F.col("strategy").alias("candidate"), F.explode(checks).alias("x")).select("candidate", "x.*")


def selected(cases: DataFrame, totals: DataFrame, checks: DataFrame) -> DataFrame:
    """One row (strategy, eligible): of the strategies that pass all checks, or of all if none does, the best by coverage within the budget, coverage at 3, coverage of boundary cases, fewer tokens, fewer units, less latency, and name."""
    ok = checks.groupBy(F.col("candidate").alias("strategy")).agg(F.bool_and("passed").alias("eligible"))
    mean = lambda c, when=None: F.coalesce(F.avg(F.when(when, F.col(c).cast("double")) if when is not None else F.col(c).cast("double")), F.lit(0.0))
    m = cases.groupBy("strategy").agg(mean("cov_budget").alias("budget"), mean("cov_3").alias("at_3"), mean("cov_budget", F.col("boundary")).alias("boundary"))
    j = ok.join(m, "strategy").join(totals, "strategy")
    return j.orderBy(F.desc("eligible"), F.desc("budget"), F.desc("at_3"), F.desc("boundary"), "tokens", "units", "latency", "strategy").limit(1).select("strategy", "eligible")
