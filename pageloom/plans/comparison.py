"""Queries of comparison and of facts: percentiles, distributions, bootstrap, guardrails, selection, numbers and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, spans
from ..sources.tables import pages, table

#: Limits of the length distribution; guardrails as (name, column, direction, bound).
LIMITS = (900, 1200, 1600)
CHECKS = [("mean_value", "mean_value", "min", 49.0), ("p95_value", "p95_value", "max", 150.0), ("events", "events", "min", 100.0), ("rate", "rate", "max", 0.5)]


def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the events' values by type.

    Ranks are counted on (type, value) groups, in ranges of about equal size, so no type's values come together in one row or task.
    """
    v = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    r = compare.running_counts(v, "event_type", "value", "n")
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * p / 100), F.col("value"))).alias(f"p{p}")
    return r.groupBy("event_type").agg(at(50), at(90), at(95), at(99))


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, percentiles and numbers over the limits of page lengths by method of extraction."""
    from pyspark.sql import Window

    p = pages(spark, sf_dir, "text", "extraction_method").select(F.coalesce("extraction_method", F.lit("none")).alias("method"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    v = p.groupBy("method", "n").agg(F.count("*").alias("k"))
    r = v.withColumn("upto", F.sum("k").over(Window.partitionBy("method").orderBy("n"))).withColumn("total", F.sum("k").over(Window.partitionBy("method")))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * q / 100), F.col("n"))).alias(f"p{q}")
    over = [F.coalesce(F.sum(F.when(F.col("n") > x, F.col("k"))), F.lit(0)).cast("bigint").alias(f"over_{x}") for x in LIMITS]
    return r.groupBy("method").agg(F.max("total").cast("bigint").alias("pages"), *[at(q) for q in (50, 75, 90, 95, 99)], *over)


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the coverage difference between the first unit and the first five, and between three and five, over the questions."""
    from .spans import EVERY, coverage_at_k

    c = coverage_at_k(spark, sf_dir, EVERY)
    rows = F.array(F.struct(F.lit("cov_5_minus_1").alias("name"), (F.col("cov_5") - F.col("cov_1")).alias("difference")), F.struct(F.lit("cov_5_minus_3").alias("name"), (F.col("cov_5") - F.col("cov_3")).alias("difference")))
    return compare.paired_intervals(c.select(F.col("query_id").alias("case_id"), F.explode(rows).alias("x")).select("case_id", "x.*"))


def _metrics(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = nearest_rank_percentile(spark, sf_dir).select("event_type", F.col("p95").alias("p95_value"))
    n = e.groupBy("event_type").agg(F.count("*").cast("double").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    total = n.agg(F.sum("events").alias("total"))  # one row
    return n.join(q, "event_type", "left").join(F.broadcast(total)).select(F.col("event_type").alias("candidate"), "events", "mean_value", "p95_value", F.round(F.col("events") / F.col("total"), 6).alias("rate"))


def guardrail_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's checks in long form."""
    return compare.guardrails(_metrics(spark, sf_dir), CHECKS)


def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by check, most first, and whether a check fails for all."""
    g = guardrail_table(spark, sf_dir).groupBy("name").agg(F.count_if(~F.col("passed")).alias("failures"), F.count("*").alias("candidates"))
    return g.select("name", "failures", (F.col("failures") == F.col("candidates")).alias("universal"))


def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with most checks passed, then the least 95th percentile, most events, first name (one row is the feature)."""
    g = guardrail_table(spark, sf_dir).groupBy("candidate").agg(F.count_if("passed").alias("n_passed"))
    j = g.join(_metrics(spark, sf_dir), "candidate")
    return j.orderBy(F.desc("n_passed"), F.asc_nulls_last("p95_value"), F.desc("events"), "candidate").limit(1).select("candidate", "n_passed")


_UNIT = "(元|日|天|%|岁|年|个月|周|days|months|years)"


def number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units of each page, units canonical, and how often."""
    t = T.without_thousands(F.coalesce("text", F.lit("")))
    p = pages(spark, sf_dir, "text").select("page_id", F.explode(F.regexp_extract_all(t, F.lit(f"([0-9]+(?:\\.[0-9]+)?\\s?{_UNIT})"), F.lit(1))).alias("m"))
    number, unit = T.normalized_number(F.regexp_extract("m", r"^([0-9.]+)", 1)), F.regexp_extract("m", _UNIT + "$", 1)
    unit = F.when(unit == "日", "天").otherwise(unit)
    return p.select("page_id", F.concat(number, unit).alias("fact")).groupBy("page_id", "fact").agg(F.count("*").alias("times"))


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quote with numbers: whether each is supported by the quote's page, as a semi join on (page, fact)."""
    q = table(spark, sf_dir, "evidence_span").select("span_id", "source_id", "page_number", "quote").distinct().join(pages(spark, sf_dir), ["source_id", "page_number"], "left")
    t = T.without_thousands(F.coalesce("quote", F.lit("")))
    x = q.select("span_id", "page_id", F.explode(F.regexp_extract_all(t, F.lit(f"([0-9]+(?:\\.[0-9]+)?\\s?{_UNIT})"), F.lit(1))).alias("m"))
    number, unit = T.normalized_number(F.regexp_extract("m", r"^([0-9.]+)", 1)), F.regexp_extract("m", _UNIT + "$", 1)
    claims = x.select("span_id", "page_id", F.concat(number, F.when(unit == "日", "天").otherwise(unit)).alias("fact")).distinct()
    facts = number_facts(spark, sf_dir).select("page_id", "fact", F.lit(True).alias("found"))
    return claims.join(facts, ["page_id", "fact"], "left").groupBy("span_id").agg(F.count("*").alias("claims"), F.count_if(F.coalesce("found", F.lit(False))).alias("supported"))


def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese numerals of clause numbers as whole numbers, and how often each stands."""
    p = pages(spark, sf_dir, "text").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("第([零〇一二两三四五六七八九十百]+)条"), F.lit(1))).alias("numeral"))
    return p.groupBy("numeral").agg(F.count("*").alias("times")).select("numeral", T.chinese_number(F.col("numeral")).alias("number"), "times")


QUERIES = {f.__name__: f for f in (nearest_rank_percentile, length_distribution, paired_bootstrap, guardrail_table, failure_analysis, select_candidate, number_facts, claim_support, chinese_numerals)}

_P = "(select distinct on (page_id) * from document_page)"
_PCT = lambda q, c="value": f"list_sort(list({c}))[round_even((count({c}) - 1) * {q} / 100.0, 0)::int + 1]"
_M = f"""n as (select event_type candidate, count(*)::double events, round(avg(value), 6) mean_value, {_PCT(95)} p95_value from events group by 1), m as (select *, round(events / (select sum(events) from n), 6) rate from n),
    g as ({' union all '.join(f"select candidate, '{n}' name, {c}::double value, {b}::double bound, coalesce({c} {'>=' if w == 'min' else '<='} {b}, false) passed from m" for n, c, w, b in CHECKS)})"""
_THOUSANDS = r"regexp_replace(regexp_replace(regexp_replace({0} || ' ', '([0-9]),([0-9]{{3}})([^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{{3}})([^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{{3}})([^0-9])', '\1\2\3', 'g')"
_FACT = rf"regexp_replace(regexp_extract(m, '^([0-9.]+)', 1), '\.0$', '') || case when regexp_extract(m, '{_UNIT}$', 1) = '日' then '天' else regexp_extract(m, '{_UNIT}$', 1) end"
_ALL = rf"regexp_extract_all({{0}}, '[0-9]+(?:\.[0-9]+)?\s?{_UNIT}')"
_FACTS = f"nf as (select page_id, {_FACT} fact, count(*) times from (select page_id, unnest({_ALL.format(_THOUSANDS.format("coalesce(text, '')"))}) m from {_P}) group by 1, 2)"
SQL = {
    "nearest_rank_percentile": f"select event_type, {', '.join(f'{_PCT(q)} p{q}' for q in (50, 90, 95, 99))} from events where value is not null group by 1",
    "length_distribution": f"""with p as (select coalesce(extraction_method, 'none') method, length(coalesce(text, ''))::int n from {_P})
        select method, count(*) pages, {', '.join(f"{_PCT(q, 'n')} p{q}" for q in (50, 75, 90, 95, 99))}, {', '.join(f'count_if(n > {x})::bigint over_{x}' for x in LIMITS)} from p group by 1""",
    "guardrail_table": f"with {_M} select * from g",
    "failure_analysis": f"with {_M} select name, count_if(not passed)::bigint failures, count_if(not passed) = count(*) universal from g group by 1",
    "select_candidate": f"with {_M} select candidate, n_passed from (select candidate, count_if(passed)::bigint n_passed from g group by 1) join m using (candidate) order by n_passed desc, p95_value nulls last, events desc, candidate limit 1",
    "number_facts": f"with {_FACTS} select * from nf",
    "claim_support": f"""with {_FACTS}, q as (select distinct span_id, s.source_id, s.page_number, quote, p.page_id from evidence_span s left join {_P} p on p.source_id = s.source_id and p.page_number = s.page_number),
        c as (select distinct span_id, page_id, {_FACT} fact from (select span_id, page_id, unnest({_ALL.format(_THOUSANDS.format("coalesce(quote, '')"))}) m from q))
        select span_id, count(*) claims, count_if(times is not null)::bigint supported from c left join nf using (page_id, fact) group by 1""",
    "chinese_numerals": f"""with x as (select unnest(regexp_extract_all(coalesce(text, ''), '第([零〇一二两三四五六七八九十百]+)条', 1)) numeral from {_P}), u as (select numeral, count(*) times from x group by 1),
        d as (select numeral, times, regexp_extract(numeral, '([一二两三四五六七八九])百', 1) h, regexp_extract(numeral, '([一二两三四五六七八九]?)十', 1) t, contains(numeral, '十') ten, contains(numeral, '百') hun, regexp_extract(numeral, '([一二两三四五六七八九])$', 1) o from u),
        v as (select numeral, times, lambda_h, lambda_t, lambda_o, ten, hun from (select *, list_position(['一','二','三','四','五','六','七','八','九'], replace(h, '两', '二')) lambda_h, list_position(['一','二','三','四','五','六','七','八','九'], replace(t, '两', '二')) lambda_t, list_position(['一','二','三','四','五','六','七','八','九'], replace(o, '两', '二')) lambda_o from d))
        select numeral, (case when hun then coalesce(nullif(lambda_h, 0), 1) * 100 else 0 end + case when ten then coalesce(nullif(lambda_t, 0), 1) * 10 else 0 end + coalesce(lambda_o, 0))::bigint number, times from v""",
}
