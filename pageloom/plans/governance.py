"""Queries of dataset governance: splits, families, annotation outcomes, strata, gates, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..operators.govern import LABELS, select_subset

#: Cases planned a source; sources of the systematic sample; share of sources to hold out.
CASES, SAMPLE, HELD_OUT = 3, 20, 0.3
#: Bounds of the release gates: least certain cases of the evaluation side and of a stratum, greatest rates of uncertain cases of all and of a stratum, greatest share of a family.
LEAST_CASES, LEAST_STRATUM, MOST_UNCERTAIN, MOST_OF_STRATUM, MOST_SHARE = 200, 30, 0.10, 0.15, 0.05


def _sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark_source").select("source_id", "insurer_family", "product_family").distinct()


def _splits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "document_split_assignment").where("split is not null").select("source_id", "split", "near_duplicate_family").distinct()


def _cases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "silver_case").distinct()


def family_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with sources on more than one split."""
    s = _splits(spark, sf_dir).join(_sources(spark, sf_dir), "source_id")
    f = s.select("split", F.explode(F.array(F.struct(F.lit("insurer").alias("kind"), F.col("insurer_family").alias("family")), F.struct(F.lit("product").alias("kind"), F.col("product_family").alias("family")), F.struct(F.lit("near_duplicate").alias("kind"), F.col("near_duplicate_family").alias("family")))).alias("x")).select("split", "x.*")
    return f.where("family is not null").groupBy("kind", "family").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n_sources")).where("splits > 1")


def max_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest share of one family among the sources of each split, by kind of family."""
    s = _splits(spark, sf_dir).select("source_id", "split").distinct().join(_sources(spark, sf_dir), "source_id")
    out = None
    for kind in ("insurer_family", "product_family"):
        n = s.where(F.col(kind).isNotNull()).groupBy("split", F.col(kind).alias("family")).agg(F.count("*").alias("n"))
        one = n.groupBy("split").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def insurer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).where("insurer_family is not null").groupBy("insurer_family").agg(F.count_distinct("source_id").alias("n_sources"))


def split_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insurers held out: a subset whose sources come nearest to the share wanted (the sums are a table of insurers, chosen on the driver)."""
    n = insurer_sources(spark, sf_dir).orderBy("insurer_family")
    rows = [(r[0], r[1]) for r in n.collect()]  # one row an insurer, whose number grows more slowly than the data
    chosen = select_subset(rows, round(HELD_OUT * sum(x for _, x in rows)))
    return n.where(F.col("insurer_family").isin(sorted(chosen)) if chosen else F.lit(False))


def round_robin_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned cases of each source, with strata dealt in turn over a running number within the split."""
    s = _splits(spark, sf_dir).select("source_id", "split").distinct()
    nth = F.row_number().over(Window.partitionBy("split").orderBy("source_id")) - 1
    x = s.withColumn("nth", nth).select("source_id", "split", F.explode(F.sequence(F.lit(0), F.lit(CASES - 1))).alias("local"), "nth")
    slot = F.col("nth") * CASES + F.col("local")
    return x.select("source_id", "split", slot.alias("slot"), F.element_at(F.array(*map(F.lit, LABELS)), F.pmod(slot, F.lit(len(LABELS))).cast("int") + 1).alias("stratum"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced sources in the order of their ids (a sampling operator)."""
    s = _sources(spark, sf_dir).select("source_id").distinct()
    ranked = s.withColumn("nth", F.row_number().over(Window.orderBy("source_id")) - 1)
    n = s.count()
    wanted = sorted({int(i * n / SAMPLE) for i in range(min(SAMPLE, n))}) if n > SAMPLE else list(range(n))
    return ranked.where(F.col("nth").isin(wanted)).select("source_id", "nth")


def agreement_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two annotators of each case, whether their labels agree, and the outcome with a third one's help."""
    plain = F.regexp_replace(F.lower(F.trim("stratum")), "[ -]", "_")
    d = table(spark, sf_dir, "annotation_draft").select("case_id", "annotator_id", "draft_id", "request_timestamp", "annotation_uncertain", plain.alias("label")).distinct()
    last = Window.partitionBy("case_id", "annotator_id").orderBy(F.desc("request_timestamp"), F.desc("draft_id"))
    one = d.withColumn("n", F.row_number().over(last)).where("n = 1")
    who = one.withColumn("slot", F.row_number().over(Window.partitionBy("case_id").orderBy("annotator_id"))).where("slot <= 3")
    p = who.groupBy("case_id").pivot("slot", [1, 2, 3]).agg(F.first(F.struct("label", "annotation_uncertain")).alias("x"))
    a, b, c = (F.col(f"`{i}`") for i in (1, 2, 3))
    agreed = a["label"].eqNullSafe(b["label"]) & a["annotation_uncertain"].eqNullSafe(b["annotation_uncertain"])
    out = F.when(b.isNull(), "single").when(agreed, "agreed").when(c.isNull() | F.coalesce(c["annotation_uncertain"], F.lit(True)) | c["label"].isNull(), "annotation_uncertain").otherwise("adjudicated")
    return p.select("case_id", out.alias("outcome"))


def annotation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of disagreement, adjudication and exclusion by version and split."""
    c = _cases(spark, sf_dir).join(_splits(spark, sf_dir).select("source_id", "split").distinct(), "source_id", "left")
    yes = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    n = c.groupBy("version", F.coalesce("split", F.lit("unassigned")).alias("split")).agg(
        F.count("*").alias("total"), yes(F.col("initial_disagreement")).alias("disagreements"), yes(F.col("adjudicated")).alias("adjudicated"), yes(F.col("annotation_uncertain")).alias("uncertain")
    )
    rate = lambda a, b, name: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias(name)
    return n.select("version", "split", "total", "disagreements", "adjudicated", "uncertain", rate("disagreements", "total", "disagreement_rate"), rate("uncertain", "total", "exclusion_rate"))


def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by stratum, with and without uncertain ones, and the share of uncertain ones."""
    u = F.coalesce("annotation_uncertain", F.lit(False))
    return _cases(spark, sf_dir).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("cases"), F.count_if(~u).alias("certain"), F.round(F.avg(u.cast("double")), 6).alias("uncertain_rate"))


def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered split report against one counted from the cases: fields that differ, row by row (full outer)."""
    q = annotation_quality(spark, sf_dir).select("version", "split", "total", "disagreements", "uncertain")
    r = table(spark, sf_dir, "dataset_split_report").distinct().select("version", "split", F.col("total_cases").alias("r_total"), F.col("initial_disagreements").alias("r_disagreements"), F.col("uncertain_exclusions").alias("r_uncertain"))
    j = q.join(r, ["version", "split"], "full")
    diff = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"r_{c}").cast("bigint")), F.lit(c)) for c in ("total", "disagreements", "uncertain")]))
    return j.select("version", "split", F.array_join(diff, ",").alias("differs"))


def gate_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release gates as rows: value, bound, and whether it's met; each value is one aggregate."""
    from .annotation import frozen_cases

    c, n = _cases(spark, sf_dir), lambda: F.count("*").cast("double")
    src = table(spark, sf_dir, "benchmark_source").select("source_id", "source_name", "approval", "approval_reference", "source_content_sha256").distinct()
    split = _splits(spark, sf_dir).select("source_id", "split").distinct()
    own = c.join(split, "source_id", "left")
    unsure = F.coalesce("annotation_uncertain", F.lit(False))
    reported = table(spark, sf_dir, "dataset_split_report").select("version").distinct()
    strata = c.where("stratum is not null").groupBy("stratum").agg(F.count_if(~unsure).cast("double").alias("certain"), F.avg(unsure.cast("double")).alias("rate"))
    dev = own.where(f"split = 'development' and stratum in {LABELS}")
    share = max_share(spark, sf_dir)
    most = lambda kind: share.agg(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("share"))), F.lit(0.0)))
    gates = [
        ("cases_without_version", c.where("version is null").agg(n()), "max", 0.0),
        ("versions_without_report", c.select("version").distinct().join(reported, "version", "left_anti").agg(n()), "max", 0.0),
        ("sources_of_two_splits", split.groupBy("source_id").agg(F.count("*").alias("k")).where("k > 1").agg(n()), "max", 0.0),
        ("unregistered_sources", c.select("source_id").distinct().join(src, "source_id", "left_anti").agg(n()), "max", 0.0),
        ("ambiguous_sources", src.groupBy("source_id").agg(F.count("*").alias("k")).where("k > 1").agg(n()), "max", 0.0),
        ("ambiguous_cases", c.groupBy("case_id").agg(F.count("*").alias("k")).where("k > 1").agg(n()), "max", 0.0),
        ("invalid_cases", frozen_cases(spark, sf_dir).where("status <> 'valid'").agg(n()), "max", 0.0),
        ("missing_strata", dev.agg((F.lit(len(LABELS)) - F.count_distinct("stratum")).cast("double")), "max", 0.0),
        ("held_out_cases", own.where("split = 'held_out'").agg(F.count_if(~unsure).cast("double")), "min", float(LEAST_CASES)),
        ("cases_of_a_stratum", strata.agg(F.coalesce(F.min("certain"), F.lit(0.0))), "min", float(LEAST_STRATUM)),
        ("uncertain_rate", c.agg(F.round(F.coalesce(F.avg(unsure.cast("double")), F.lit(0.0)), 6)), "max", MOST_UNCERTAIN),
        ("uncertain_rate_of_a_stratum", strata.agg(F.round(F.coalesce(F.max("rate"), F.lit(0.0)), 6)), "max", MOST_OF_STRATUM),
        ("insurer_share", most("insurer_family"), "max", MOST_SHARE),
        ("product_share", most("product_family"), "max", MOST_SHARE),
        ("family_leaks", family_leakage(spark, sf_dir).agg(n()), "max", 0.0),
    ]
    out = None
    for name, value, way, bound in gates:
        v = value.toDF("value")
        one = v.select(F.lit(name).alias("gate"), "value", F.lit(bound).alias("bound"), ((F.col("value") >= bound) if way == "min" else (F.col("value") <= bound)).alias("met"))
        out = one if out is None else out.unionByName(one)
    return out


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short content ids of cases: hash of their canonical record."""
    c = _cases(spark, sf_dir).select("case_id", "source_id", F.coalesce("question", F.lit("")).alias("question"))
    return c.select("case_id", F.concat(F.lit("case-"), F.substring(F.sha2(F.concat_ws("\n", "source_id", "question"), 256), 1, 16)).alias("content_id")).distinct()


def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per version the hash over its cases' hashes, in order of case."""
    c = _cases(spark, sf_dir).select("version", "case_id", F.sha2(F.concat_ws("\n", "case_id", "source_id", F.coalesce("question", F.lit(""))), 256).alias("h"))
    # a version holds at most a few hundred cases
    return c.groupBy("version").agg(F.count("*").alias("cases"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "h"))), lambda x: x["h"]), "\n"), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (family_leakage, max_share, insurer_sources, split_subset, round_robin_strata, systematic_sample, agreement_outcomes, annotation_quality, stratum_counts, report_comparison, gate_battery, case_ids, manifest_hashes)}

_SRC = "src as (select distinct source_id, insurer_family, product_family from benchmark_source)"
_SPL = "spl as (select distinct source_id, split, near_duplicate_family from document_split_assignment where split is not null)"
_LEAK = f"{_SRC}, {_SPL}, j as (select split, insurer_family, product_family, near_duplicate_family from spl join src using (source_id)), fm as (select 'insurer' kind, insurer_family family, split from j union all select 'product', product_family, split from j union all select 'near_duplicate', near_duplicate_family, split from j), lk as (select kind, family, count(distinct split) splits, count(*) n_sources from fm where family is not null group by 1, 2 having count(distinct split) > 1)"
_SHARE = "s2 as (select distinct source_id, split from spl), j2 as (select split, insurer_family, product_family from s2 join src using (source_id)), ms as (select split, round(max(n) / sum(n), 6) share, kind from (select split, 'insurer_family' kind, insurer_family f, count(*) n from j2 where insurer_family is not null group by all union all select split, 'product_family', product_family, count(*) from j2 where product_family is not null group by all) group by split, kind)"
_QUAL = "cs as (select distinct * from silver_case), aq as (select version, coalesce(split, 'unassigned') split, count(*) total, count_if(initial_disagreement) disagreements, count_if(adjudicated) adjudicated, count_if(annotation_uncertain) uncertain from cs left join (select distinct source_id, split from document_split_assignment where split is not null) using (source_id) group by 1, 2)"
_L = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
SQL = {
    "split_subset": f"""with n as (select insurer_family f, count(distinct source_id) c from benchmark_source where insurer_family is not null group by 1),
        l as (select list(f order by f) fs, list(c order by f) cs, round_even({HELD_OUT} * sum(c), 0) target, sum(c) total from n),
        m as (select mask, list_sum(list_filter(cs, lambda c, i: (mask >> (i::int - 1)) & 1 = 1)) s, fs, target, total from (select *, unnest(range(1, (1 << len(fs)::int)::bigint)) mask from l)),
        b as (select fs, mask from m where s > 0 and s < total order by abs(s - target), s, mask limit 1)
        select f insurer_family, c n_sources from n join (select unnest(list_filter(fs, lambda x, i: (mask >> (i::int - 1)) & 1 = 1)) f from b) using (f)""",
    "family_leakage": f"with {_LEAK} select * from lk",
    "max_share": f"with {_SRC}, {_SPL}, {_SHARE} select * from ms",
    "insurer_sources": "select insurer_family, count(distinct source_id) n_sources from benchmark_source where insurer_family is not null group by 1",
    "round_robin_strata": f"""with s as (select source_id, split, row_number() over (partition by split order by source_id) - 1 nth from (select distinct source_id, split from document_split_assignment where split is not null)),
        x as (select source_id, split, (nth * {CASES} + local)::int slot from (select *, unnest(range({CASES})) local from s)) select source_id, split, slot, {_L}[slot % {len(LABELS)} + 1] stratum from x""",
    "systematic_sample": f"""with s as (select source_id, (row_number() over (order by source_id) - 1)::int nth, count(*) over () n from (select distinct source_id from benchmark_source)),
        w as (select distinct floor(i * n / {SAMPLE})::int nth from range({SAMPLE}) r(i), (select count(distinct source_id) n from benchmark_source)) select source_id, nth from s where n <= {SAMPLE} or nth in (select nth from w)""",
    "agreement_outcomes": """with d as (select distinct case_id, annotator_id, draft_id, request_timestamp, annotation_uncertain u, regexp_replace(lower(trim(stratum)), '[ -]', '_', 'g') label from annotation_draft),
        o as (select *, row_number() over (partition by case_id, annotator_id order by request_timestamp desc nulls last, draft_id desc) n from d),
        w as (select *, row_number() over (partition by case_id order by annotator_id) slot from o where n = 1),
        p as (select case_id, max(slot) k, any_value(label) filter (slot = 1) la, any_value(label) filter (slot = 2) lb, any_value(label) filter (slot = 3) lc, any_value(u) filter (slot = 1) ua, any_value(u) filter (slot = 2) ub, any_value(u) filter (slot = 3) uc from w group by 1)
        select case_id, case when k < 2 then 'single' when la is not distinct from lb and ua is not distinct from ub then 'agreed' when k < 3 or coalesce(uc, true) or lc is null then 'annotation_uncertain' else 'adjudicated' end outcome from p""",
    "annotation_quality": f"with {_QUAL} select version, split, total, disagreements::bigint disagreements, adjudicated::bigint adjudicated, uncertain::bigint uncertain, round(disagreements / total, 6) disagreement_rate, round(uncertain / total, 6) exclusion_rate from aq",
    "stratum_counts": "select stratum, count(*) cases, count_if(not coalesce(annotation_uncertain, false))::bigint certain, round(avg(coalesce(annotation_uncertain, false)::int), 6) uncertain_rate from (select distinct * from silver_case) where stratum is not null group by 1",
    "report_comparison": f"""with {_QUAL}, r as (select distinct * from dataset_split_report)
        select version, split, array_to_string(list_filter([case when total is distinct from total_cases then 'total' end, case when disagreements is distinct from initial_disagreements then 'disagreements' end, case when uncertain is distinct from uncertain_exclusions then 'uncertain' end], lambda x: x is not null), ',') differs
        from aq full join r using (version, split)""",
    "gate_battery": None,
    "case_ids": "select distinct case_id, 'case-' || substring(sha256(concat_ws(chr(10), source_id, coalesce(question, ''))), 1, 16) content_id from silver_case",
    "manifest_hashes": "select version, count(*) cases, sha256(string_agg(sha256(concat_ws(chr(10), case_id, source_id, coalesce(question, ''))), chr(10) order by case_id)) sha256 from (select distinct * from silver_case) group by 1",
}


def _gates_sql() -> str:
    from .annotation import SQL as annotation

    gates = {
        "cases_without_version": ("select count(*) from cs where version is null", "<=", 0),
        "versions_without_report": ("select count(distinct coalesce(version, '-')) from cs where version is null or version not in (select version from dataset_split_report)", "<=", 0),
        "sources_of_two_splits": ("select count(*) from (select source_id from s2 group by 1 having count(*) > 1)", "<=", 0),
        "unregistered_sources": ("select count(distinct coalesce(source_id, '-')) from cs where source_id is null or source_id not in (select source_id from benchmark_source where source_id is not null)", "<=", 0),
        "ambiguous_sources": ("select count(*) from (select source_id from (select distinct source_id, source_name, approval, approval_reference, source_content_sha256 from benchmark_source) group by 1 having count(*) > 1)", "<=", 0),
        "ambiguous_cases": ("select count(*) from (select case_id from cs group by 1 having count(*) > 1)", "<=", 0),
        "invalid_cases": (f"select count(*) from ({annotation['frozen_cases']}) where status <> 'valid'", "<=", 0),
        "missing_strata": (f"select {len(LABELS)} - count(distinct stratum) from cs join s2 using (source_id) where split = 'development' and stratum in {LABELS}", "<=", 0),
        "held_out_cases": ("select count_if(not coalesce(annotation_uncertain, false)) from cs join s2 using (source_id) where split = 'held_out'", ">=", LEAST_CASES),
        "cases_of_a_stratum": ("select coalesce(min(k), 0) from st", ">=", LEAST_STRATUM),
        "uncertain_rate": ("select round(coalesce(avg(coalesce(annotation_uncertain, false)::int), 0), 6) from cs", "<=", MOST_UNCERTAIN),
        "uncertain_rate_of_a_stratum": ("select round(coalesce(max(r), 0), 6) from st", "<=", MOST_OF_STRATUM),
        "insurer_share": ("select coalesce(max(share) filter (kind = 'insurer_family'), 0) from ms", "<=", MOST_SHARE),
        "product_share": ("select coalesce(max(share) filter (kind = 'product_family'), 0) from ms", "<=", MOST_SHARE),
        "family_leaks": ("select count(*) from lk", "<=", 0),
    }
    st = "st as (select stratum, count_if(not coalesce(annotation_uncertain, false)) k, avg(coalesce(annotation_uncertain, false)::int) r from cs where stratum is not null group by 1)"
    rows = " union all ".join(f"select '{g}' gate, ({v})::double \"value\", {b}::double bound, ({v})::double {op} {b}::double met" for g, (v, op, b) in gates.items())
    return f"with {_LEAK}, {_SHARE}, cs as (select distinct * from silver_case), {st} {rows}"


SQL["gate_battery"] = _gates_sql()
