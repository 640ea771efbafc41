"""Consensus of several annotators' labels, their reliability, and chance-corrected agreement.

Per-annotator confusion matrices and the items' label posteriors are estimated
by expectation-maximisation with additive smoothing, as joins and aggregations
over the drafts; agreement (Fleiss' kappa over items with two or more labels)
is computed separately.

Defined results: of an annotator's drafts for a case only the last counts (by
time, then by draft id); uncertain drafts and null or unknown labels aren't
usable; cases without usable drafts have no consensus; ties in the posterior go
to the first label in the order of LABELS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialized, table

#: The labels.
LABELS = (
    "single_sentence", "multi_sentence_conditions_outcomes", "rule_plus_exception", "cross_page_clause",
    "complete_short_clause", "internally_split_clause", "adjacent_or_lexically_similar_hard_negative",
)
#: Rounds end when no case's probability of a label changes by more than STILL; the bound of their number only stops a run that wouldn't.
STILL, ROUNDS = 1e-3, 100
#: Additive smoothing of the confusion matrices, and its share on the diagonal.
SMOOTHING, DIAGONAL = 0.1, 2.0


def usable_drafts(drafts: DataFrame, labels=LABELS) -> DataFrame:
    """(case_id, annotator_id, label): the last draft of each annotator for each case, if it's usable; label is an index."""
    last = Window.partitionBy("case_id", "annotator_id").orderBy(F.desc_nulls_last("request_timestamp"), F.desc("draft_id"))
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace("stratum", r"(?U)[\s_-]+", " "))), " ", "_")
    index = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    return (
        drafts.where("case_id is not null and annotator_id is not null")
        .select("case_id", "annotator_id", "draft_id", "request_timestamp", "annotation_uncertain", index[plain].alias("label"))
        .withColumn("nth", F.row_number().over(last))
        .where("nth = 1 and not coalesce(annotation_uncertain, false) and label is not null")
        .select("case_id", "annotator_id", "label")
    )


def posteriors(votes: DataFrame, labels=LABELS, rounds: int = ROUNDS, smoothing: float = SMOOTHING, still: float = STILL) -> tuple[DataFrame, DataFrame]:
    """Of votes (case_id, annotator_id, label): (case_id, n, p0..pk) and (annotator_id, label, c0..ck), ck = log p(label | true k)."""
    k = len(labels)
    p, c = [f"p{i}" for i in range(k)], [f"c{i}" for i in range(k)]
    votes = materialized(votes)
    post = votes.groupBy("case_id").agg(F.count("*").alias("n"), *[F.avg((F.col("label") == i).cast("double")).alias(p[i]) for i in range(k)])
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("label")
    people = votes.select("annotator_id").distinct().select("annotator_id", every)
    confusion = None
    for r in range(rounds):
        seen = votes.join(post.drop("n"), "case_id").groupBy("annotator_id", "label").agg(*[F.sum(x).alias(x) for x in p])
        own = Window.partitionBy("annotator_id")
        part = people.join(seen, ["annotator_id", "label"], "left")
        share = [F.coalesce(F.col(p[i]), F.lit(0.0)) + smoothing * F.when(F.col("label") == i, DIAGONAL * k).otherwise(1.0) for i in range(k)]
        confusion = part.select("annotator_id", "label", *[share[i].alias(c[i]) for i in range(k)])
        confusion = confusion.select("annotator_id", "label", *[F.log(F.col(c[i]) / F.sum(c[i]).over(own)).alias(c[i]) for i in range(k)])
        # one row
        prior = post.agg(*[F.log((F.sum(p[i]) + smoothing) / (F.count("*") + k * smoothing)).alias(f"w{i}") for i in range(k)])
        score = votes.join(confusion, ["annotator_id", "label"]).groupBy("case_id").agg(F.count("*").alias("n"), *[F.sum(c[i]).alias(c[i]) for i in range(k)])
        score = score.join(F.broadcast(prior)).select("case_id", "n", *[(F.col(c[i]) + F.col(f"w{i}")).alias(p[i]) for i in range(k)])
        top = F.greatest(*p)
        score = score.select("case_id", "n", *[F.exp(F.col(x) - top).alias(x) for x in p])
        total = sum((F.col(x) for x in p[1:]), F.col(p[0]))
        new = materialized(score.select("case_id", "n", *[(F.col(x) / total).alias(x) for x in p]).join(post.select("case_id", *[F.col(x).alias(f"o{x}") for x in p]), "case_id"))
        moved = new.agg(F.max(F.greatest(*[F.abs(F.col(x) - F.col(f"o{x}")) for x in p]))).first()[0]
        post = new.select("case_id", "n", *p)
        if moved is None or moved <= still:
            break
    return post, confusion


def consensus(votes: DataFrame, labels=LABELS, least: int = 1) -> DataFrame:
    """(case_id, stratum, n_votes, probability) of the cases with at least `least` votes."""
    post, _ = posteriors(votes, labels)
    p = [F.col(f"p{i}") for i in range(len(labels))]
    best = F.greatest(*[F.struct(F.round(x, 9).alias("p"), F.lit(-i).alias("i")) for i, x in enumerate(p)])
    name = F.element_at(F.array(*map(F.lit, labels)), 1 - best["i"])
    return post.where(F.col("n") >= least).select("case_id", name.alias("stratum"), F.col("n").alias("n_votes"), best["p"].alias("probability"))


def fleiss_kappa(votes: DataFrame, labels=LABELS) -> DataFrame:
    """One row: (cases, votes, observed, expected, kappa) over the cases with two or more votes; null where undefined."""
    k = len(labels)
    n = [F.col(f"n{i}") for i in range(k)]
    case = votes.groupBy("case_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == i).alias(f"n{i}") for i in range(k)]).where("n > 1")
    agree = sum((x * (x - 1) for x in n), F.lit(0)) / (F.col("n") * (F.col("n") - 1))
    row = case.agg(F.count("*").alias("cases"), F.sum("n").alias("votes"), F.avg(agree).alias("observed"), *[F.sum(x).alias(f"n{i}") for i, x in enumerate(n)])
    expected = sum((F.pow(F.col(f"n{i}") / F.col("votes"), 2) for i in range(k)), F.lit(0.0))
    row = row.select("cases", "votes", F.round("observed", 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.try_divide(F.col("observed") - expected, 1 - expected), 6).alias("kappa"))
    return row


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(usable_drafts(table(spark, sf_dir, "annotation_draft")), least=3).select("case_id", "stratum")


def p7_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per annotator: usable drafts and the estimated share of right labels, weighted by how often each label is true."""
    votes = materialized(usable_drafts(table(spark, sf_dir, "annotation_draft")))
    post, confusion = posteriors(votes)
    k = len(LABELS)
    prior = post.agg(*[F.avg(f"p{i}").alias(f"w{i}") for i in range(k)])
    right = F.coalesce(*[F.when(F.col("label") == i, F.exp(f"c{i}") * F.col(f"w{i}")) for i in range(k)])
    counts = votes.groupBy("annotator_id").agg(F.count("*").alias("drafts"))
    # one row of weights
    return confusion.join(F.broadcast(prior)).groupBy("annotator_id").agg(F.round(F.sum(right), 4).alias("reliability")).join(counts, "annotator_id")


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement, next to the disagreements and exclusions reported."""
    kappa = fleiss_kappa(usable_drafts(table(spark, sf_dir, "annotation_draft")))
    report = table(spark, sf_dir, "dataset_split_report").distinct()
    sums = report.agg(F.sum("initial_disagreements").cast("bigint").alias("initial_disagreements"), F.sum("uncertain_exclusions").cast("bigint").alias("uncertain_exclusions"))
    return kappa.join(sums)  # one row each


_PLAIN = "lower(regexp_replace(trim(stratum), '[ _-]+', '_', 'g'))"
SQL = {
    "p7_agreement": f"""
        with last as (
            select case_id, annotator_id, {_PLAIN} label, annotation_uncertain,
                   row_number() over (partition by case_id, annotator_id order by request_timestamp desc nulls last, draft_id desc) nth
            from annotation_draft where case_id is not null and annotator_id is not null),
        votes as (select case_id, label from last where nth = 1 and not coalesce(annotation_uncertain, false) and label in ({', '.join(f"'{x}'" for x in LABELS)})),
        cell as (select case_id, label, count(*) c from votes group by all),
        cases as (select case_id, sum(c) n, sum(c * (c - 1)) same from cell group by all having sum(c) > 1),
        kept as (select cell.* from cell join cases using (case_id)),
        e as (select sum(power(s / t, 2)) expected from (select label, sum(c)::double s, (select sum(c) from kept)::double t from kept group by label)),
        o as (select count(*) cases, sum(n)::bigint votes, avg(same / (n * (n - 1))) observed from cases),
        r as (select sum(initial_disagreements)::bigint initial_disagreements, sum(uncertain_exclusions)::bigint uncertain_exclusions from (select distinct * from dataset_split_report))
        select cases, votes, round(observed, 6) observed, round(expected, 6) expected, round((observed - expected) / (1 - expected), 6) kappa, initial_disagreements, uncertain_exclusions
        from o, e, r"""
}
