"""Queries of annotation: validity of drafts and cases, slots, anonymous drafts, messages, requests, pages referred to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.govern import LABELS
from ..sources.tables import pages, table

#: Characters of a request at most (none is cut: a larger one is refused), and drafts asked for a case.
MOST_CHARS, SLOTS = 1500, 3
#: Fixed value: the stratum that needs evidence on two pages.
ACROSS = "cross_page_clause"


def _drafts(spark, sf_dir) -> DataFrame:
    plain = F.regexp_replace(F.lower(F.trim("stratum")), "[ -]", "_")
    return table(spark, sf_dir, "annotation_draft").withColumn("label", plain).distinct()


def _cases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "silver_case").distinct()


def _spans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "evidence_span").distinct()


def _yes(c) -> F.Column:
    return F.coalesce(F.col(c), F.lit(False))


def draft_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft as valid, uncertain, or invalid with the first reason; an invalid draft counts as uncertain."""
    d = _drafts(spark, sf_dir)
    why = (
        F.when(F.col("case_id").isNull(), "case").when(F.col("annotator_id").isNull(), "annotator").when(F.coalesce("retry_count", F.lit(0)) < 0, "retries")
        .when(F.coalesce(F.col("prompt_tokens") + F.col("completion_tokens"), F.lit(-1)) < 0, "tokens")
        .when(~_yes("annotation_uncertain") & ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label")
    )
    return d.select("draft_id", F.when(why.isNotNull(), "invalid").when(_yes("annotation_uncertain"), "uncertain").otherwise("valid").alias("status"), why.alias("reason")).distinct()


def frozen_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each case breaks, in a fixed order: evidence as the case is certain or not, pages of clauses across pages, the outcome's state, exact spans, hard negatives."""
    s = _spans(spark, sf_dir).join(pages(spark, sf_dir, "text").drop("page_id"), ["source_id", "page_number"], "left")
    size, here = F.length("text"), F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    exact = F.coalesce((F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")) & (F.col("end_char") <= size) & (here == F.col("quote")), F.lit(False))
    own = s.groupBy("case_id").agg(
        F.count_if(F.col("span_kind") == "evidence").alias("evidence"), F.count_if(F.col("span_kind") == "hard_negative").alias("negative"),
        F.count_distinct(F.when(F.col("span_kind") == "evidence", F.col("page_number"))).alias("n_pages"), F.count_if(~exact).alias("inexact"),
    )
    c = _cases(spark, sf_dir).join(own, "case_id", "left").fillna(0, ["evidence", "negative", "n_pages", "inexact"])
    unsure, both = _yes("annotation_uncertain"), _yes("initial_disagreement") & _yes("adjudicated")
    outcome = F.coalesce("annotation_outcome", F.lit(""))
    why = (
        F.when(unsure & (F.col("evidence") > 0), "evidence_of_uncertain").when(~unsure & (F.col("evidence") == 0), "no_evidence")
        .when(~unsure & (F.coalesce("stratum", F.lit("")) == ACROSS) & (F.col("n_pages") < 2), "one_page")
        .when(unsure & ~(both & (outcome == "annotation_uncertain")), "state")
        .when(~unsure & (outcome == "agreed") & (_yes("initial_disagreement") | _yes("adjudicated")), "state")
        .when(~unsure & (outcome == "adjudicated") & ~both, "state").when(~unsure & ~outcome.isin("agreed", "adjudicated"), "outcome")
        .when(F.col("inexact") > 0, "inexact_span")
        .when((F.coalesce("hard_negative_category", F.lit("")) != "") != (F.col("negative") > 0), "hard_negative").otherwise("valid")
    )
    return c.select("case_id", why.alias("status"))


def unique_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, identifiers that are empty, and those that stand for different records."""
    out = None
    for name, key in (("silver_case", "case_id"), ("annotation_draft", "draft_id"), ("evidence_span", "span_id")):
        t = table(spark, sf_dir, name).distinct().groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
        blank = F.coalesce(F.trim("key"), F.lit("")) == ""
        one = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("identifiers"), F.count_if(blank).alias("blank"), F.count_if(F.col("n") > 1).alias("ambiguous"))
        out = one if out is None else out.unionByName(one)
    return out


def request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case: slots asked for and answered, whether every slot was answered once, and the binding: a single answer to a single slot counts whatever slot it names."""
    d = table(spark, sf_dir, "annotation_draft").where("case_id is not null").select("case_id", "slot_id", "annotator_id").distinct()
    n = d.groupBy("case_id").agg(F.count("*").alias("answers"), F.count_distinct("slot_id").alias("slots"), F.count_if(F.col("slot_id").isNull()).alias("unnamed"))
    bound = F.when((F.col("answers") == 1), "single").when((F.col("slots") == F.col("answers")) & (F.col("unnamed") == 0), "by_slot").otherwise("mismatch")
    return n.select("case_id", "answers", "slots", (F.col("slots") >= SLOTS).alias("all_slots"), bound.alias("binding"))


def case_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message made of each case: its question and the quotes of its evidence in order; its hash, its size, and whether it's refused as too large."""
    q = _spans(spark, sf_dir).where("span_kind = 'evidence'")
    line = F.concat(F.lit("["), F.col("page_number").cast("string"), F.lit("] "), F.coalesce("quote", F.lit("")))
    # a case has a few spans
    own = q.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "start_char", "span_id", line.alias("line")))).alias("lines"))
    c = _cases(spark, sf_dir).select("case_id", F.coalesce("question", F.lit("")).alias("question")).distinct().join(own, "case_id", "left")
    body = F.array_join(F.coalesce(F.transform("lines", lambda x: x["line"]), F.expr("cast(array() as array<string>)")), "\n")
    c = c.select("case_id", F.concat("question", F.lit("\n\n"), body).alias("message"))
    return c.select("case_id", F.length("message").alias("n_chars"), F.sha2("message", 256).alias("sha256"), (F.length("message") > MOST_CHARS).alias("refused"))


def anonymous_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as a third annotator sees them: without annotator, model and times, in an order drawn from the case's hash (the parity of its last digit)."""
    d = _drafts(spark, sf_dir).where("case_id is not null and annotator_id is not null").select("case_id", "draft_id", "annotator_id", "label", _yes("annotation_uncertain").alias("uncertain"))
    bit = F.conv(F.substring(F.sha2("case_id", 256), -1, 1), 16, 10).cast("int") % 2
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("annotator_id", "draft_id"))
    two = d.withColumn("nth", nth).where("nth <= 2")
    first = (F.col("nth") == 1) == (bit == 0)
    return two.select("case_id", F.when(first, "first").otherwise("second").alias("draft"), "label", "uncertain")


def request_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical record of each draft's request, and its hash; requests of one hash are alike."""
    d = _drafts(spark, sf_dir).select("draft_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("case_id", "model_id", "prompt_version", "slot_id")])
    return d.select("draft_id", F.sha2(F.to_json(F.struct("case_id", "model_id", "prompt_version", "slot_id")), 256).alias("request_sha256")).distinct()


def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case the pages its spans stand on, in order, and an id for each citation."""
    s = _spans(spark, sf_dir).where("case_id is not null")
    ids = F.concat_ws(":", "source_id", "page_number", "start_char", "end_char")
    return s.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("page_number")).cast("array<string>"), ",").alias("pages"), F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256).alias("citations"))


def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of quality note stands, over pages; the kind is what stands before a colon."""
    n = pages(spark, sf_dir, "quality_notes").select("page_id", F.explode("quality_notes").alias("note")).where("note is not null")
    return n.groupBy(F.substring_index("note", ":", 1).alias("kind")).agg(F.count("*").alias("notes"), F.count_distinct("page_id").alias("n_pages"))


def page_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, whether all its spans hold: within their page, not empty, on a page that exists, and exact; one row a source with spans."""
    s = _spans(spark, sf_dir).join(pages(spark, sf_dir, "text").select("source_id", "page_number", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there")), ["source_id", "page_number"], "left")
    here = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    flags = {"page_exists": F.col("there"), "not_empty": F.col("end_char") > F.col("start_char"), "within_page": (F.col("start_char") >= 0) & (F.col("end_char") <= F.length("text")), "exact": here == F.col("quote")}
    return s.where("source_id is not null").groupBy("source_id").agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


QUERIES = {f.__name__: f for f in (draft_validity, frozen_cases, unique_identifiers, request_slots, case_messages, anonymous_drafts, request_hashes, cited_pages, note_counts, page_invariants)}

_D = "d as (select distinct *, regexp_replace(lower(trim(stratum)), '[ -]', '_', 'g') as lbl from annotation_draft)"
_PG = "pg as (select distinct on (page_id) * from document_page)"
_EXACT = "coalesce(start_char >= 0 and end_char > start_char and end_char <= length(text) and substring(text, start_char + 1, end_char - start_char) = quote, false)"
_LIST = "(" + ", ".join(f"'{x}'" for x in LABELS) + ")"
SQL = {
    "draft_validity": f"""with {_D}, r as (select draft_id, annotation_uncertain u, case when case_id is null then 'case' when annotator_id is null then 'annotator' when coalesce(retry_count, 0) < 0 then 'retries'
            when coalesce(prompt_tokens + completion_tokens, -1) < 0 then 'tokens' when not coalesce(annotation_uncertain, false) and not coalesce(lbl in {_LIST}, false) then 'label' end reason from d)
        select distinct draft_id, case when reason is not null then 'invalid' when u then 'uncertain' else 'valid' end status, reason from r""",
    "frozen_cases": f"""with {_PG}, s as (select distinct * from evidence_span),
        o as (select case_id, count_if(span_kind = 'evidence') e, count_if(span_kind = 'hard_negative') n, count(distinct case when span_kind = 'evidence' then s.page_number end) p, count_if(not {_EXACT}) x
              from s left join pg on pg.source_id = s.source_id and pg.page_number = s.page_number group by 1),
        c as (select k.case_id, coalesce(annotation_uncertain, false) u, coalesce(initial_disagreement, false) i, coalesce(adjudicated, false) a, coalesce(annotation_outcome, '') w, coalesce(stratum, '') st, coalesce(hard_negative_category, '') h,
                coalesce(e, 0) e, coalesce(n, 0) n, coalesce(p, 0) p, coalesce(x, 0) x from (select distinct * from silver_case) k left join o on o.case_id = k.case_id)
        select case_id, case when u and e > 0 then 'evidence_of_uncertain' when not u and e = 0 then 'no_evidence' when not u and st = '{ACROSS}' and p < 2 then 'one_page'
            when u and not (i and a and w = 'annotation_uncertain') then 'state' when not u and w = 'agreed' and (i or a) then 'state' when not u and w = 'adjudicated' and not (i and a) then 'state'
            when not u and w not in ('agreed', 'adjudicated') then 'outcome' when x > 0 then 'inexact_span' when (h <> '') <> (n > 0) then 'hard_negative' else 'valid' end status from c""",
    "unique_identifiers": " union all ".join(
        f"select '{t}' table_name, count(*) identifiers, count_if(coalesce(trim(k), '') = '')::bigint blank, count_if(n > 1)::bigint ambiguous from (select {k}::varchar k, count(*) n from (select distinct * from {t}) group by 1)"
        for t, k in (("silver_case", "case_id"), ("annotation_draft", "draft_id"), ("evidence_span", "span_id"))
    ),
    "request_slots": f"""with n as (select case_id, count(*) answers, count(distinct slot_id) slots, count_if(slot_id is null) z from (select distinct case_id, slot_id, annotator_id from annotation_draft where case_id is not null) group by 1)
        select case_id, answers, slots, slots >= {SLOTS} all_slots, case when answers = 1 then 'single' when slots = answers and z = 0 then 'by_slot' else 'mismatch' end binding from n""",
    "case_messages": f"""with o as (select case_id, string_agg('[' || page_number || '] ' || coalesce(quote, ''), chr(10) order by page_number, start_char, span_id) b from (select distinct * from evidence_span where span_kind = 'evidence') group by 1),
        m as (select c.case_id, question || chr(10) || chr(10) || coalesce(b, '') msg from (select distinct case_id, coalesce(question, '') question from silver_case) c left join o on o.case_id = c.case_id)
        select case_id, length(msg)::int n_chars, sha256(msg) sha256, length(msg) > {MOST_CHARS} refused from m""",
    "anonymous_drafts": f"""with {_D}, t as (select case_id, lbl, coalesce(annotation_uncertain, false) u, row_number() over (partition by case_id order by annotator_id, draft_id) nth from d where case_id is not null and annotator_id is not null)
        select case_id, case when (nth = 1) = (('0x' || right(sha256(case_id), 1))::int % 2 = 0) then 'first' else 'second' end draft, lbl as "label", u uncertain from t where nth <= 2""",
    "request_hashes": f"""with {_D} select distinct draft_id, sha256(json_object('case_id', coalesce(case_id, ''), 'model_id', coalesce(model_id, ''), 'prompt_version', coalesce(prompt_version, ''), 'slot_id', coalesce(slot_id, ''))::varchar) request_sha256 from d""",
    "cited_pages": """with s as (select distinct case_id, page_number, concat_ws(':', source_id, page_number, start_char, end_char) id from evidence_span where case_id is not null)
        select case_id, array_to_string(list_sort(list_distinct(list(page_number))), ',') pages, sha256(array_to_string(list_sort(list_distinct(list(id))), chr(10))) citations from s group by 1""",
    "note_counts": f"""with {_PG}, n as (select page_id, unnest(quality_notes) note from pg) select split_part(note, ':', 1) kind, count(*) notes, count(distinct page_id) n_pages from n where note is not null group by 1""",
    "page_invariants": f"""with {_PG}, s as (select distinct * from evidence_span)
        select s.source_id, bool_and(pg.page_number is not null) page_exists, bool_and(coalesce(end_char > start_char, false)) not_empty, bool_and(coalesce(start_char >= 0 and end_char <= length(coalesce(text, '')) and pg.page_number is not null, false)) within_page,
            bool_and(coalesce(pg.page_number is not null and substring(coalesce(text, ''), start_char + 1, end_char - start_char) = quote, false)) exact
        from s left join pg on pg.source_id = s.source_id and pg.page_number = s.page_number where s.source_id is not null group by 1""",
}
