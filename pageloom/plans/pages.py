"""Queries over pages: quality, normal form, gaps, segments, tokens, vectors, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import pages, table

#: Text shorter than this, or with more than this share of replacement marks, needs recognition.
SHORT, GARBLED = 80, 0.25
#: Characters of a transport segment.
SEGMENT = 600
#: Characters of an excerpt.
EXCERPT = 180
#: Page numbers of a block that is hashed together.
HASHED = 1024


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replacement marks, whether the page needs recognition, and what kind of bad page it is."""
    p = pages(spark, sf_dir, "text", "extraction_method").withColumn("t", F.coalesce("text", F.lit("")))
    ratio = T.garbled_ratio(F.col("t"))
    bad = F.when(ratio <= GARBLED, "ok").when(F.coalesce("extraction_method", F.lit("")) == "ocr", "severe_ocr_uncertainty").otherwise("unreadable_page")
    return p.select("page_id", F.round(ratio, 6).alias("garbled_ratio"), ((F.length(T.stripped(F.col("t"))) < SHORT) | (ratio > GARBLED)).alias("needs_ocr"), bad.alias("quality"))


def page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters of each page's normal form, and its hash."""
    p = pages(spark, sf_dir, "text").select("page_id", T.normalized_page(F.coalesce("text", F.lit(""))).alias("t"))
    return p.select("page_id", F.length("t").alias("n_chars"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).alias("n_lines"), F.sha2("t", 256).alias("sha256"))


def unsafe_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over which a clause must not continue, by reason."""
    note = lambda n: F.coalesce(F.array_contains("quality_notes", n), F.lit(False))
    empty = T.compact(F.coalesce("text", F.lit(""))) == ""
    kind = F.when(empty, "empty_page").when(note("unreadable_page"), "unreadable_page").when(note("severe_ocr_uncertainty"), "severe_ocr_uncertainty")
    return pages(spark, sf_dir, "text", "quality_notes").select("page_id", kind.alias("reason")).where("reason is not null")


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of fixed width of pages whose collapsed text is longer than that; other pages are one segment."""
    p = pages(spark, sf_dir, "text").select("page_id", T.collapsed(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    s = p.select("page_id", "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1, F.lit(SEGMENT))).alias("start"))
    return s.select("page_id", "start", F.sha2(F.substring("t", F.col("start") + 1, F.lit(SEGMENT)), 256).alias("sha256"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lexical tokens by kind."""
    c = F.coalesce("text", F.lit(""))
    n = F.size(T.cjk_characters(c))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.ascii_tokens(c)).alias("n_ascii"), n.alias("n_cjk"), F.greatest(n - 1, F.lit(0)).alias("n_pairs"))


def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors of texts from their hashes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hash_vector(F.coalesce("text", F.lit("")))).alias("dim", "value"))
    return d.select("doc_id", "dim", F.round("value", 9).alias("value"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpt of each page: collapsed, cut at a fixed length, with an ellipsis where cut."""
    t = T.collapsed(F.coalesce("text", F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring("t", 1, EXCERPT), f"[{T.SPACE}]+$", ""), F.lit("..."))
    return pages(spark, sf_dir, "text").withColumn("t", t).select("page_id", F.when(F.length("t") > EXCERPT, cut).otherwise(F.col("t")).alias("excerpt"))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and characters of each source, and the hash over the hashes of its blocks of HASHED page numbers, each over its pages' hashes in page order.

    The pages' texts stay where they are: only hashes are gathered for a source.
    """
    p = pages(spark, sf_dir, "text").select("source_id", "page_number", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["h"])), "\n"), 256).alias("h")
    # hashes of blocks of pages, then of the blocks, so that no source's pages come together
    block = p.groupBy("source_id", F.expr(f"page_number div {HASHED}").alias("at")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), joined(F.collect_list(F.struct(F.col("page_number").alias("at"), "h"))))
    whole = joined(F.collect_list(F.struct("at", "h"))).alias("sha256")
    return block.groupBy("source_id").agg(F.sum("k").alias("n_pages"), F.sum("n").cast("bigint").alias("n_chars"), whole)


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a stable id, their page count, and why one isn't admissible."""
    src = table(spark, sf_dir, "benchmark_source").select("source_id", "source_name", "approval", "approval_reference").distinct()
    n = pages(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n_pages"), F.count_distinct("page_number").alias("n_numbers"))
    j = src.join(n, "source_id", "left")
    why = (
        F.when(~F.coalesce("approval", F.lit("")).isin("approved_public", "approved_project_owned"), "approval")
        .when(T.compact(F.coalesce("approval_reference", F.lit(""))) == "", "reference")
        .when(F.col("n_pages").isNull(), "no_pages").when(F.col("n_pages") != F.col("n_numbers"), "page_numbers").otherwise("admissible")
    )
    return j.select("source_id", T.stable_id("corpus/source", F.col("source_id")).alias("stable_id"), F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), why.alias("status"))


QUERIES = {f.__name__: f for f in (page_quality, page_normalize, unsafe_gaps, page_segments, tokenize_counts, hash_vectors, citations, source_texts, source_inventory)}

_P = "(select distinct on (page_id) * from document_page)"
_S, _B = T.SPACE.replace("'", "''"), T.BREAK
_STRIP = f"regexp_replace({{}}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_COLLAPSE = f"regexp_replace(regexp_replace({{}}, '[{_S}]+', ' ', 'g'), '^ | $', '', 'g')"
_NORMAL = f"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[{_B}]'), lambda x: {_COLLAPSE.format('x')}), lambda x: x <> ''), chr(10))"
SQL = {
    "page_quality": f"""
        with p as (select page_id, coalesce(text, '') t, extraction_method from {_P}),
        r as (select *, case when length(t) > 0 then (length(t) - length(replace(t, '�', ''))) / length(t) else 0.0 end ratio from p)
        select page_id, round(ratio, 6) garbled_ratio, length({_STRIP.format('t')}) < {SHORT} or ratio > {GARBLED} needs_ocr,
               case when ratio <= {GARBLED} then 'ok' when coalesce(extraction_method, '') = 'ocr' then 'severe_ocr_uncertainty' else 'unreadable_page' end quality
        from r""",
    "page_normalize": f"""
        with p as (select page_id, {_NORMAL} t from {_P})
        select page_id, length(t)::int n_chars, case when t = '' then 0 else length(t) - length(replace(t, chr(10), '')) + 1 end::int n_lines, sha256(t) sha256 from p""",
    "unsafe_gaps": f"""
        select * from (select page_id, case when regexp_replace(coalesce(text, ''), '[{_S}]+', '', 'g') = '' then 'empty_page'
            when coalesce(list_contains(quality_notes, 'unreadable_page'), false) then 'unreadable_page'
            when coalesce(list_contains(quality_notes, 'severe_ocr_uncertainty'), false) then 'severe_ocr_uncertainty' end reason from {_P}) where reason is not null""",
    "page_segments": f"""
        with p as (select page_id, {_COLLAPSE.format("coalesce(text, '')")} t from {_P}), s as (select page_id, t, unnest(range(0, length(t), {SEGMENT}))::int "start" from p where t <> '')
        select page_id, "start", sha256(substring(t, "start" + 1, {SEGMENT})) sha256 from s""",
    "tokenize_counts": f"""
        select doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'))::int n_ascii, len(regexp_extract_all(coalesce(text, ''), '[{T.CJK}]'))::int n_cjk,
               greatest(len(regexp_extract_all(coalesce(text, ''), '[{T.CJK}]')) - 1, 0)::int n_pairs from documents""",
    "hash_vectors": """
        select doc_id, dim::int dim, round(('0x' || substring(h, 1 + 8 * dim, 8))::bigint / 4294967295.0, 9) "value"
        from (select doc_id, sha256(coalesce(text, '')) h, unnest(range(8))::int dim from documents)""",
    "citations": f"""
        with p as (select page_id, {_COLLAPSE.format("coalesce(text, '')")} t from {_P})
        select page_id, case when length(t) > {EXCERPT} then regexp_replace(substring(t, 1, {EXCERPT}), '[{_S}]+$', '') || '...' else t end excerpt from p""",
    "source_texts": f"""
        with b as (select source_id, page_number // {HASHED} blk, count(*) k, sum(length(coalesce(text, ''))) n, sha256(string_agg(page_number || ':' || sha256(coalesce(text, '')), chr(10) order by page_number)) h from {_P} group by 1, 2)
        select source_id, sum(k)::bigint n_pages, sum(n)::bigint n_chars, sha256(string_agg(blk || ':' || h, chr(10) order by blk)) sha256 from b group by source_id""",
    "source_inventory": f"""
        with src as (select distinct source_id, source_name, approval, approval_reference from benchmark_source),
        n as (select source_id, count(*) n_pages, count(distinct page_number) n_numbers from {_P} group by 1)
        select src.source_id, 'corpus-source-' || sha256('corpus/source:' || src.source_id) stable_id, coalesce(n_pages, 0)::bigint n_pages,
               case when coalesce(approval, '') not in ('approved_public', 'approved_project_owned') then 'approval'
                    when regexp_replace(coalesce(approval_reference, ''), '[{_S}]+', '', 'g') = '' then 'reference'
                    when n_pages is null then 'no_pages' when n_pages <> n_numbers then 'page_numbers' else 'admissible' end status
        from src left join n on n.source_id = src.source_id""",
}
