"""Queries of claims and windows: claims of terms and numbers, their support, offsets, page windows, valid cases."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, windows
from ..sources.tables import pages, table


def _spans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "evidence_span").select("span_id", "case_id", "span_kind", "source_id", "page_number", "start_char", "end_char", "quote").distinct()


def term_number_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a term and a number over all pages, and the pages that make them."""
    p = pages(spark, sf_dir, "text").select(F.explode(claims.term_numbers(F.coalesce("text", F.lit("")))).alias("claim"))
    return p.groupBy("claim").agg(F.count("*").alias("pages"))


def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quote, taken as an answer, whether the claims in it stand on the page it cites."""
    s = _spans(spark, sf_dir)
    cited = s.join(pages(spark, sf_dir, "text"), ["source_id", "page_number"]).select(F.col("span_id").alias("answer_id"), F.col("text").alias("cited"))
    return claims.verified(s.select(F.col("span_id").alias("answer_id"), F.col("quote").alias("text")), cited)


#: Terms that mean another.
ALIASES = {"waiting period": "观察期", "Wartezeit": "观察期", "daily benefit": "Tagegeld"}


def term_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a term and a number over all pages, every occurrence and shared numbers counted, terms in one form, and the pages that state them."""
    p = pages(spark, sf_dir, "text").select("page_id", F.explode(claims.term_facts(F.coalesce("text", F.lit("")), aliases=ALIASES)).alias("fact")).distinct()
    return p.groupBy("fact").agg(F.count("*").alias("pages"))


def fact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quote, each fact in it: supported by the page it cites (info), by another page of its source only (warn), or by none (block); and the quote's roll-up, the gravest of them."""
    s = _spans(spark, sf_dir)
    facts = s.select("span_id", "source_id", "page_number", F.explode(claims.term_facts(F.coalesce("quote", F.lit("")), aliases=ALIASES)).alias("fact"))
    asked = facts.select("source_id").distinct()
    known = pages(spark, sf_dir, "text").join(F.broadcast(asked), "source_id", "left_semi").select("source_id", "page_number", F.explode(claims.term_facts(F.coalesce("text", F.lit("")), aliases=ALIASES)).alias("fact")).distinct()
    here = known.withColumn("here", F.lit(True))
    there = known.select("source_id", "fact").distinct().withColumn("there", F.lit(True))
    j = facts.join(here, ["source_id", "page_number", "fact"], "left").join(there, ["source_id", "fact"], "left")
    grave = F.when(F.col("here"), 0).when(F.col("there"), 1).otherwise(2)
    n = j.groupBy("span_id").agg(F.count("*").alias("facts"), F.count_if(F.col("here")).alias("supported"), F.max(grave).alias("worst"))
    return n.select("span_id", "facts", "supported", F.element_at(F.array(*map(F.lit, ("info", "warn", "block"))), F.col("worst") + 1).alias("status"))


#: Words that weaken what stands before them.
HEDGES = ("但", "除非", "可能", "视情况", " but ", " unless ", " may ", " sauf", ", sofern")


def assertive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each quote the part before its first weakening word, terms in one form, and the numbers written in Chinese signs as numerals: lengths and hash."""
    a = T.before_any(T.replaced(F.coalesce("quote", F.lit("")), ALIASES), HEDGES)
    return _spans(spark, sf_dir).select("span_id", a.alias("a")).select("span_id", F.length("a").alias("n_chars"), F.sha2("a", 256).alias("sha256"))


def small_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese numerals before a unit of time, as numbers of up to 99; those of other forms are null."""
    p = pages(spark, sf_dir, "text").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([零〇一二两三四五六七八九十百千万]+)(?:日|天|年|个月)"), F.lit(1))).alias("numeral"))
    return p.groupBy("numeral").agg(F.count("*").alias("times")).select("numeral", T.small_number(F.col("numeral")).alias("number"), "times")


def normalized_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of each evidence span in its whitespace-collapsed page."""
    j = _spans(spark, sf_dir).join(pages(spark, sf_dir, "text").drop("page_id"), ["source_id", "page_number"]).where(F.col("end_char") <= F.length("text"))
    x = windows.normalized_span(F.col("text"), F.col("start_char"), F.col("end_char"))
    return j.select("span_id", x.alias("x")).select("span_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed in order into windows of limited size."""
    p = pages(spark, sf_dir, "text").select("source_id", "page_number", F.length(T.collapsed(F.coalesce("text", F.lit("")))).alias("size"))
    return windows.page_windows(p)


def case_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that break a rule: the first of no evidence, evidence on one page for a clause across pages, adjudicated without disagreement."""
    n = _spans(spark, sf_dir).where("span_kind = 'evidence'").groupBy("case_id").agg(F.count("*").alias("spans"), F.count_distinct("page_number").alias("n_pages"))
    c = table(spark, sf_dir, "silver_case").distinct().join(n, "case_id", "left")
    rule = claims.first_match(
        [
            ("no_evidence", ~F.coalesce("annotation_uncertain", F.lit(False)) & F.col("spans").isNull()),
            ("one_page", (F.col("stratum") == "cross_page_clause") & (F.coalesce("n_pages", F.lit(0)) < 2)),
            ("adjudicated_without_disagreement", F.col("adjudicated") & ~F.col("initial_disagreement")),
        ],
        "valid",
    )
    return c.select("case_id", rule.alias("rule"))


QUERIES = {f.__name__: f for f in (term_facts, fact_verification, assertive_parts, small_numerals, term_number_claims, claim_verification, normalized_spans, page_windows, case_validity)}

_P = "(select distinct on (page_id) * from document_page)"
_E = "(select distinct span_id, case_id, span_kind, source_id, page_number, start_char, end_char, quote from evidence_span)"
_S = T.SPACE


def _claims(text: str) -> str:
    from .comparison import _THOUSANDS

    each = []
    for t in claims.TERMS:
        after = f"substring(f, strpos(f, '{t}') + {len(t)}, {claims.REACH})"
        number = f"regexp_replace(replace(regexp_replace(regexp_extract({after}, '({claims.NUMBER})', 1), '\\s', '', 'g'), ',', ''), '\\.0$', '')"
        each.append(f"case when contains(f, '{t}') and {number} <> '' then '{t}=' || replace({number}, '日', '天') end")
    return f"list_distinct(list_filter(flatten(list_transform(regexp_split_to_array({_THOUSANDS.format(text)}, '{claims.FRAGMENT}'), lambda f: [{', '.join(each)}])), lambda x: x is not null))"


_OFF = f"length(regexp_replace(regexp_replace(substring(text, 1, {{}}), '^[{_S}]+', ''), '[{_S}]+', ' ', 'g'))"
SQL = {
    "term_number_claims": f"select claim, count(*) pages from (select unnest({_claims("coalesce(text, '')")}) claim from {_P}) group by 1",
    "claim_verification": f"""with s as (select span_id answer_id, source_id, page_number, coalesce(quote, '') text from {_E}),
        c as (select answer_id, unnest({_claims('text')}) claim from s),
        k as (select distinct answer_id, unnest({_claims("coalesce(p.text, '')")}) claim from s join {_P} p on p.source_id = s.source_id and p.page_number = s.page_number),
        n as (select c.answer_id, count(*) n_claims, count(k.claim) n_supported from c left join k on k.answer_id = c.answer_id and k.claim = c.claim group by 1)
        select s.answer_id, coalesce(n_claims, 0) n_claims, coalesce(n_supported, 0) n_supported, case when n_claims > 0 and n_claims = n_supported then 'supported' when n_claims > 0 then 'unsupported'
            when {' or '.join(f"contains(text, '{t}')" for t in claims.TERMS)} then 'uncertain' else 'none' end status from s left join n using (answer_id)""",
    "normalized_spans": f"""with j as (select span_id, start_char a, end_char b, text, substring(text, start_char + 1, end_char - start_char) q from {_E} s join {_P} p on p.source_id = s.source_id and p.page_number = s.page_number where end_char <= length(text)),
        k as (select *, a + length(q) - length(regexp_replace(q, '^[{_S}]+', '')) f, b - (length(q) - length(regexp_replace(q, '[{_S}]+$', ''))) - 1 l, regexp_replace(q, '[{_S}]+', '', 'g') <> '' ok from j)
        select span_id, case when ok then {_OFF.format('f')} end::int "start", case when ok then {_OFF.format('l')} + 1 end::int "end" from k""",
    "page_windows": f"""with z as (select source_id, page_number, length(regexp_replace(regexp_replace(coalesce(text, ''), '[{_S}]+', ' ', 'g'), '^ | $', '', 'g')) n from {_P}),
        g as (select source_id, page_number // {windows.BLOCK} blk, list({{'page': page_number, 'n': n}} order by page_number) p from z group by 1, 2),
        r as (select source_id, blk, list_reduce(list_transform(p, lambda x: {{'w': 0, 'used': x.n, 'o': [{{'page': x.page, 'w': 0}}]}}), lambda a, b: case when a.used = 0 or a.used + b.used <= {windows.LIMIT}
            then {{'w': a.w, 'used': a.used + b.used, 'o': list_append(a.o, {{'page': b.o[1].page, 'w': a.w}})}} else {{'w': a.w + 1, 'used': b.used, 'o': list_append(a.o, {{'page': b.o[1].page, 'w': a.w + 1}})}} end) s from g),
        u as (select source_id, blk, unnest(s.o) o from r) select source_id, o.page page_number, blk || ':' || o.w "window" from u""",
    "case_validity": f"""with n as (select case_id, count(*) spans, count(distinct page_number) np from {_E} where span_kind = 'evidence' group by 1)
        select case_id, case when not coalesce(annotation_uncertain, false) and spans is null then 'no_evidence' when stratum = 'cross_page_clause' and coalesce(np, 0) < 2 then 'one_page'
            when adjudicated and not initial_disagreement then 'adjudicated_without_disagreement' else 'valid' end rule from (select distinct * from silver_case) left join n using (case_id)""",
}

_TERMS = sorted(claims.TERMS, key=lambda t: (-len(t), t))
_NUM = r"[0-9]+(?:\.[0-9]+)?\s?(?:元|日|天|%|岁|年|个月|周|days|months|years)"
_PIECE = "(" + "|".join([re.escape(t) for t in _TERMS] + [_NUM, *claims.JOINING, *claims.BOTH]) + ")"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_VALUE = r"regexp_replace(replace(regexp_replace(regexp_replace(b.x, '\s', '', 'g'), '日$', '天'), ',', ''), '\.0$', '')"
_ALIAS = "case " + " ".join(f"when starts_with(f, '{o}=') then '{n}' || substring(f, {len(o) + 1})" for o, n in ALIASES.items()) + " else f end"


def _facts_sql(key: str, text: str, source: str) -> str:
    """Distinct facts of `text` for each `key` of `source`: a fold over the pieces of each fragment."""
    from .comparison import _THOUSANDS

    empty = "{'open': []::varchar[], 'joined': false, 'both': false, 'out': []::varchar[], 'x': ''}"
    step = f"""case when b.x in {_IN(_TERMS)} then {{'open': case when a.joined then list_append(a.open, b.x) else [b.x] end, 'joined': false, 'both': false, 'out': a.out, 'x': ''}}
        when regexp_matches(b.x, '^[0-9]') then {{'open': []::varchar[], 'joined': false, 'both': false, 'out': list_concat(a.out, case when a.joined or len(a.open) = 0 then []::varchar[] else
            list_transform(case when a.both then a.open else a.open[-1:] end, lambda t: t || '=' || {_VALUE}) end), 'x': ''}}
        when b.x in {_IN(claims.BOTH)} then {{'open': a.open, 'joined': a.joined, 'both': true, 'out': a.out, 'x': ''}}
        else {{'open': a.open, 'joined': len(a.open) > 0, 'both': a.both, 'out': a.out, 'x': ''}} end"""
    each = "{'open': []::varchar[], 'joined': false, 'both': false, 'out': []::varchar[], 'x': x}"
    return f"""fr as (select {key}, unnest(regexp_split_to_array({_THOUSANDS.format(text)}, '[。！？!?；;\n]+')) fg from {source}),
        tk as (select {key}, list_transform(regexp_extract_all(fg, '{_PIECE}'), lambda x: {each}) xs from fr),
        fd as (select {key}, unnest(list_reduce(xs, lambda a, b: {step}, {empty}).out) f from tk where len(xs) > 1),
        fa as (select distinct {key}, {_ALIAS} fact from fd)"""


_SP = "(select distinct span_id, source_id, page_number, quote from evidence_span)"
SQL |= {
    "term_facts": f"""with {_facts_sql('page_id', "coalesce(text, '')", _P)} select fact, count(*) pages from fa group by 1""",
    "fact_verification": f"""with {_facts_sql('source_id, page_number', "coalesce(text, '')", _P)}, known as (select * from fa),
        {_facts_sql('span_id, source_id, page_number', "coalesce(quote, '')", _SP).replace('fr as', 'qr as').replace('from fr', 'from qr').replace('tk as', 'qk as').replace('from tk', 'from qk').replace('fd as', 'qd as').replace('from fd', 'from qd').replace('fa as', 'qa as')},
        j as (select qa.span_id, max(case when h.fact is not null then 0 when t.fact is not null then 1 else 2 end) worst, count(*) facts, count_if(h.fact is not null)::bigint supported
              from qa left join known h on h.source_id = qa.source_id and h.page_number = qa.page_number and h.fact = qa.fact left join (select distinct source_id, fact from known) t on t.source_id = qa.source_id and t.fact = qa.fact group by 1)
        select span_id, facts, supported, ['info', 'warn', 'block'][worst + 1] status from j""",
    "assertive_parts": (lambda c: f"""with q as (select distinct span_id, source_id, case_id, span_kind, page_number, start_char, end_char, quote from evidence_span), x as (select span_id, {c} t from q),
        y as (select span_id, t, list_min(list_filter([{', '.join(f"strpos(t, '{h}')" for h in HEDGES)}], lambda i: i > 0)) k from x), z as (select span_id, case when k is null then t else left(t, k - 1) end a from y)
        select span_id, length(a)::int n_chars, sha256(a) sha256 from z""")(functools.reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", ALIASES.items(), "coalesce(quote, '')")),
    "small_numerals": f"""with x as (select unnest(regexp_extract_all(coalesce(text, ''), '([零〇一二两三四五六七八九十百千万]+)(?:日|天|年|个月)', 1)) numeral from {_P}), u as (select numeral, count(*) times from x group by 1),
        d as (select *, map {{'零': 0, '〇': 0, '一': 1, '二': 2, '两': 2, '三': 3, '四': 4, '五': 5, '六': 6, '七': 7, '八': 8, '九': 9}} m, split_part(numeral, '十', 1) a, list_last(string_split(numeral, '十')) b from u)
        select numeral, (case when regexp_full_match(numeral, '[零〇一二两三四五六七八九]*十[零〇一二两三四五六七八九]*') then case when a = '' then 1 else coalesce(m[a], 1) end * 10 + case when b = '' then 0 else coalesce(m[b], 0) end
            when regexp_full_match(numeral, '[零〇一二两三四五六七八九]+') then array_to_string(list_transform(string_split(numeral, ''), lambda c: m[c]), '')::bigint end)::bigint number, times from d""",
}
