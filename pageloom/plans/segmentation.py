"""Queries of segmentation: units, headings, titles, edges, sentences, tiling, continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment
from ..sources.tables import pages, table


def legacy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of greedy paragraph packing."""
    u = segment.legacy_units(pages(spark, sf_dir, "text"))
    return u.select("source_id", "page_number", "part", F.length("unit").alias("n_chars"), F.sha2("unit", 256).alias("sha256"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are headings, numbered (high) or standing alone (medium)."""
    return segment.line_rows(pages(spark, sf_dir, "text")).where("confidence is not null")


def title_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title each page stands under at its end: the latest heading up to it."""
    p = pages(spark, sf_dir)
    last = segment.line_rows(pages(spark, sf_dir, "text")).where("title is not null").groupBy("source_id", "page_number").agg(F.max_by("title", "line_no").alias("title"))
    return segment.carried(p.join(last, ["source_id", "page_number"], "left"), "source_id", "page_number", "title").select("page_id", F.col("carried").alias("title"))


def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone headings that are the first or last line of several pages of a source."""
    return segment.rejected_lines(pages(spark, sf_dir, "text"))


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the sentence pieces, and whether they make up the page again."""
    s = segment.sentences(F.coalesce("text", F.lit("")))
    p = pages(spark, sf_dir, "text").select("page_id", F.coalesce("text", F.lit("")).alias("text"), s.alias("s"))
    return p.select("page_id", F.size("s").alias("n_pieces"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"), (F.array_join("s", "") == F.col("text")).alias("whole"))


def span_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in order within a page, with gap to and overlap with what came before."""
    s = table(spark, sf_dir, "evidence_span").select("span_id", "source_id", "page_number", "start_char", "end_char").distinct()
    before = F.max("end_char").over(Window.partitionBy("source_id", "page_number").orderBy("start_char", "end_char", "span_id").rowsBetween(Window.unboundedPreceding, -1))
    x = s.withColumn("before", F.coalesce(before, F.lit(0)))
    return x.select("span_id", F.greatest(F.col("start_char") - F.col("before"), F.lit(0)).alias("gap"), F.greatest(F.col("before") - F.col("start_char"), F.lit(0)).alias("overlap"))


def adjacent_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each page's end running on into the next page's start: an open end, a start in the middle, both long enough.

    Only the two edges of a page travel to its neighbour, not its text.
    """
    t = T.stripped(F.coalesce("text", F.lit("")))
    p = pages(spark, sf_dir, "text").select("page_id", "source_id", "page_number", F.substring(t, -40, 40).alias("tail"), F.substring(t, 1, 40).alias("head"))
    nxt = p.select("source_id", (F.col("page_number") - 1).alias("page_number"), F.col("page_id").alias("next_id"), F.col("head").alias("next_head"))
    j = p.join(nxt, ["source_id", "page_number"])
    score = (
        F.when(~F.col("tail").rlike("[。！？!?；;.：:]$"), 2).otherwise(0)
        + F.when(F.col("next_head").rlike("^[a-zà-ÿ，,、；;）)]"), 2).otherwise(0)
        - F.when(F.col("next_head").rlike("^(第[一二三四五六七八九十百0-9]+条|[0-9]+\\.[0-9]+ |[（(][一二三四五六七八九十]+[）)])"), 3).otherwise(0)
        + F.when((F.length("tail") >= 20) & (F.length("next_head") >= 20), 1).otherwise(0)
    )
    return j.select("page_id", "next_id", F.when((F.col("tail") == "") | (F.col("next_head") == ""), -100).otherwise(score).alias("score"))


def clause_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of clauses that may run over pages, as spans of the pages."""
    return segment.clause_units(pages(spark, sf_dir, "text", "quality_notes"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every page with its confidence: its own first heading, or the title of the pages before (low)."""
    return segment.page_titles(pages(spark, sf_dir, "text"))


def low_confidence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the lines that hold a title but aren't headings."""
    m = segment.title_mentions(pages(spark, sf_dir, "text")).where("not heading")
    return m.groupBy("source_id", "page_number").agg(F.count("*").alias("mentions"))


def compound_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections' titles of documents that hold more than one title of the lexicon."""
    n = sum((F.contains("section_title", F.lit(t)).cast("int") for t in segment.TITLES), F.lit(0))
    return table(spark, sf_dir, "documents").where("section_title is not null").select("doc_id", n.alias("titles")).where("titles > 1")


def heading_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page whose first line is its heading: the text without it, as length and hash."""
    p = pages(spark, sf_dir, "text")
    first = segment.line_rows(p).where("line_no = 1").select("source_id", "page_number", F.col("line").alias("heading"))
    body = segment.without_heading(F.col("text"), F.col("heading"))
    return p.join(first, ["source_id", "page_number"]).select("page_id", F.length(body).alias("n_chars"), F.sha2(body, 256).alias("sha256"))


def best_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the best score of two adjacent pages, -100 where it has none."""
    p = pages(spark, sf_dir).select("page_id", "source_id")
    s = adjacent_continuity(spark, sf_dir).select("page_id", "score")
    return p.join(s, "page_id", "left").groupBy("source_id").agg(F.coalesce(F.max("score"), F.lit(-100)).alias("best"))


#: What is counted in a window, its weight, and how often it counts at most.
COUNTED = (("。！？；.!?;", 2, 8), (("如果", "若", "当", "条件", "等待期", "观察期", "if ", "when "), 3, 5), (("给付", "承担", "赔付", "豁免", "终止", "we pay", "ends"), 3, 5))


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each page as a window of several sentences with conditions and outcomes; each kind counts up to its bound."""
    t = T.collapsed(F.coalesce("text", F.lit("")))
    score = sum((F.least(T.occurrences(F.col("t"), words), F.lit(most)) * weight for words, weight, most in COUNTED), F.lit(0))
    return pages(spark, sf_dir, "text").select("page_id", t.alias("t")).select("page_id", score.cast("int").alias("score"))


def tiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page with units: whether the units' windows start where the one before ends (or overlap it) and end at the page's end."""
    size = segment.SIZE
    step = size - segment.OVERLAP
    p = pages(spark, sf_dir, "text").where("text <> ''").select("page_id", F.length("text").alias("n"))
    u = p.select("page_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - segment.OVERLAP - 1, F.lit(0)), F.lit(step))).alias("start"))
    u = u.withColumn("end", F.least(F.col("start") + size, F.col("n")))
    before = F.max("end").over(Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    x = u.withColumn("gap", F.col("start") > F.coalesce(before, F.lit(0)))
    return x.groupBy("page_id").agg(F.count("*").alias("units"), (~F.bool_or("gap")).alias("tiled"), (F.max("end") == F.max("n")).alias("ends"))


QUERIES = {f.__name__: f for f in (legacy_units, heading_lines, title_carry_forward, repeated_edge_lines, sentence_units, span_tiling, adjacent_continuity, clause_units, page_titles, low_confidence_mentions, compound_titles, heading_bodies, best_continuity, window_scores, tiling_check)}

_P = "(select distinct on (page_id) * from document_page)"
_S, _B = T.SPACE, T.BREAK
_STRIP = f"regexp_replace({{}}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_N, _O = segment.SIZE, segment.OVERLAP
_STEP = _N - _O
_TITLES = "[" + ", ".join(f"'{t}'" for t in sorted(segment.TITLES, key=lambda t: (-len(t), t))) + "]"


def _title(line: str, numbered: bool) -> str:
    rest = f"ltrim(substring({line}, length(t) + 1))"
    shape = f"({rest} = '' or contains('{segment.SUFFIX}', left({rest}, 1)) or left({rest}, 1) in {segment.CONNECTORS})"
    short = "" if numbered else f" and length({rest}) <= {segment.SHORT_SUFFIX}"
    return f"list_filter({_TITLES}, lambda t: starts_with({line}, t) and {shape}{short})[1]"


def _part(line: str, group: int) -> str:
    return "case " + " ".join(f"when regexp_matches({line}, '{p}') then regexp_extract({line}, '{p}', {group})" for p in segment.NUMBERED) + " end"


_BARE = r"regexp_replace(line, '\s+[0-9]+\s*$', '')"
_LINES = f"""l0 as (select source_id, page_number, unnest(list_zip(ls, range(1, len(ls) + 1))) z from (select source_id, page_number, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[{_B}]') ls from {_P})),
    l1 as (select source_id, page_number, z[2]::int line_no, {_STRIP.format('z[1]')} line from l0),
    l2 as (select *, {_part('line', 1)} num, {_part('line', 2)} np, {_part(_BARE, 2)} bp from l1 where line <> ''),
    l3 as (select *, {_title('np', True)} by_number, case when num is null then {_title('line', False)} end alone,
           regexp_matches(line, '(?:\\.{{3,}}|…{{2,}}|·{{3,}})\\s*[0-9]+\\s*$') or (regexp_matches(line, '^.+\\s+[0-9]+\\s*$') and bp is not null and coalesce({_title('bp', True)}, '') <> '') dir from l2),
    hl as (select source_id, page_number, line_no, line, case when not dir and by_number is not null then 'high' when not dir and alone is not null then 'medium' end confidence,
           case when not dir then coalesce(by_number, alone) end title from l3)"""
_NONBLANK = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[{_B}]'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1:{segment.FIRST_LINES}]"
_HEADED = _LINES.replace(f"regexp_split_to_array(coalesce(text, ''), '\\r\\n|[{_B}]')", _NONBLANK)
PAGE_TITLES_SQL = _HEADED.replace("l0 as", "t0 as").replace("from l0", "from t0").replace("l1 as", "t1 as").replace("from l1", "from t1").replace("l2 as", "t2 as").replace("from l2", "from t2").replace("l3 as", "t3 as").replace("from l3", "from t3").replace("hl as", "th as") + f""",
    hf as (select source_id, page_number, min_by(title, line_no) title, min_by(confidence, line_no) confidence from th where title is not null group by 1, 2),
    pt as (select p.source_id, p.page_number, last_value(hf.title ignore nulls) over (partition by p.source_id order by p.page_number rows between unbounded preceding and current row) title, coalesce(hf.confidence, 'low') confidence
           from {_P} p left join hf on hf.source_id = p.source_id and hf.page_number = p.page_number)"""
_TIMES = lambda words: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)
_WINDOW = " + ".join(f"least({_TIMES(w)}, {m}) * {k}" for w, k, m in COUNTED)
SQL = {
    "page_titles": f"with {PAGE_TITLES_SQL} select * from pt",
    "low_confidence_mentions": f"""with {_LINES} select source_id, page_number, count(*) mentions from hl where confidence is null and ({' or '.join(f"contains(line, '{t}')" for t in segment.TITLES)}) group by 1, 2""",
    "compound_titles": f"""select * from (select doc_id, ({' + '.join(f"contains(section_title, '{t}')::int" for t in segment.TITLES)})::int titles from documents where section_title is not null) where titles > 1""",
    "heading_bodies": f"""with {_LINES}, x as (select p.page_id, p.text, hl.line from {_P} p join hl on hl.source_id = p.source_id and hl.page_number = p.page_number and line_no = 1 where confidence is not null),
        y as (select page_id, case when contains(text, chr(10)) and {_STRIP.format("split_part(text, chr(10), 1)")} = {_STRIP.format('line')} then {_STRIP.format("substring(text, length(split_part(text, chr(10), 1)) + 2)")} else text end b from x)
        select page_id, length(b)::int n_chars, sha256(b) sha256 from y""",
    "window_scores": f"""with p as (select page_id, regexp_replace(regexp_replace(coalesce(text, ''), '[{_S}]+', ' ', 'g'), '^ | $', '', 'g') t from {_P}) select page_id, ({_WINDOW})::int score from p""",
    "tiling_check": f"""with p as (select page_id, length(text) n from {_P} where text <> ''), u as (select page_id, n, unnest(range(0, greatest(n - {_O}, 1), {_STEP})) s from p),
        w as (select *, least(s + {_N}, n) e, max(least(s + {_N}, n)) over (partition by page_id order by s rows between unbounded preceding and 1 preceding) b from u)
        select page_id, count(*) units, bool_and(s <= coalesce(b, 0)) tiled, max(e) = max(n) "ends" from w group by 1""",
    "legacy_units": f"""
        with p as (select source_id, page_number, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') ps from {_P}),
        r as (select source_id, page_number, list_reduce(list_transform(ps, lambda x: {{'done': []::varchar[], 'cur': x, 'k': false}}), lambda a, b:
            case when length(case when a.cur = '' then b.cur else a.cur || chr(10) || b.cur end) <= {_N}
                 then {{'done': a.done, 'cur': case when a.cur = '' then b.cur else a.cur || chr(10) || b.cur end, 'k': true}}
                 when length(b.cur) <= {_N} then {{'done': case when a.cur = '' then a.done else list_append(a.done, a.cur) end, 'cur': b.cur, 'k': true}}
                 else {{'done': list_concat(case when a.cur = '' then a.done else list_append(a.done, a.cur) end,
                        list_transform(range(0, ceil((length(b.cur) - {_N}) / {_STEP})::bigint), lambda i: substring(b.cur, i * {_STEP} + 1, {_N}))),
                       'cur': substring(b.cur, ceil((length(b.cur) - {_N}) / {_STEP})::bigint * {_STEP} + 1), 'k': true}} end,
            {{'done': []::varchar[], 'cur': '', 'k': false}}) s from p),
        u as (select source_id, page_number, case when s.cur = '' then s.done else list_append(s.done, s.cur) end us from r)
        select source_id, page_number, i::int part, length(us[i])::int n_chars, sha256(us[i]) sha256 from (select *, unnest(range(1, len(us) + 1)) i from u)""",
    "heading_lines": f"with {_LINES} select * from hl where confidence is not null",
    "title_carry_forward": f"""with {_LINES}, last as (select source_id, page_number, max_by(title, line_no) title from hl where title is not null group by 1, 2)
        select page_id, last_value(title ignore nulls) over (partition by source_id order by page_number rows between unbounded preceding and current row) title
        from {_P} p left join last using (source_id, page_number)""",
    "repeated_edge_lines": f"""with {_LINES}, e as (select source_id, page_number, min(line_no) a, max(line_no) b from hl group by 1, 2),
        x as (select hl.source_id, 'header' edge, line, confidence from hl join e on e.source_id = hl.source_id and e.page_number = hl.page_number and line_no = a
              union all select hl.source_id, 'footer', line, confidence from hl join e on e.source_id = hl.source_id and e.page_number = hl.page_number and line_no = b)
        select source_id, edge, line, count(*) n_pages from x where confidence = 'medium' group by 1, 2, 3 having count(*) > 1""",
    "span_tiling": """
        select span_id, greatest(start_char - before, 0)::int gap, greatest(before - start_char, 0)::int overlap from (
            select span_id, start_char, coalesce(max(end_char) over (partition by source_id, page_number order by start_char, end_char, span_id rows between unbounded preceding and 1 preceding), 0) before
            from (select distinct span_id, source_id, page_number, start_char, end_char from evidence_span))""",
    "adjacent_continuity": f"""
        with p as (select page_id, source_id, page_number, right({_STRIP.format("coalesce(text, '')")}, 40) tail, left({_STRIP.format("coalesce(text, '')")}, 40) head from {_P}),
        j as (select a.page_id, b.page_id next_id, a.tail, b.head h from p a join p b on a.source_id = b.source_id and b.page_number = a.page_number + 1)
        select page_id, next_id, case when tail = '' or h = '' then -100 else
            case when not regexp_matches(tail, '[。！？!?；;.：:]$') then 2 else 0 end + case when regexp_matches(h, '^[a-zà-ÿ，,、；;）)]') then 2 else 0 end
            - case when regexp_matches(h, '^(第[一二三四五六七八九十百0-9]+条|[0-9]+\\.[0-9]+ |[（(][一二三四五六七八九十]+[）)])') then 3 else 0 end
            + case when length(tail) >= 20 and length(h) >= 20 then 1 else 0 end end::int score from j""",
}
SQL["best_continuity"] = f"with sc as ({SQL['adjacent_continuity']}) select p.source_id, coalesce(max(score), -100)::int best from {_P} p left join sc using (page_id) group by 1"
