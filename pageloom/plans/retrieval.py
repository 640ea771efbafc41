"""Queries of retrieval: statistics, lexical and vector search, fusion, expansion, re-ranking, answers to cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fused, fusion, lexical, ranking, rewrite, segment, vector
from ..sources.tables import SENT_BYTES, pages, table
from .segmentation import PAGE_TITLES_SQL

#: Every row whose id is divisible by this is a query; hits kept of each; candidates kept before re-ranking.
EVERY, TOP, CANDIDATES = 50, 5, 20


def _corpus(spark, sf_dir) -> DataFrame:
    """(doc_id, tokens) of all pages with text."""
    return pages(spark, sf_dir, "text").where("text is not null").select(F.col("page_id").alias("doc_id"), T.lexical_tokens(F.col("text")).alias("tokens"))


def _questions(spark, sf_dir, every: int = EVERY) -> DataFrame:
    """(query_id, question, source_id) of the cases whose number is divisible by `every`."""
    number = F.regexp_extract("case_id", "([0-9]+)$", 1).cast("bigint")
    return table(spark, sf_dir, "silver_case").select(number.alias("query_id"), "question", "source_id").distinct().where((F.col("query_id") % every == 0) & F.col("question").isNotNull())


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of every token."""
    df, totals = lexical.corpus_stats(_corpus(spark, sf_dir))
    return df.join(lexical.weights(df, totals), "token").select("token", F.col("n").alias("df"), F.round("weight", 6).alias("weight"))


def _texts(spark, sf_dir) -> DataFrame:
    """(page_id, start, text) of all pages with text."""
    return pages(spark, sf_dir, "text").where("text is not null").select("page_id", F.lit(0).alias("start"), "text")


def _bm25(spark, sf_dir, k: int, every: int = EVERY) -> DataFrame:
    return ranking.best(_texts(spark, sf_dir), _questions(spark, sf_dir, every), k).select("query_id", F.col("page_id").alias("doc_id"), "score", "rank")


def bm25_topk(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """The best pages for the questions of all cases."""
    return _bm25(spark, sf_dir, TOP, every)


def overlap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with most distinct tokens in common with each question."""
    hits = ranking.best(_texts(spark, sf_dir), _questions(spark, sf_dir), TOP, binary=True)
    return hits.select("query_id", F.col("page_id").alias("doc_id"), "score", "rank")


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null")


def _cosine(spark, sf_dir, k: int) -> DataFrame:
    e = _vectors(spark, sf_dir)
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.cosine_topk(q, e.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector")), k)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, TOP).select("query_id", "unit_id", "score", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a question and of its expansions, by vectors (the best CANDIDATES) and by words (all positive ones count), fused by rank.

    Vectors come from a provider; here it's the one that takes them from a text's hash.
    """
    q = _questions(spark, sf_dir).select("query_id", F.posexplode(rewrite.expansions(F.col("question"))).alias("q_idx", "text"))
    units = pages(spark, sf_dir, "text").where("text is not null").select(F.col("page_id").alias("unit_id"), T.hash_vector(F.col("text")).alias("vector"))
    near = vector.nearest(q.select(F.struct("query_id", "q_idx").alias("query_id"), T.hash_vector(F.col("text")).alias("vector")), units, CANDIDATES)
    near = near.select("query_id.query_id", "query_id.q_idx", F.col("unit_id").alias("page_id"), F.lit(0).alias("start"), "rank", "score")
    asks = q.groupBy(F.col("query_id").alias("ask"), "q_idx").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    f = fused.best(_texts(spark, sf_dir), asks, TOP, near.withColumnRenamed("query_id", "ask"))
    if f is None:  # all hits as rows
        hits = lexical.scores(_corpus(spark, sf_dir), q.select(F.struct("query_id", "q_idx").alias("query_id"), T.lexical_tokens(F.col("text")).alias("tokens")))
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).select("query_id.query_id", "query_id.q_idx", "doc_id", "score", "rank", F.lit("lexical").alias("method"), F.lit(1).alias("method_order"))
        f = fusion.fuse(ranked.unionByName(near.select("query_id", "q_idx", F.col("page_id").alias("doc_id"), "score", "rank", F.lit("vector").alias("method"), F.lit(0).alias("method_order")))).where(F.col("rank") <= TOP)
    else:
        f = f.withColumnsRenamed({"ask": "query_id", "page_id": "doc_id"})
    return f.select("query_id", "doc_id", "final_score", F.col("n_details").cast("bigint").alias("n_details"), fusion.strength(F.col("final_score")).alias("strength"), "rank")


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents and expansions of every case's question."""
    c = table(spark, sf_dir, "silver_case").select("case_id", F.coalesce("question", F.lit("")).alias("question")).distinct()
    return c.select("case_id", F.array_join(rewrite.intents(F.col("question")), ",").alias("intents"), F.array_join(rewrite.expansions(F.col("question")), "|").alias("expansions"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates re-ranked by rules; texts are joined to the candidates only."""
    q = _questions(spark, sf_dir)
    first = _bm25(spark, sf_dir, CANDIDATES).select("query_id", "doc_id", (1 / (fusion.RRF + F.col("rank"))).alias("final_score"), "rank")
    p = pages(spark, sf_dir, "text")
    # CANDIDATES rows a question at most
    sent = F.broadcast if q.count() * CANDIDATES * 64 <= SENT_BYTES else (lambda df: df)
    hits = p.select(F.col("page_id").alias("doc_id"), "source_id", "page_number", "text").join(sent(first), "doc_id")
    hits = segment.page_titles(p).join(hits, ["source_id", "page_number"]).join(sent(q.select("query_id", "question")), "query_id")
    best = rewrite.rerank(hits, TOP)
    return best.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("combined_score", 6).alias("combined_score"), F.array_join("reasons", ",").alias("reasons"), "new_rank")


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a question and its best pages share: ASCII runs, and CJK pairs in both texts, without those that stand within another."""
    q = _questions(spark, sf_dir)
    hits = bm25_topk(spark, sf_dir, EVERY).select("query_id", "doc_id")
    text = pages(spark, sf_dir, "text").select(F.col("page_id").alias("doc_id"), "text")
    j = hits.join(text, "doc_id").join(q.select("query_id", "question"), "query_id")
    shared = F.array_intersect(T.lexical_tokens(F.col("question")), T.lexical_tokens(F.col("text")))
    shown = F.filter(shared, lambda t: t.rlike("^[A-Za-z0-9]+$") | ((F.length(t) >= 2) & F.contains(F.col("question"), t) & F.contains(F.col("text"), t)))
    whole = F.filter(shown, lambda t: ~F.exists(shown, lambda o: (o != t) & F.contains(o, t)))
    return j.select("query_id", "doc_id", F.array_join(F.array_sort(whole), " ").alias("terms"))


def first_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first page of the right source among each question's best, and whether it's within 1 and 3."""
    q = _questions(spark, sf_dir).select("query_id", "source_id")
    src = pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("source_id").alias("hit_source"))
    hits = _bm25(spark, sf_dir, CANDIDATES).select("query_id", "doc_id", "rank").join(src, "doc_id")
    j = q.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("hit_source") == F.col("source_id"), F.col("rank"))).alias("rank"))
    return j.select("query_id", "rank", F.coalesce(F.col("rank") <= 1, F.lit(False)).alias("top1"), F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("top3"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_corpus_stats, overlap_fallback, cosine_topk, rrf_fusion, query_rewrite, rerank_topk, matched_terms, first_match_rank)}

_TOK = f"""list_concat(regexp_extract_all({{0}}, '[A-Za-z0-9]+'), regexp_extract_all({{0}}, '[{T.CJK}]'),
    list_transform(range(1, greatest(len(regexp_extract_all({{0}}, '[{T.CJK}]')), 1)), lambda i: substring(regexp_replace({{0}}, '[^{T.CJK}]', '', 'g'), i::int, 2)))"""
_D = f"d as (select page_id doc_id, {_TOK.format('text')} t from (select distinct on (page_id) * from document_page) where text is not null)"
_CASES = "select distinct regexp_extract(case_id, '([0-9]+)$', 1)::bigint query_id, question, source_id from silver_case where question is not null"
_Q, _Q_ALL = f"q0 as ({_CASES}), q as (select * from q0 where query_id % {EVERY} = 0)", f"q as ({_CASES})"
_STATS = f"""{_D}, tot as (select count(*) n_docs, avg(len(t)) avgdl from d),
    df as (select token, count(*) n from (select unnest(list_distinct(t)) token from d) group by 1),
    w0 as (select token, n, ln(n_docs - n + 0.5) - ln(n + 0.5) raw from df, tot),
    w as (select token, n, case when raw < 0 then {lexical.EPSILON} * (select avg(raw) from w0) else raw end weight from w0)"""
_SCORES = f"""tf as (select doc_id, token, count(*) f, any_value(dl) dl from (select doc_id, len(t) dl, unnest(t) token from d) where token in (select token from qt) group by 1, 2),
    s as (select query_id, doc_id, round(sum(times * weight * f * {lexical.K1 + 1} / (f + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * dl / avgdl))), 6) score
          from tf join w using (token) join qt using (token), tot group by 1, 2 having round(sum(times * weight * f * {lexical.K1 + 1} / (f + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * dl / avgdl))), 6) > 0)"""
_QT = f"qt as (select query_id, token, count(*) times from (select query_id, unnest({_TOK.format('question')}) token from q) group by 1, 2)"
_RANK = "(select *, row_number() over (partition by query_id order by score desc, doc_id)::int rank from s)"
_ANY = lambda c, terms: "(" + " or ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_EXPAND = "list_concat([trim(question)]" + "".join(f", case when {_ANY('question', tr)} then {list(te)} else [] end" for _, tr, te in rewrite.RULES) + ")"
_ORDERED = f"list_filter({_EXPAND}, lambda x, i: list_position({_EXPAND}, x) = i)"
_HASHED = "list_transform(range(8), lambda i: ('0x' || substring(sha256({0}), 1 + 8 * i::int, 8))::bigint / 4294967295.0)"
_DIRECTORY = r"""(len(ls) >= 3 and len(list_filter(ls, lambda x: regexp_matches(x, '(\.{3,}|…)\s*[0-9]+\s*$') or regexp_matches(x, '^\s*(第[一二三四五六七八九十百0-9]+[条章节]|[0-9]+(\.[0-9]+)+)[^。.;；]{0,30}$'))) >= greatest(3, floor(len(ls) / 2)))"""


def _rerank_sql() -> str:
    """Reasons that hold, as a list of strings, over title (ti), text (tx), both, question and confidence (co)."""
    intents = [(n, _ANY("question", t)) for n, t, _ in rewrite.RULES] + [(n, _ANY("question", t)) for n, t in rewrite.MORE_INTENTS]
    added = {n: e for n, _, e in rewrite.RULES}
    rows = []
    for n, has in intents:
        for reason, words in (("title_intent", rewrite.TITLE_WORDS.get(n)), ("wrong_title", rewrite.WRONG_TITLES.get(n))):
            rows += [(reason, f"{has} and {_ANY('ti', words)}")] if words else []
    by = dict(intents)
    rows.append(("definition_title", f"{by['definition']} and ({' or '.join(h for n, h in intents if n != 'definition')}) and {_ANY('ti', rewrite.TITLE_WORDS['definition'])}"))
    rows += [("excluding", f"{by['exclusion']} and {_ANY('bo', rewrite.EXCLUDING)}"), ("granting", f"{by['payment']} and {_ANY('bo', rewrite.GRANTING)}")]
    terms = [(h, [w for w in (*rewrite.TITLE_WORDS.get(n, ()), *added.get(n, ())) if len(w) <= rewrite.TERM]) for n, h in intents]
    rows.append(("exact_term", " or ".join(f"({h} and {_ANY('bo', ws)})" for h, ws in terms if ws)))
    persons = [(f"contains(question, '{p}')", f"contains(bo, '{p}')") for p in rewrite.PERSONS]
    rows.append(("same_person", " or ".join(f"({a} and {b})" for a, b in persons)))
    rows.append(("other_person", f"({' or '.join(a for a, _ in persons)}) and ({' or '.join(f'(not {a} and {b})' for a, b in persons)})"))
    rows.append(("number", "len(list_filter(regexp_extract_all(question, '[0-9]+'), lambda n: contains(bo, n))) > 0"))
    rows.append(("clause_heading", f"regexp_matches(ti, '{rewrite.HEADING}') or regexp_matches(left(tx, {rewrite.HEAD}), '{rewrite.HEADING}')"))
    rows += [("low_confidence", "co = 'low'"), ("directory", _DIRECTORY)]
    return "list_filter([" + ", ".join(f"case when {c} then '{r}' end" for r, c in rows) + "], lambda x: x is not null)"


_WEIGHT = "map {" + ", ".join(f"'{k}': {v}" for k, v in rewrite.WEIGHTS.items()) + "}"
_TITLED = PAGE_TITLES_SQL
SQL = {
    "bm25_corpus_stats": f"with {_STATS} select token, n df, round(weight, 6) weight from w",
    "bm25_topk": f"with {_Q_ALL}, {_STATS}, {_QT}, {_SCORES} select query_id, doc_id, score, rank from {_RANK} where rank <= {TOP}",
    "overlap_fallback": f"""with {_Q}, {_D}, qt as (select distinct query_id, unnest({_TOK.format('question')}) token from q),
        s as (select query_id, doc_id, count(*)::double score from (select distinct doc_id, unnest(t) token from d) join qt using (token) group by 1, 2)
        select query_id, doc_id, score, rank from {_RANK} where rank <= {TOP}""",
    "cosine_topk": f"""
        with s as (select a.vec_id query_id, b.vec_id unit_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id % {EVERY} = 0)
        select query_id, unit_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, unit_id desc)::int rank from s) where rank <= {TOP}""",
    "rrf_fusion": f"""with {_Q.replace('q as', 'q1 as')}, q2 as (select query_id qid, {_ORDERED} x from q1 where trim(question) <> ''),
        q as (select qid || '#' || (i - 1) query_id, x[i] question from (select qid, x, unnest(range(1, len(x) + 1)) i from q2)), {_STATS}, {_QT}, {_SCORES},
        vq as (select query_id, {_HASHED.format('question')} v from q), vd as (select page_id doc_id, {_HASHED.format('text')} v from (select distinct on (page_id) * from document_page) where text is not null),
        vr as (select query_id, doc_id, row_number() over (partition by query_id order by round(list_cosine_similarity(vq.v, vd.v), 6) desc, doc_id desc)::int rank from vq, vd),
        a as (select query_id k, doc_id, rank, 1 m from {_RANK} union all select query_id, doc_id, rank, 0 from vr where rank <= {CANDIDATES}),
        h as (select split_part(k, '#', 1)::bigint query_id, split_part(k, '#', 2)::int q_idx, doc_id, rank, m from a),
        f as (select query_id, doc_id, round(sum(1 / ({fusion.RRF} + rank)), 9) final_score, count(*) n_details, min((q_idx, m, rank)) seen from h group by 1, 2)
        select query_id, doc_id, final_score, n_details, case when final_score >= 0.03 then 'high' when final_score >= 0.015 then 'medium' else 'low' end strength, rank
        from (select *, row_number() over (partition by query_id order by final_score desc, seen, doc_id)::int rank from f) where rank <= {TOP}""",
    "query_rewrite": f"""select case_id, array_to_string(list_filter([{', '.join(f"case when {_ANY('question', tr)} then '{n}' end" for n, tr, _ in rewrite.RULES)}], lambda x: x is not null), ',') intents,
        case when trim(question) = '' then '' else array_to_string({_ORDERED}, '|') end expansions from (select distinct case_id, coalesce(question, '') question from silver_case)""",
    "rerank_topk": f"""with {_Q}, {_STATS}, {_QT}, {_SCORES}, {_TITLED},
        h as (select r.query_id, r.doc_id, r.rank, 1 / ({fusion.RRF} + r.rank) final_score, q.question, coalesce(p.text, '') tx, coalesce(pt.title, '') ti, coalesce(pt.title, '') || chr(10) || coalesce(p.text, '') bo, pt.confidence co,
                list_filter(string_split(p.text, chr(10)), lambda x: trim(x) <> '') ls
              from {_RANK} r join q using (query_id) join (select distinct on (page_id) * from document_page) p on p.page_id = r.doc_id join pt on pt.source_id = p.source_id and pt.page_number = p.page_number where r.rank <= {CANDIDATES}),
        ky as (select *, {_rerank_sql()} why from h),
        wy as (select *, coalesce(list_sum(list_transform(why, lambda x: ({_WEIGHT})[x])), 0)::double rs from ky),
        c as (select *, round(final_score + {rewrite.RERANK_WEIGHT} * greatest(-{rewrite.RERANK_BOUND}, least({rewrite.RERANK_BOUND}, rs)) - case when list_contains(why, 'directory') then {rewrite.DIRECTORY_PENALTY} else 0 end, 9) cs from wy)
        select query_id, doc_id, round(rs, 6) rerank_score, round(cs, 6) combined_score, array_to_string(list_filter(why, lambda x, i: list_position(why, x) = i), ',') reasons, new_rank
        from (select *, row_number() over (partition by query_id order by cs desc, final_score desc, rank)::int new_rank from c) where new_rank <= {TOP}""",
    "matched_terms": f"""with {_Q}, {_STATS}, {_QT}, {_SCORES},
        h as (select r.query_id, r.doc_id, q.question, p.text from {_RANK} r join q using (query_id) join (select distinct on (page_id) * from document_page) p on p.page_id = r.doc_id where r.rank <= {TOP}),
        z as (select query_id, doc_id, list_filter(list_intersect(list_distinct({_TOK.format('question')}), {_TOK.format('text')}), lambda t: regexp_full_match(t, '[A-Za-z0-9]+') or (length(t) >= 2 and contains(question, t) and contains(text, t))) ts from h)
        select query_id, doc_id, array_to_string(list_sort(list_filter(ts, lambda t: len(list_filter(ts, lambda o: o <> t and contains(o, t))) = 0)), ' ') terms from z""",
    "first_match_rank": f"""with {_Q}, {_STATS}, {_QT}, {_SCORES},
        h as (select r.query_id, r.rank, p.source_id from {_RANK} r join (select distinct page_id, source_id from document_page) p on p.page_id = r.doc_id where r.rank <= {CANDIDATES}),
        m as (select q.query_id, min(case when h.source_id = q.source_id then h.rank end) rank from q left join h using (query_id) group by 1)
        select query_id, rank, coalesce(rank <= 1, false) top1, coalesce(rank <= 3, false) top3 from m""",
}
