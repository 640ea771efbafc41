import json
import math
import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pageloom.config import EngineConfig, differences
from pageloom.functions import text as T
from pageloom.operators import compare, evaluate, fusion, govern, lexical, rewrite, segment, spans, vector
from pageloom.sources import cases, documents, sinks
from pageloom.streaming.arrivals import page_quality_counts


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, " a　b\u2009\nc ", T.compact) == "abc"
    assert one(spark, " a　 b\n\nc ", T.collapsed) == "a b c"
    assert one(spark, "\u3000a\u2028", T.stripped) == "a"
    assert one(spark, "a \x0b\n\n b  c\r\nd", T.normalized_page) == "a\nb c\nd"
    assert one(spark, "1,234,567 and 1,23 and 12,345", T.without_thousands) == "1234567 and 1,23 and 12345"
    assert one(spark, "30.0", T.normalized_number) == "30" and one(spark, "1,000", T.normalized_number) == "1000"
    assert one(spark, "", T.garbled_ratio) == 0 and one(spark, "��ab", T.garbled_ratio) == 0.5
    assert one(spark, "c:\\x\\y.pdf", T.basename) == "y.pdf"
    assert one(spark, "保A1险b 金", T.lexical_tokens) == ["A1", "b", "保", "险", "金", "保险", "险金"]
    assert one(spark, None, T.collapsed) is None


@pytest.mark.parametrize("t, n", [("三十", 30), ("十五", 15), ("二百零三", 203), ("一千二百", 1200), ("三万五千", 35000), ("两百", 200), ("七", 7), ("180", 180), ("abc", None), ("", None), (None, None)])
def test_chinese_number(spark, t, n):
    assert one(spark, t, T.chinese_number) == n


def test_hash_vector(spark):
    import hashlib

    h = hashlib.sha256("条款".encode()).digest()
    want = [int.from_bytes(h[4 * i : 4 * i + 4], "big") / 0xFFFFFFFF for i in range(8)]
    assert one(spark, "条款", T.hash_vector) == want


def pack(text, size, overlap):
    out, cur = [], ""
    for p in [x.strip() for x in re.split(r"\r\n|\n+", text) if x.strip()]:
        if len(cur) + len(p) + bool(cur) <= size:
            cur = f"{cur}\n{p}" if cur else p
            continue
        out += [cur] if cur else []
        while len(p) > size:
            out.append(p[:size])
            p = p[size - overlap :]
        cur = p
    return out + ([cur] if cur else [])


def test_units_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["\n".join("x" * rng.randrange(0, 60) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segment.unit_array(F.col("t"), 40, 7).alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: pack(t, 40, 7) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        segment.unit_array(F.col("t"), 10, 10)


PAGES = [
    ("s", 1, "第一条 观察期限\n等待三十日。期满后承担责任。\n第二条 保障范围 12\n1.2 Riders, notes\nText one. Text two."),
    ("s", 2, "continued text here。\n保单借款\n可以借款。"),
    ("s", 3, ""),
    ("s", 4, "after a gap"),
    ("r", 1, "保障范围\nbody a"), ("r", 2, "保障范围\nbody b"), ("r", 3, "（三）名词解释及其他\n" + "很长的一句话没有停顿" * 30),
]


def pages_df(spark):
    return spark.createDataFrame([(s, n, t, []) for s, n, t in PAGES], "source_id string, page_number int, text string, quality_notes array<string>")


def test_headings(spark):
    got = {(r.source_id, r.page_number, r.line): (r.confidence, r.title) for r in segment.line_rows(pages_df(spark)).where("confidence is not null").collect()}
    assert got[("s", 1, "第一条 观察期限")] == ("high", "观察期限") and got[("s", 1, "1.2 Riders, notes")] == ("high", "Riders")
    assert ("s", 1, "第二条 保障范围 12") not in got  # an entry of a table of contents
    assert got[("s", 2, "保单借款")] == ("medium", "保单借款") and got[("r", 3, "（三）名词解释及其他")] == ("high", "名词解释")
    for (_, _, line), v in got.items():
        assert segment.classify(line) == v
    assert segment.rejected_lines(pages_df(spark)).collect()[0].line == "保障范围"


def test_carried_over_blocks(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", i, f"v{i}" if rng.random() < 0.1 else None) for i in range(300)]
    got = {(r.k, r.o): r.carried for r in segment.carried(spark.createDataFrame(rows, "k string, o int, v string"), "k", "o", "v", block=16).collect()}
    last = {}
    for k, o, v in rows:
        last[k] = v or last.get(k)
        assert got[(k, o)] == last[k]


def test_clause_units_invariants(spark):
    got = segment.clause_units(pages_df(spark), target=60, hard=80).collect()
    text = {(s, n): t for s, n, t in PAGES}
    seen = Counter()
    for r in got:
        assert 0 <= r.start_char < r.end_char <= len(text[(r.source_id, r.page_number)])
        for i in range(r.start_char, r.end_char):
            seen[(r.source_id, r.page_number, i)] += 1
    want = Counter({(s, n, i): 1 for s, n, t in PAGES for i in range(len(t)) if t.strip()})
    assert seen == want  # every character in exactly one unit
    per = {}
    for r in got:
        per.setdefault((r.source_id, r.clause_page, r.clause_start, r.unit), []).append(r)
    for parts in per.values():
        assert len("\n".join(text[(r.source_id, r.page_number)][r.start_char : r.end_char] for r in sorted(parts, key=lambda r: (r.page_number, r.start_char))).strip()) <= 80
    owner = {(r.page_number, r.start_char): (r.clause_page, r.clause_start) for r in got if r.source_id == "s"}
    assert owner[(2, 0)][0] == 1  # continues the clause of the page before
    assert owner[(4, 0)] == (4, 0)  # not beyond the empty page
    assert any(r.window for r in got if r.source_id == "r" and r.page_number == 3)


def test_sentences_make_up_the_text(spark):
    t = "一。二！\n（三）四；five? six\n1. seven"
    s = one(spark, t, segment.sentences)
    assert "".join(s) == t and "一。" in s and any(x.startswith("（三）") for x in s) and one(spark, "", segment.sentences) == []


def test_lexical_scores(spark):
    docs = [(1, "a b a c"), (2, "a d"), (3, "d d e"), (4, ""), (5, "a a a a")]
    tok = {i: t.split() for i, t in docs}
    df = Counter(x for t in tok.values() for x in set(t))
    n, mean = len(tok), sum(map(len, tok.values())) / len(tok)
    raw = {x: math.log(n - c + 0.5) - math.log(c + 0.5) for x, c in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    w = {x: eps if v < 0 else v for x, v in raw.items()}
    q = ["a", "c", "c", "zz"]
    want = {}
    for i, t in tok.items():
        s = sum(w.get(x, 0) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for x in q)
        if s > 0:
            want[i] = round(s, 6)
    d = spark.createDataFrame(docs, "doc_id int, t string").select("doc_id", F.filter(F.split("t", " "), lambda x: x != "").alias("tokens"))
    qs = spark.createDataFrame([(7, q)], "query_id int, tokens array<string>")
    assert {r.doc_id: r.score for r in lexical.scores(d, qs).collect()} == want
    best = lexical.top_k(lexical.overlap(d, qs), 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in best] == [(1, 2.0), (2, 1.0)]


def test_cosine(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).astype(np.float32)
    v[5] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "unit_id bigint, vector array<float>")
    q = df.where("unit_id % 10 in (0, 5)").select(F.col("unit_id").alias("query_id"), "vector")
    got = {}
    for r in vector.cosine_topk(q, df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.unit_id)
    n = np.linalg.norm(v, axis=1)
    n[n == 0] = 1
    s = np.round((v / n[:, None]).astype(float) @ (v / n[:, None]).astype(float).T, 6)
    assert 5 not in got
    for i in got:
        assert got[i][0] == i and got[i] == sorted(range(60), key=lambda j: (-s[i, j], -j))[:4]
    assert vector.cosine_topk(q, df, 0).collect() == []
    plan = vector.cosine_topk(q, df, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_fusion(spark):
    hits = [(1, 0, "vector", 0, 10, 1, 0.9), (1, 0, "lexical", 1, 10, 2, 5.0), (1, 0, "lexical", 1, 11, 1, 6.0), (1, 1, "lexical", 1, 12, 1, 2.0)]
    df = fusion.fuse(spark.createDataFrame(hits, "query_id int, q_idx int, method string, method_order int, doc_id int, rank int, score double"))
    got = {r.doc_id: r for r in df.collect()}
    assert got[10].final_score == round(1 / 61 + 1 / 62, 9) and got[10].rank == 1 and got[11].rank == 2 and got[12].rank == 3 and got[10].vector_score == 0.9


def test_rewrite(spark):
    q = "观察期多久？"
    assert one(spark, q, rewrite.intents) == ["waiting"]
    assert one(spark, q, rewrite.expansions) == [q, "观察期", "waiting period"]
    assert one(spark, "  ", rewrite.expansions) == []
    assert one(spark, "1.1 A ... 3\n1.2 B ... 4\n1.3 C ... 9\n", rewrite.directory_like) and not one(spark, "a\nb\nc", rewrite.directory_like)


def test_spans(spark):
    pages = spark.createDataFrame([("s", 1, "ab  cd ab xy")], "source_id string, page_number int, text string")
    rows = [(1, "s", 1, 0, 2, "ab"), (2, "s", 1, 4, 6, "cd"), (3, "s", 1, 4, 6, "zz"), (4, "s", 9, 0, 1, "a"), (5, "s", 1, 10, 99, "xy"), (6, "s", 1, 0, 6, "ab cd"), (7, "s", 1, 0, 0, "")]
    df = spark.createDataFrame(rows, "span_id int, source_id string, page_number int, start_char int, end_char int, quote string")
    assert {r.span_id: r.exact for r in spans.exact(df, pages).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    at = {r.span_id: (r.times, r.start) for r in spans.located(df, pages).collect()}
    assert at[1] == (2, None) and at[2] == (1, 3) and at[6] == (1, 0) and at[4] == (0, None) and at[7] == (0, None)
    kept = spark.createDataFrame([([(1, 5), (2, 9), (3, 3), (4, 1)],)], "x array<struct<rank:int,size:int>>").select(spans.within_budget(F.col("x"), 9).alias("k")).first().k
    assert kept == [1, 3, 4]
    v = spark.createDataFrame([([float(i) for i in range(7)],)], "x array<double>").select(*[spans.nearest_rank(F.col("x"), p).alias(f"p{p}") for p in (25, 50, 75)]).first()
    assert tuple(v) == (float(round(1.5)), 3.0, float(round(4.5)))


def test_coverage(spark):
    e = spark.createDataFrame([(1, 1, 10, 5, 9), (1, 2, 11, 0, 4), (2, 3, 10, 0, 50)], "query_id int, span_id int, page_id int, start_char int, end_char int")
    r = spark.createDataFrame([(1, 10, 0, 20, 1), (1, 11, 0, 10, 4), (2, 10, 0, 20, 1)], "query_id int, page_id int, start int, end int, rank int")
    got = {x.query_id: x for x in spans.coverage(e, r).collect()}
    assert (got[1].cov_1, got[1].cov_3, got[1].cov_5) == (0.0, 0.0, 1.0) and got[1].irrelevant == 16 + 6 and got[2].cov_5 == 0.0 and got[2].irrelevant == 0


def test_bootstrap_and_guardrails(spark):
    rng = random.Random(4)
    v = [rng.choice([-1.0, 0.0, 0.0, 1.0]) for _ in range(30)]
    r = random.Random(0)
    means = sorted(sum(v[r.randrange(30)] for _ in range(30)) / 30 for _ in range(500))
    m, lo, hi = compare.paired_interval(v, 500)
    assert math.isclose(m, sum(v) / 30) and math.isclose(lo, means[int(0.025 * 499)]) and math.isclose(hi, means[int(0.975 * 499)])
    assert compare.paired_interval([]) == (0.0, 0.0, 0.0)
    g = compare.guardrails(spark.createDataFrame([("a", 1.0, None)], "candidate string, x double, y double"), [("x", "x", "min", 0.5), ("y", "y", "max", 1.0)])
    assert {(r.name, r.passed) for r in g.collect()} == {("x", True), ("y", False)}


def test_subset_and_config():
    assert govern.select_subset([("a", 5), ("b", 3), ("c", 9)], 8) == {"a", "b"} and govern.select_subset([], 4) == set()
    c = EngineConfig.from_mapping({"PAGELOOM_TOP_K": "7", "OTHER": "x"})
    assert c.top_k == 7 and differences({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"]
    for bad in ({"strategy": "x"}, {"unit_overlap": 900}, {"hard_size": 1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_documents(spark, tmp_path):
    (tmp_path / "acme" / "plan").mkdir(parents=True)
    (tmp_path / "acme" / "plan" / "a.txt").write_text("one  line\n\nsecond\f" + "�" * 9 + "x", encoding="utf-8")
    (tmp_path / "acme" / "plan" / "b.HTML").write_text("<h1>Title</h1><script>no</script><p>text</p>", encoding="utf-8")
    (tmp_path / "acme" / "plan" / "c.bin").write_bytes(b"\x00")
    f = documents.files(spark, str(tmp_path))
    assert {(r.path, r.company, r.product) for r in f.collect()} == {("acme/plan/a.txt", "acme", "plan"), ("acme/plan/b.HTML", "acme", "plan")}
    p = {(r.path, r.page_number): r for r in documents.extract_pages(f).collect()}
    assert p[("acme/plan/a.txt", 1)].text == "one line\nsecond" and p[("acme/plan/a.txt", 2)].quality_notes == ["unreadable_page"] and p[("acme/plan/b.HTML", 1)].text == "Title\ntext"
    ocr = documents.PageConfig(recognize=lambda content, n: f"page {n} read again")
    assert {r.extraction_method for r in documents.extract_pages(f, ocr).collect()} == {"ocr"}

    def broken(content, n):
        raise RuntimeError

    assert all("recognition failed: RuntimeError" in r.quality_notes for r in documents.extract_pages(f, documents.PageConfig(recognize=broken)).collect())
    inv = documents.inventory(f, "approved_public", "REF-1").collect()
    assert len({r.source_id for r in inv}) == 2
    with pytest.raises(ValueError):
        documents.inventory(f, "rejected", "REF-1")
    with pytest.raises(Exception, match="not admissible"):
        documents.inventory(f.unionByName(f), "approved_public", "REF-1").collect()


CASES = [
    {"case_id": "c1", "question": "观察期是多久", "expected_section": "观察期限", "chunks": [{"chunk_id": "x", "section_title": "观察期限", "text": "观察期为三十日"}, {"chunk_id": "y", "section_title": "责任免除", "text": "不承担责任"}, {"chunk_id": "z", "section_title": "释义", "text": "名词说明"}]},
    {"id": "c2", "question": "who pays", "expected_section": "none", "expected_terms": ["Pay"], "chunks": [{"chunk_id": "x", "section_title": "Other", "text": "nothing here"}, {"chunk_id": "y", "section_title": "Payment", "text": "who pays first"}]},
]


def test_case_evaluation(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(CASES, ensure_ascii=False), encoding="utf-8")
    c = cases.read_cases(spark, str(path))
    u = cases.case_units(c)
    assert {(r.case_id, r.unit_id, r.page_number) for r in u.collect()} >= {("c1", "x", 1), ("c2", "y", 2)}
    corpus = u.withColumnRenamed("page_number", "seq")
    q = c.select("case_id", F.lit(0).alias("q_idx"), "question")
    hits = evaluate.lexical_hits(corpus, q)
    uv = corpus.withColumn("vector", T.hash_vector(F.col("text")))
    qv = q.withColumn("vector", T.hash_vector(F.col("question")))
    fused = evaluate.fused_hits(evaluate.vector_hits(uv, qv, 1), hits, 3)
    only = evaluate.judged(evaluate.fused_hits(None, hits, 3), u, c)
    assert {(r.case_id, r.passed) for r in only.collect()} == {("c1", True), ("c2", True)}
    assert fused.count() >= 2 and tuple(evaluate.summary(only).first()) == (2, 2, 2, 2)
    path.write_text(json.dumps([{**CASES[0], "question": " "}], ensure_ascii=False), encoding="utf-8")
    with pytest.raises(Exception, match="not a valid case: c1"):
        cases.read_cases(spark, str(path)).collect()


def test_sinks(spark, tmp_path):
    p = tmp_path / "m" / "x.json"
    assert sinks.write_json_once(p, {"b": 1, "a": "é"}) and not sinks.write_json_once(p, {"a": "é", "b": 1})
    with pytest.raises(FileExistsError):
        sinks.write_json_once(p, {"a": 2})
    assert sinks.write_json_once(p, {"a": 2}, allow_replace=True) and sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sinks.same_rows(a, a) and not sinks.same_rows(a, a.distinct())
    calls = []
    values = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "t string")
    out, fresh = sinks.with_cache(values, "t", None, lambda ts: [[float(len(t))] for t in ts])
    assert sorted((r.t or "", r.vector) for r in out.collect()) == [("", None), ("a", [1.0]), ("a", [1.0]), ("bb", [2.0])]
    again, none = sinks.with_cache(values, "t", spark.createDataFrame(fresh.collect(), fresh.schema), lambda ts: calls.append(ts) or [])
    assert none.count() == 0 and again.count() == 4
    req = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2")], "annotator string, item int, request_sha256 string")
    done, todo = sinks.answered(req, spark.createDataFrame([("a", 1, "h1", "yes"), ("a", 2, "old", "no")], "annotator string, item int, request_sha256 string, answer string"))
    assert [r.answer for r in done.collect()] == ["yes"] and [r.item for r in todo.collect()] == [2]
    assert "| 1 |" in sinks.markdown(a.distinct(), "x", ["x"], "T")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    t = pa.table({"page_id": pa.array([1, 1, 2, 3], pa.int64()), "text": ["ok", "ok", "��", None], "extraction_method": ["text", "text", "ocr", None], "ingested_at": pa.array([datetime(2031, 1, d) for d in (1, 1, 1, 2)], pa.timestamp("us"))})
    pq.write_table(t, src / "a.parquet")
    stream = spark.readStream.schema("page_id bigint, text string, extraction_method string, ingested_at timestamp_ntz").parquet(str(src))
    q = page_quality_counts(stream).writeStream.format("memory").queryName("arrivals").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.method, r.pages, r.garbled) for r in spark.table("arrivals").collect()} == {("text", 1, 0), ("ocr", 1, 1), ("none", 1, 0)}


def subsets(sizes):
    names = sorted(n for n, k in sizes if k > 0)
    size = dict(sizes)
    for mask in range(1, 2 ** len(names)):
        yield mask, {n for i, n in enumerate(names) if mask >> i & 1}, sum(size[n] for i, n in enumerate(names) if mask >> i & 1)


def test_subset_against_brute_force():
    assert govern.select_subset([("a", 10), ("b", 10)], 3) == {"a"} and govern.select_subset([("a", 10)], 8) == set()
    rng = random.Random(8)
    for _ in range(60):
        sizes = [(f"n{i}", rng.randrange(0, 9)) for i in range(rng.randrange(1, 9))]
        total, target = sum(k for _, k in sizes), rng.randrange(0, 40)
        inner = [(abs(t - target), t, mask, names) for mask, names, t in subsets(sizes) if 0 < t < total]
        assert govern.select_subset(sizes, target) == (min(inner)[3] if inner else set()), (sizes, target)


def test_clauses_of_late_pages(spark):
    rows = [("s", 2_000_000_000, "第一条 观察期限\n三十日。", None), ("s", 2_000_000_001, "续前页的内容。", None)]
    df = spark.createDataFrame(rows, "source_id string, page_number int, text string, quality_notes array<string>")
    assert {(r.clause_page, r.page_number) for r in segment.clause_units(df).collect()} == {(2_000_000_000, 2_000_000_000), (2_000_000_000, 2_000_000_001)}


def test_units_of_long_pages_keep_apart(spark, tmp_path):
    from pageloom.plans import spans as plan

    pq.write_table(pa.table({"page_id": pa.array([1, 2], pa.int64()), "source_id": ["s", "s"], "page_number": pa.array([1, 2], pa.int32()), "text": ["x" * 100_700, "y"]}), tmp_path / "document_page.parquet")
    units = plan._units(spark, str(tmp_path)).collect()
    assert len(units) == len({tuple(u.doc_id) for u in units}) == 169 and all(u.doc_id.page_id == u.page_id for u in units)


def test_copies_of_pages_are_left_out(spark, tmp_path):
    from pageloom.sources.tables import pages

    ids = [1, 2, 2, 3, 3, 3, None, None]
    t = pa.table({"page_id": pa.array(ids, pa.int64()), "source_id": ["s"] * 8, "page_number": pa.array([1] * 8, pa.int32()), "text": [f"t{i}" for i in ids]})
    pq.write_table(t, tmp_path / "document_page.parquet")
    assert sorted((r.page_id or 0, r.text) for r in pages(spark, str(tmp_path), "text").collect()) == [(0, "tNone"), (1, "t1"), (2, "t2"), (3, "t3")]


def test_small_functions(spark):
    for t, n in [("十", 10), ("二十", 20), ("二十五", 25), ("十五", 15), ("二零", 20), ("35", 35), ("一百", None), ("x", None), ("", None), (None, None)]:
        assert one(spark, t, T.small_number) == n, t
    assert one(spark, "观察期与等待期", lambda c: T.replaced(c, {"等待期": "观察期"})) == "观察期与观察期"
    assert one(spark, "给付三十日，可能例外，但不确定", lambda c: T.before_any(c, ["但", "可能"])) == "给付三十日，" and one(spark, "ab", lambda c: T.before_any(c, ["x"])) == "ab"
    assert one(spark, "a。b。if c", lambda c: T.occurrences(c, ["。", "if "])) == 3
    r = spark.range(1).select(*[T.ratio(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("x", 1.0, 2.0), ("y", 0.0, 0.0), ("z", 3.0, 0.0))]).first()
    assert (r.x, r.y) == (0.5, 0.0) and math.isinf(r.z)
    h = spark.createDataFrame([("1. Riders\nWe pay.", "1. Riders"), ("1. Riders", "1. Riders"), ("x\ny", None)], "t string, h string")
    assert [x.b for x in h.select(segment.without_heading(F.col("t"), F.col("h")).alias("b")).collect()] == ["We pay.", "1. Riders", "x\ny"]


def test_page_titles(spark):
    rows = [("s", 1, "x\n第一条 观察期限\n第二条 除外事项"), ("s", 2, "nothing"), ("s", 3, "Definitions"), ("t", 1, "nothing"), ("s", 300, "\n" * 90 + "第三条 病种释义"), ("s", 301, "\n".join(["y"] * 80) + "\n第三条 红利分配")]
    df = spark.createDataFrame(rows, "source_id string, page_number int, text string")
    got = {(r.source_id, r.page_number): (r.title, r.confidence) for r in segment.page_titles(df).collect()}
    assert got == {("s", 1): ("观察期限", "high"), ("s", 2): ("观察期限", "low"), ("s", 3): ("Definitions", "medium"), ("t", 1): (None, "low"), ("s", 300): ("病种释义", "high"), ("s", 301): ("病种释义", "low")}


def reranked(spark, question, title, text, confidence="high"):
    df = spark.createDataFrame([(question, title, text, confidence)], "q string, ti string, te string, c string")
    terms = rewrite.rerank_terms(F.col("q"), F.col("ti"), F.col("te"), F.col("c"))
    r = df.select(rewrite.rerank_score(terms).alias("s"), rewrite.rerank_reasons(terms).alias("r")).first()
    return r.s, r.r


def test_rerank_terms(spark):
    assert reranked(spark, "除外有哪些", "除外事项", "本公司不承担给付责任") == (2.0 + 1.5 + 0.5, ["title_intent", "excluding", "exact_term"])
    assert reranked(spark, "除外有哪些", "保障范围", "x") == (-1.5, ["wrong_title"])
    assert reranked(spark, "什么是观察期", "名词解释", "x", "low") == (2.0 - 1.5 + 0.5 - 0.5, ["title_intent", "definition_title", "exact_term", "low_confidence"])
    assert reranked(spark, "the policyholder", None, "the policyholder and the beneficiary of 30", "high") == (1.0 - 2.0, ["same_person", "other_person"])
    assert reranked(spark, "within 30 days", "", "第一条 30") == (0.25 + 0.25, ["number", "clause_heading"])
    assert reranked(spark, "x", None, None, "high") == (0.0, [])


def test_cosine_by_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "unit_id long, vector array<double>").cache()
    q = df.where("unit_id % 3 = 0").select(F.col("unit_id").alias("query_id"), "vector")
    sent = sorted(map(tuple, vector.cosine_topk(q, df, 3).collect()))
    monkeypatch.setattr(vector, "SENT_BYTES", 0)
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert sorted(map(tuple, vector.cosine_topk(q, df, 3).collect())) == sent and len(sent) == 60


def test_running_counts(spark):
    rng = random.Random(4)
    rows = [("hot", v, rng.randrange(1, 4)) for v in range(3000)] + [("x", 1, 2)]
    got = {(r.k, r.v): (r.upto, r.total) for r in compare.running_counts(spark.createDataFrame(rows, "k string, v long, n long"), "k", "v", "n").collect()}
    total = sum(n for k, _, n in rows if k == "hot")
    upto, run = {}, 0
    for k, v, n in rows[:-1]:
        run += n
        upto[k, v] = (run, total)
    assert got == upto | {("x", 1): (2, 2)}


def test_strategy_checks(spark):
    cases = [(s, i, 1.0 if s == "b" or i % 2 else 0.0, 1.0 if s == "b" else float(i % 2), i < 8, i > 6, float(s == "a" and i > 6), 0.5 if s == "a" else 0.1) for s in ("a", "b") for i in range(10)]
    c = spark.createDataFrame(cases, "strategy string, case_id long, cov_3 double, cov_budget double, boundary boolean, hard boolean, confusion double, irrelevant double")
    t = spark.createDataFrame([("a", 100, 10, 1.0, True), ("b", 114, 13, 2.0, True)], "strategy string, tokens long, units long, latency double, invariants boolean")
    got = {r.name: (r.value, r.passed) for r in compare.strategy_checks(c, t, "a", draws=200).collect()}
    assert len(got) == 10 and [n for n, (_, ok) in got.items() if not ok] == ["unit_ratio"]
    assert got["boundary_gain"][0] == 0.5 and got["confusion_high"][0] == -1.0 and got["irrelevant_high"][0] == -0.4 and got["token_ratio"][0] == 1.14
    none = {r.name: r.passed for r in compare.strategy_checks(c.withColumn("boundary", F.lit(False)), t, "a", draws=50).collect()}
    assert not none["boundary_gain"] and not none["boundary_low"]
    assert compare.selected(c, t, compare.strategy_checks(c, t, "a", draws=50)).collect()[0].asDict() == {"strategy": "b", "eligible": False}


def test_one_strategy(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "strategy string")
    assert evaluate.one_strategy(df, "a").first().asDict() == {"units": 3, "strategies": 2, "compatible": False}
    assert evaluate.one_strategy(df.limit(2), "a").first().compatible and evaluate.one_strategy(df.limit(0), "a").first().compatible


def test_term_facts(spark):
    from pageloom.operators import claims

    facts = lambda t: one(spark, t, lambda c: claims.term_facts(c, aliases={"waiting period": "观察期"}))
    assert facts("观察期为30日，宽限期为60天。观察期为90日") == ["观察期=30天", "宽限期=60天", "观察期=90天"]
    assert facts("观察期和宽限期均为30日") == ["观察期=30天", "宽限期=30天"] and facts("观察期和宽限期为30日") == ["宽限期=30天"]
    assert facts("观察期与30日") == [] and facts("30日观察期") == [] and facts("观察期。30日") == [] and facts("") == []
    assert facts("the waiting period is 1,080 days") == ["观察期=1080days"]


def test_output_outside_repositories(tmp_path):
    import subprocess

    assert sinks.unversioned(tmp_path / "a" / "b") == tmp_path / "a" / "b"
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("out/\n")
    assert sinks.unversioned(tmp_path / "out" / "x") == tmp_path / "out" / "x"
    with pytest.raises(ValueError):
        sinks.unversioned(tmp_path / "kept" / "x")
