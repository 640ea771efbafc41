import random
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import boilerplate as B
from pageloom.llm import overlap as O
from pageloom.llm import readability as R
from pageloom.llm import scan as S
from pageloom.llm.charforms import folded
from pageloom.llm.furniture import is_page_number, is_running_header

from .conftest import page, rows, source


def dp(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@given(st.text("abc", max_size=24), st.text("abc", max_size=24))
@settings(max_examples=300, deadline=None)
def test_distance_is_edit_distance(a, b):
    assert O.distance(a, b, 100) == dp(a, b)
    most = 4
    assert (O.distance(a, b, most) <= most) == (dp(a, b) <= most)


def _text(rng, n=14):
    subject, verb = ["投保人", "受益人", "代理人", "监护人", "持单人"], ["提交申请", "变更地址", "领取保险金", "办理复效", "补交保费", "核对结论"]
    return "\n".join(f"{rng.choice(subject)}应于{rng.randrange(10, 9999)}日内凭第{rng.randrange(1000, 99999)}号证明到第{rng.randrange(100)}柜台{rng.choice(verb)}。" for _ in range(n))


def test_overlaps_against_brute_force(spark, make_dir):
    rng = random.Random(5)
    texts = [_text(rng) for _ in range(60)]
    pages = []
    for i, t in enumerate(texts):
        pages.append(page(i, t, f"s{i % 6}"))
    for k in range(12):  # copies on the other side: exact, a sentence dropped, characters changed, half another text
        t = texts[k]
        if k % 4 == 1:
            t = "\n".join(t.split("\n")[:-1])
        if k % 4 == 2:
            c = list(t)
            for j in rng.sample(range(len(c)), len(c) // 40):
                c[j] = "某"
            t = "".join(c)
        if k % 4 == 3:
            t = "\n".join(t.split("\n")[:7]) + "\n" + _text(rng, 7)
        pages.append(page(100 + k, t.replace("，", ",\n"), f"s{6 + k % 3}"))
    pages.append(dict(pages[-1]))
    sides = {f"s{i}": "development" if i < 6 else "held_out" for i in range(9)}
    d = make_dir(document_page=pages, document_split_assignment=[{"source_id": s, "split": x} for s, x in sides.items()])
    got = rows(O.p2_found(spark, d))
    body = {p["page_id"]: re.sub(r"\s", "", folded(p["text"])) for p in pages}
    side = {p["page_id"]: sides[p["source_id"]] for p in pages}
    want = {(a, b) for a in body for b in body if a < b and side[a] != side[b] and dp(body[a], body[b]) <= O.DIFFER * max(len(body[a]), len(body[b]))}
    assert got == want and len(want) >= 9
    s = {(r.dev_source, r.held_source): r.pairs for r in O.p2_sources(spark, d).collect()}
    assert sum(s.values()) == len(want)


def test_repeated_lines_against_brute_force(spark, make_dir):
    rng = random.Random(1)
    notice = "本公司版权所有，未经书面许可不得转载第{}号"
    pages = []
    for i in range(60):
        lines = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥") for _ in range(20)) for _ in range(3)]
        if i % 2:
            lines.insert(rng.randrange(3), rng.choice(["", "  ", "※ "]) + notice.format(rng.randrange(9999)).replace("，", rng.choice("，,")) + rng.choice(["", "。", "."]))
        pages.append(page(i, "\n".join(lines), f"s{i % 10}"))
    srcs = [source(f"s{i}", insurer="A" if i < 8 else None) for i in range(10)]
    d = make_dir(document_page=pages, benchmark_source=srcs)
    got = rows(B.p6_found(spark, d))
    want = {(p["page_id"], n) for p in pages if int(p["source_id"][1:]) < 8 for n, x in enumerate(p["text"].split("\n"), 1) if "版权所有" in x}
    assert got == want and want
    cleaned = {r.page_id: r.text for r in B.p6_cleaned(spark, d).collect()}
    assert not any("版权所有" in cleaned[p["page_id"]] for p in pages if int(p["source_id"][1:]) < 8) and len(cleaned) == 60


def test_masked_lines():
    m = B.masked_lines(["Share this page with a friend of yours: 12", "x\n  SHARE this  page with a friend of yours: 9!\nShare that page with a friend of yours: 9", None, ""])
    assert m["line_no"].tolist() == [1, 2, 3] and m["row"].tolist() == [0, 1, 1]
    assert m["exact"][0] == m["exact"][1] != m["exact"][2] and m["check"][0] == m["check"][1] != m["check"][2]
    assert (m["bands"][0] == m["bands"][1]).all()


def test_names_and_dates_are_masked_for_likeness():
    a = "On January 5, 2031 this notice was sent by Northwind Life to all of its members"
    b = "On 12 March 2032 this notice was sent by Southgale Mutual to all of its members"
    m = B.masked_lines([a, b], ["Northwind Life", "Southgale Mutual"], shingles=True)
    ends = np.cumsum(m["size"])
    one, two = (set(m["shingle"][e - n : e].tolist()) for e, n in zip(ends, m["size"]))
    assert m["exact"][0] != m["exact"][1] and len(one & two) / len(one | two) > 0.9


def test_near_duplicate_lines_join_their_cluster(spark, make_dir):
    notice = "温馨提示：以上内容以本公司最终签发的保险单为准，请妥善保管"
    near = notice.replace("妥善", "妥普")
    pages = [page(i, "甲乙丙丁戊己庚辛壬癸"[i] * 14 + "\n" + (near if i in (3, 8) else notice), f"s{i}") for i in range(10)]
    pages[9] = page(9, "扫码关注服务号，分享给家人一起了解保障内容", "s9")
    d = make_dir(document_page=pages, benchmark_source=[source(f"s{i}", insurer="A") for i in range(10)])
    # near-duplicates are removed and counted, but only equal lines are cases
    assert rows(B.p6_found(spark, d)) == {(i, 2) for i in range(9) if i not in (3, 8)}
    assert [(r.n_sources, r.lines, r.variants) for r in B.p6_families(spark, d).collect()] == [(9, 9, 2)]
    assert all("保险单" not in r.text for r in B.p6_cleaned(spark, d).collect())


def test_every_line_alike_to_a_leader_joins_it(spark, make_dir):
    rng = random.Random(11)
    make = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    leaders = [make(24 + 7 * k) for k in range(4)]
    pages = [page(i, "\n".join([*leaders, make(30)]), f"s{i}") for i in range(8)]
    for i in range(8, 16):  # copies with characters changed, most of them near the threshold
        lines = []
        for _ in range(80):
            c = list(rng.choice(leaders))
            for j in rng.sample(range(len(c)), rng.randrange(1, 4)):
                c[j] = "某"
            lines.append("".join(c))
        pages.append(page(i, "\n".join(lines), f"s{i}"))
    d = make_dir(document_page=pages, benchmark_source=[source(f"s{i}", name=None, insurer="A") for i in range(16)])
    pairs = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    alike = lambda x, y: len(pairs(x) & pairs(y)) >= B.SIMILAR * len(pairs(x) | pairs(y))
    held = {}
    for p in pages:
        for n, x in enumerate(p["text"].split("\n"), 1):
            held.setdefault(folded(x), []).append((p["source_id"], p["page_id"], n))
    want = set()
    for y in held:
        own = [h for x in held if alike(x, y) for h in held[x]]
        if len({h[0] for h in held[y]}) >= 2 and len({h[0] for h in own}) >= B.MIN_SHARE * 16:
            want |= {h[1:] for h in own}
    assert {(r.page_id, r.line_no) for r in B.repeated_lines(spark, d).collect()} == want
    assert 300 < len(want) < 8 * 5 + 640


def test_furniture():
    for x in ("9", "- 12 -", "第 l4O 页", "第 9 页 共 12 页", "Page 3 of 12", "p. l9", "S. 4", "[ 7 ]", "页码：9", "Page 7 sur 9"):
        assert is_page_number(x), x
    for x in ("£53,610.", "17%。", "90日。", "Page three is empty", "", "A", "sold", "13.4 Riders"):
        assert not is_page_number(x), x
    name = "Northolt Life·Harbour Care Plan"
    for x in (name, "NORTHOLT LIFE·HARBOUR CARE PLAN", "Northo t Life·Harbour Care Pln  |  12", f"《{name}》    3.1 Riders"):
        assert is_running_header(x, name), x
    for x in ("This leaflet was issued by the Northolt Life wording desk", "We pay", ""):
        assert not is_running_header(x, name), x
    assert not is_running_header("x", None)


def test_scan_noise(spark, make_dir):
    good = "The approved hospital confirmed treatment of the insured person within 30 days.\n本公司按基本保额的20%给付保险金，受益人可以领取。\nA self-employed member pays."
    pages = [page(i, good, method="ocr") for i in range(40)]
    pages += [
        page(100, good.replace("treatment", "treatrnent"), method="ocr"), page(101, good.replace("本公司", "木公司")), page(102, good.replace("30 days", "3O days")),
        page(103, good.replace("hospital", "hospi-\ntal")), page(104, good.replace("self-employed", "self-\nemployed")), page(105, "- 5 -\n" + good), page(106, good + "\nNorthwind Li e·Plan | 4"),
    ]
    d = make_dir(document_page=pages, benchmark_source=[source("s1")])
    assert rows(S.p4_found(spark, d)) == {(100, "misread"), (101, "misread"), (102, "misread"), (103, "hyphenation"), (105, "page_number"), (106, "running_header")}
    fixed = {r.page_id: r.text for r in S.p4_repaired(spark, d).collect()}
    assert len({fixed[i] for i in (1, 100, 101, 102, 103, 105, 106)}) == 1 and "self-employed" in fixed[104]


def corpus():
    a = [f"the {w} was paid on monday by the member of the plan" for w in ["premium"] * 90 + ["prernium"] * 6]
    b = ["if the insured person asks us to do so we pay", "it may be that a claim is late but it is paid"] * 40
    return [*a, *b, *["a horse ran over green hills today"] * 40]


def vectors_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = S.word_table(df).cache()
    found = S.candidates(words).cache()
    u, v = S.trained(S.context_counts(df, words.select("hash")))
    return words, found, v, u


def test_trained_vectors_tell_like_contexts_from_unlike_ones(spark):
    words, found, v, _ = vectors_of(spark, corpus())
    vec = {r.word: np.array(r.vector) for r in words.join(v, "hash").collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert len(vec["premium"]) == S.DIMENSIONS >= 32
    assert cos("premium", "prernium") > 0.9 > 0.5 > max(cos("premium", w) for w in ("horse", "hills", "claim", "late"))


def test_the_vectors_decide_the_links(spark):
    texts = corpus() + ["fhe"] * 1 + ["green hills rnay ran today over a horse"] * 3 + ["it may be"] * 30
    _, found, v, _ = vectors_of(spark, texts)
    pairs = {(r.word, r.meant) for r in found.collect()}
    linked = {(r.word, r.meant) for r in S.links(found, v).collect()}
    assert ("prernium", "premium") in linked
    # the same glyphs in contexts of another word are no misreading
    assert ("rnay", "may") in pairs - linked and linked < pairs


def test_fits_by_context():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(S.CONTEXTS, S.DIMENSIONS)).astype(np.float32)
    v = np.stack([u[7], u[7]])
    assert S.fits(np.array([[7, 7, -1, -1], [-1, -1, -1, -1]], np.int32), v, u).tolist() == [True, True]
    assert not S.fits(np.array([[9, -1, -1, -1]], np.int32), -u[9:10], u).any()


def test_misreadings_at_the_edges_of_a_page(spark, make_dir):
    pages = [page(i, "本公司按约定给付保险金") for i in range(40)] + [page(99, "木公司按约定给付保险全")]
    d = make_dir(document_page=pages, benchmark_source=[source("s1")])
    assert rows(S.p4_found(spark, d)) == {(99, "misread")}
    fixed = {r.page_id: r.text for r in S.p4_repaired(spark, d).collect()}
    assert fixed[99] == fixed[1]


def test_units_are_counted_where_asked_for_and_cut_words_as_before():
    texts = ["the insured per-\nson asks self-\n employed\u2010\nstaff -\n- x-\n9 a-b", "pays 30 days\nwell-", None]
    w = S.batch_words(texts, units=True)
    assert (w["units"] == np.bincount((w["key"].view(np.uint64) % np.uint64(S.CONTEXTS)).astype(int), minlength=S.CONTEXTS)).all() and w["units"].sum() > 8
    plain = S.batch_words(texts)
    assert not plain["units"].any() and all((plain[k] == w[k]).all() for k in ("row", "hash", "key"))
    everything = np.arange(len(w["hash"]))
    unit, row = w["key"].view(np.uint64) % np.uint64(S.CONTEXTS), w["row"]
    want = [[int(unit[i + d]) if 0 <= i + d < len(row) and row[i + d] == row[i] else -1 for d in (-2, -1, 1, 2)] for i in everything]
    assert plain["ctx"](everything).tolist() == want
    old = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
    assert all([m.span() for m in old.finditer(t)] == [m.span() for m in S._HYPHEN.finditer(t)] for t in texts if t)
    assert S.words_cut(texts[0]) == {("per", "son"), ("self", "employed"), ("employed", "staff")}


def test_reading_levels(spark, make_dir):
    plain = ["You can stop. Tell us first. We pay you. Sign the form." for _ in range(20)]
    mid = ["We pay the daily benefit when treatment has been confirmed by a hospital within the period shown in the table." for _ in range(20)]
    hard = ["Notwithstanding antecedent encumbrances duly authenticated, the assignment of remuneration shall remain ineffectual unless and until apportioned in accordance with supplementary schedules, whereupon subrogation ensues." for _ in range(20)]
    docs = [{"doc_id": i, "text": t, "lang": "en"} for i, t in enumerate([*plain, *mid, *hard])] + [{"doc_id": 90, "text": hard[0], "lang": None}, {"doc_id": 91, "text": None}, {"doc_id": 92, "text": "12 34"}]
    d = make_dir(documents=docs, reading_pair=[{"pair_id": 1, "doc_id_a": 0, "doc_id_b": 20}, {"pair_id": 2, "doc_id_a": 40, "doc_id_b": 20}, {"pair_id": 2, "doc_id_a": 40, "doc_id_b": 20}])
    assert rows(R.p10_found(spark, d)) == {(1, 20), (2, 40)}
    df = spark.read.parquet(f"{d}/documents.parquet")
    df = df.unionByName(df.where("doc_id < 20").withColumn("doc_id", df.doc_id + 100)).unionByName(df.where("doc_id < 20").withColumn("doc_id", df.doc_id + 200))
    assert len(rows(R.familiar_words(df, share=0.5))) < len(rows(R.familiar_words(df)))
    level = {r.doc_id: r for r in R.reading_levels(df, share=0.5).collect()}
    assert level[90].level == level[40].level and level[90].lang == "en" and level[91].level is None and level[92].level is None
    assert level[0].unfamiliar_share == 0 and level[40].unfamiliar_share > 0.5


def test_words_of_a_batch_are_those_of_its_texts_and_pages_without_look_alikes_have_no_windows():
    texts = ["the insu-\nred pays 3O days, 12 or ٣", "", None, "本公司按 约定1给付保险金，", "short", "日é 曰-\n9ft rn modern burn\nnext", "日曰", "锟日本"] * 3
    parts = lambda w: [*zip(w["hash"].tolist(), w["key"].tolist(), w["text"](np.arange(len(w["hash"]))), map(tuple, w["ctx"](np.arange(len(w["hash"]))).tolist()))]
    together = S.batch_words(texts, units=True)
    alone = [S.batch_words([t, "padding for the least size"]) for t in texts]
    for i, w in enumerate(alone):
        assert sorted(x for x, r in zip(parts(together), together["row"]) if r == i) == sorted(x for x, r in zip(parts(w), w["row"]) if r == 0)
    # a character's kind is looked up once: arrays as long as the text are few (124 bytes a character before)
    english = ["the insured person pays 30 days "] * 6000
    S.batch_words(english)
    tracemalloc.start()
    S.batch_words(english)
    most = tracemalloc.get_traced_memory()[1] / sum(map(len, english))
    tracemalloc.stop()
    assert most < 90
