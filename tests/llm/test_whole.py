"""Jobs that were once done in part only."""

import os
import random

import numpy as np

from pageloom.llm import encoding as E
from pageloom.llm import overlap as O

from .conftest import page, rows


def test_notes_are_restored(spark, make_dir):
    bad = "Prüfung läuft".encode().decode("cp1252")
    pages = [page(1, "fine", notes=["plain", bad, None, bad]), page(2, bad, notes=None), page(3, bad, notes=[bad]), page(4, "fine", notes=["Prüfung"])]
    d = make_dir(document_page=[*pages, pages[0]])
    got = {(r.field_name, r.page_id, r.note_no): r.restored for r in E.p5_restored(spark, d).collect()}
    assert got == dict.fromkeys([("quality_notes", 1, 2), ("quality_notes", 1, 4), ("text", 2, None), ("text", 3, None), ("quality_notes", 3, 1)], "Prüfung läuft")
    assert {k[:2] for k in got} == rows(E.p5_found(spark, d))


def crowd(n=48):
    """Bodies (class, sides, body) that all share a sentence of 40 characters; the last eight, of the other side, are changed copies of some."""
    rng = random.Random(9)
    shared = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    make = lambda k: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(k))
    texts = [make(150) + shared + make(160) for _ in range(n)]
    for k in range(8):
        t = list(texts[3 * k])
        for i in rng.sample(range(len(t)), k):
            t[i] = "某"
        texts.append("".join(t))
    return [(i, 1 if i < n else 2, t) for i, t in enumerate(texts)]


def alike_in(spark, bodies):
    one = spark.createDataFrame(bodies, "class long, sides int, body string")
    return {(r.x, r.y) for r in O._verified(O.candidate_pairs(O.suffix_array(one)), one).collect()}


def test_crowds_are_compared_in_full_whatever_the_batches_and_blocks(spark, monkeypatch):
    bodies = crowd()
    want = {(a, b) for a, s, x in bodies for b, u, y in bodies if s == 1 and u == 2 and O.alike(x, y)}
    assert len(want) == 8 and alike_in(spark, bodies) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert alike_in(spark, bodies) == want
        monkeypatch.setattr(O, "BLOCK", 16)
        monkeypatch.setattr(O, "MEET", 32)
        assert alike_in(spark, bodies) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_same_pairs_at_any_batch_size(spark, make_dir):
    pages = [page(i, t, f"s{i % 3}" if side == 1 else "h") for i, side, t in crowd(30)]
    d = make_dir(document_page=pages, document_split_assignment=[{"source_id": s, "split": "held_out" if s == "h" else "development"} for s in ("s0", "s1", "s2", "h")])
    found = []
    for n in ("200", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        found.append(rows(O.p2_found(spark, d)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) == 8


def test_common_prefixes_of_the_array():
    words = sorted("".join(random.Random(i).choice("ab") for _ in range(O.LETTERS)) for i in range(40))
    levels = O.common_prefixes(np.array(words, f"U{O.LETTERS}"), np.full(40, 5), np.zeros(40, np.int64))
    i, j = (np.array(x) for x in zip(*[(i, j) for i in range(40) for j in range(i + 1, 40)]))
    want = [5 + len(os.path.commonprefix([words[a], words[b]])) for a, b in zip(i, j)]
    assert O.common_prefix(levels, i, j).tolist() == want


def test_anchors_of_a_text_do_not_depend_on_its_batch():
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) for n in (60, 300, 25, 800, 130, 130)]
    together = O.anchors(["", *texts, None])
    for i, t in enumerate(texts, 1):
        alone, at = O.anchors([t]), together["row"] == i
        assert {*zip(*(alone[c] for c in ("prefix", "at", "rest", "gap", "letters")))} == {*zip(*(together[c][at] for c in ("prefix", "at", "rest", "gap", "letters")))}
        assert 0 in alone["at"] and (alone["at"] + alone["rest"] == len(t)).all()


def test_short_alike_texts_share_an_anchor():
    rng = random.Random(4)
    for n in range(20, 120):
        a = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
        d = int(O.DIFFER * n)
        b = "".join("某" if d and i % (n // (d + 1)) == 0 and 0 < i // (n // (d + 1)) <= d else c for i, c in enumerate(a))
        x = O.anchors([a, b])
        one, two = ({*zip(x["prefix"][x["row"] == r], x["at"][x["row"] == r])} for r in (0, 1))
        assert O.alike(a, b) and one & two, n


def test_suffixes_bring_along_no_more_than_their_spans_need():
    rng = random.Random(6)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) for n in (60, 400, 20_000)]
    a = O.anchors(texts)
    cut = [texts[r][i + k : i + max(k, g)][: O.LETTERS] for r, i, k, g in zip(*(a[c].tolist() for c in ("row", "at", "length", "gap")))]
    assert a["letters"].tolist() == cut and "" in cut and max(map(len, cut)) == O.LETTERS
    # marks of a long text take no more than their table
    marks = O.anchor_marks(a["row"], a["prefix"], 4)
    assert [len(m) <= O.BITS // 8 for m in marks] == [True] * 4 and len(marks[2]) == O.BITS // 8 > len(marks[1]) > 0 == len(marks[3])
    table, n = O.mark_table(marks)
    want = [{(h % (1 << 64) >> 20) % O.BITS for h in a["prefix"][a["row"] == r].tolist()} for r in range(4)]
    assert [set(np.flatnonzero(x).tolist()) for x in np.unpackbits(table.view(np.uint8), axis=1)] == want and n.tolist() == [*map(len, want)]


def test_bodies_of_no_pair_are_not_shuffled(spark):
    one = spark.createDataFrame(crowd(), "class long, sides int, body string")
    pairs = spark.createDataFrame([(0, 48)], "x long, y long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = O._verified(pairs, one)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and rows(df) == {(0, 48)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
