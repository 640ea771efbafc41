from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import charforms as C
from pageloom.llm import encoding as E

from .conftest import page, rows


def test_trie_costs():
    t = C.Trie([("payment", 9), ("pavement", 3), ("a", 20)])
    assert t.match("pаyment") == "payment"  # a Cyrillic letter is free
    assert t.match("pay​ment") == "payment"  # an ignorable is free
    assert t.match("payｍent") == "payment"
    assert t.match("paymnt") is None and t.match("paymnt", 1) == "payment"
    assert t.match("рaуmеnt") == "payment"


def test_table_keeps_other_alphabets():
    assert C.table_form("полис ＡＢ⽇ﬁ\xa0x") == "полис AB日fi x"
    assert C.canonical("полис", C.Trie([("policy", 5)]).match("полис", C.edits("полис"))) == "полис"
    assert C.canonical("KΤ", None) == "KT"
    assert C.table_form(None) is None and C.table_form("") == ""


def test_found(spark, make_dir):
    clean = [page(i, "A policy pays β and γ-GT, ①“good” — (полис), 观察期限：５ 日".replace("５", "5")) for i in range(10, 15)]
    bad = [page(1, "pаys"), page(2, "观​察"), page(3, "ét"), page(4, "ＡＢ"), page(5, "⼈"), page(6, "А policy"), page(7, "x y"), page(8, "Â\xa0ok Ã\xa0 ")]
    from pageloom.llm.charforms import p1_found, p1_normalized

    d = make_dir(document_page=clean + bad)
    assert rows(p1_found(spark, d)) == {("document_page.text", i) for i in range(1, 8)}
    text = {r.record_id: r.text for r in p1_normalized(spark, d).collect()}
    assert text[1] == "pays" and text[2] == "观察" and text[3] == "ét" and text[6] == "A policy" and text[10] == clean[0]["text"]


PHRASES = ["该页由扫描识别得到，请核对原件", "本公司不承担给付责任。观察期限为三十日"]


def test_restores_each_misreading():
    for p in PHRASES:
        raw = p.encode("utf-8")
        for codec in ("latin-1", "cp1251", "mac_roman", "cp437"):
            if codec == "cp1251":
                wrong = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)
            else:
                wrong = raw.decode(codec)
            assert E.restored("x " + wrong + " y") == "x " + p + " y", codec
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in twice.encode("utf-8"))
        assert E.restored(twice) == p
        assert E.restored(p.encode("gbk").decode("latin-1")) == p
        assert E.garbled_spans(raw.decode("gbk", "replace")) and E.garbled_spans(p.encode("gbk").decode("big5", "replace")) and E.garbled_spans(raw.decode("cp932", "replace"))
    assert E.restored("coût de £30 — naïve") == "coût de £30 — naïve"
    assert E.restored("cÃ´te, Fьr Erblindung") == "côte, Für Erblindung"
    assert E.garbled_spans("锟斤拷锟斤拷")[0][2] is None


def test_leaves_ordinary_text():
    for t in ("NÃO SE APLICA", "Übersicht “Über” l’été – créée", "полис и договор", "繁體中文保險條款與說明書內容", "阿尔茨海默病、蘅衡健康险（汇编本）", "one � mark", "�" * 30, "①②③ β地中海贫血 20℃"):
        assert E.garbled_spans(t) == [], t


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text_is_handled(t):
    spans = E.garbled_spans(t)
    assert all(0 <= a < b <= len(t) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    E.restored(t)
    C.suspect_tokens(t)


def test_an_edit_beside_a_look_alike_finds_its_word(spark, monkeypatch):
    t = C.Trie([("claimant", 9)])
    assert C.edits("clаirnant") == 1 and C.edits("полис") == 0 and C.edits("cаt") == 0 and C.edits("claimant") == 0
    assert t.match("clаimаnf", C.edits("clаimаnf")) == "claimant"  # one misread letter beside two Cyrillic ones
    assert t.match("clаimаnf") is None
    tokens = spark.createDataFrame([("clаimаnf",), ("clаimant",), ("полис",)], "token string")
    words = spark.createDataFrame([("claimant", 9), ("clamp", 4), ("close", 3), ("climb", 8)], "word string, n long")
    want = {("clаimаnf", "claimant"), ("clаimant", "claimant"), ("полис", "полис")}
    assert rows(C.canonical_spellings(tokens, words)) == want
    monkeypatch.setattr(C, "TRIE", 1)  # a trie for each word
    assert rows(C.canonical_spellings(tokens, words)) == want


def test_nothing_vanishes_in_restored_text():
    p = PHRASES[1]
    wrong = p.encode("gbk").decode("latin-1")
    assert E.restored(wrong + "£") == p + "£"
    assert E.restored("é" + wrong) == "é" + p
    assert E.restored("x " + wrong + "£ y") == "x " + p + "£ y"
    # characters that the wrong encoding lacks come from elsewhere and stay
    mixed = p.encode("utf-8").decode("cp932", "replace")
    assert "☃" in (E.restored(mixed[:12] + "☃" + mixed[12:]) or "")
