"""One consistent form for text that looks the same but differs in its characters.

Characters are folded by a table derived from the Unicode database plus a small
list of look-alike letters. Words are then looked up in a trie of the corpus's
own vocabulary by a weighted edit automaton: a look-alike costs nothing, an
ignorable may be skipped for nothing, any other edit costs one. A word that
reaches a vocabulary entry within its budget (EDITS for long words of mixed
alphabets, else none) takes its spelling; the rest takes the table's form.

Defined results: null stays null, empty stays empty; letters of another
alphabet used as such (a word wholly of that alphabet that matches no
vocabulary word) are kept; garbled spans of a wrong encoding are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_batches, materialized, sent_if_small, spread, table
from .encoding import garbled_spans

#: Letters of other alphabets and the Latin letters they look like.
LOOK_ALIKE = dict(zip(
    "авеіјкмнорсѕтухԁһԛԝАВЕЗІЈКМНОРСЅТУХ" + "οινκρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ıȷɡɑ",
    "abeijkmhopcstyxdhqwAB" "E3IJKMHOPCSTYX" + "oivkptuxABEZHIKMNOPTYX" + "ijga",
    strict=True,
))
#: Radicals of the supplement block, which have no decomposition, and the hanzi they look like.
RADICALS = dict(zip("⺟⺠⻄⻅⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳", "母民西见贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟", strict=True))
#: Full-width marks that are usual in Chinese text.
USUAL_WIDE = "，：；！？（）～｜"
#: Ignorable characters, as ranges of a regular expression (also valid in Java).
IGNORABLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
ODD_SPACE = "   -   "
_WIDE = "".join(chr(o) for o in range(0xFF01, 0xFF5F) if chr(o) not in USUAL_WIDE)
_FORMS = "‑⺀-⿕豈-﫿ﬀ-ﬆ̀-ͯ"
#: Characters that may make a value a case; other alphabets' look-alikes only within or as words.
SUSPECT = f"[{IGNORABLE}{ODD_SPACE}{_FORMS}{re.escape(_WIDE)}{''.join(LOOK_ALIKE)}]|[\U0001d400-\U0001d7ff]"
#: Vocabulary words occur in at least so many texts; about so many of them make a trie.
MIN_TEXTS, TRIE = 2, 50_000
#: Edits that cost which a token of at least LONG letters may take if it mixes alphabets.
EDITS, LONG = 1, 5
_WORD = r"[A-Za-zÀ-ÖØ-öø-ɏ]+"


@lru_cache(None)
def _table() -> dict[int, str]:
    t: dict[int, str] = {}
    for lo, hi in ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)):
        t |= {o: "" for o in range(lo, hi + 1)}
    t |= {o: " " for o in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F)}
    for o in (*range(0x2E80, 0x2FD6), *range(0xF900, 0xFB00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        c = chr(o)
        if c not in USUAL_WIDE and (n := unicodedata.normalize("NFKC", c)) != c:
            t[o] = n
    return t | {ord(a): b for a, b in RADICALS.items()} | {0x2011: "-"}


@lru_cache(None)
def _fold_table() -> dict[int, str]:
    """For comparing: also look-alike letters, usual wide marks and quotes."""
    t = {ord(c): unicodedata.normalize("NFKC", c) for c in USUAL_WIDE} | {ord(a): b for a, b in LOOK_ALIKE.items()}
    return _table() | t | {0x3000: " "} | dict.fromkeys(map(ord, "‘’‚′"), "'") | dict.fromkeys(map(ord, "“”„″"), '"') | dict.fromkeys(map(ord, "‐‒–—―"), "-")


def table_form(text: str | None) -> str | None:
    """`text` by the table alone: ignorables dropped, forms folded, accents composed; other alphabets kept."""
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text.translate(_table()))


def folded(text: str) -> str:
    """`text` in the form used for comparing: table form with look-alike letters, marks and case folded."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text.translate(_fold_table()))).lower()


class Trie:
    """Vocabulary trie walked by a weighted edit automaton."""

    def __init__(self, words):
        self.root: dict = {}
        for word, weight in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = weight

    def match(self, token: str, budget: int = 0) -> str | None:
        """The vocabulary word of least cost for `token`, among equals the most frequent, then the smallest; None beyond the budget."""
        return (self.best(token, budget) or (0, 0, None))[2]

    def best(self, token: str, budget: int = 0) -> tuple[int, int, str] | None:
        """(cost, minus texts, word) of the vocabulary word of least cost for `token`; None beyond the budget.

        Free: a look-alike or a form of the table for the letters it stands for, and skipping an ignorable.
        Cost one: any other substitution, insertion or deletion.
        """
        token = unicodedata.normalize("NFC", token)
        steps = [{c, _table().get(ord(c), c), LOOK_ALIKE.get(c, c)} for c in token]
        best: tuple | None = None
        todo, seen = [(0, 0, "", self.root)], {}
        while todo:
            cost, at, word, node = todo.pop()
            if seen.get((at, word), budget + 1) <= cost:
                continue
            seen[at, word] = cost
            if at == len(token) and "" in node:
                key = (cost, -node[""], word)
                best = key if best is None or key < best else best
            if at < len(token):
                for form in steps[at]:
                    x = node
                    for c in form:
                        x = x.get(c) if x is not None else None
                    if x is not None:
                        todo.append((cost, at + 1, word + form, x))
                if cost < budget:
                    todo.append((cost + 1, at + 1, word, node))
                    todo += [(cost + 1, at + 1, word + c, x) for c, x in node.items() if c and c not in steps[at]]
            if cost < budget:
                todo += [(cost + 1, at, word + c, x) for c, x in node.items() if c]
        return best


@lru_cache(None)
def _token() -> re.Pattern:
    letters = r"A-Za-z0-9À-ÖØ-öø-ɏͰ-ϿЀ-џ̀-ͯﬀ-ﬆ"
    wide = "０-９Ａ-Ｚａ-ｚ"
    return re.compile(f"[{letters}{wide}{IGNORABLE}\U0001d400-\U0001d7ff]+|{SUSPECT}")


_SUSPECT = re.compile(SUSPECT)
_OTHER = re.compile("[Ͱ-ϿЀ-џ]")
_LATIN = re.compile("[A-Za-z0-9À-ɏ]")


def suspect_tokens(text: str) -> set[str]:
    """The tokens of `text` that hold a suspicious character, outside garbled spans."""
    if not _SUSPECT.search(text):
        return set()
    spans = garbled_spans(text)
    lossy = re.compile("[а-яА-Я]") if any(re.fullmatch("[Ѐ-џ]", text[a:b]) for a, b, _ in spans) else None
    out = set()
    for m in _token().finditer(text):
        token = m.group()
        if not _SUSPECT.search(token) or any(a < m.end() and m.start() < b for a, b, _ in spans):
            continue
        if lossy and lossy.search(token):  # a page read with the wrong one-byte encoding: its single letters are of that kind
            continue
        out.add(token)
    return out


def edits(token: str) -> int:
    """The edits that cost which `token` may take: EDITS if it's long enough and mixes alphabets, so that a look-alike the table doesn't know, or a misread letter beside one it knows, finds its word; else none."""
    form = table_form(token)
    return EDITS if len(form) >= LONG and _OTHER.search(form) and len(_LATIN.findall(form)) * 2 > len(form) else 0


def canonical(token: str, found: str | None) -> str:
    """The spelling that belongs in the place of `token`: the vocabulary word `found` for it, else the table's form."""
    if found is not None:
        return found
    form = table_form(token)
    if _OTHER.search(form) and _LATIN.search(form):  # mixed alphabets: look-alikes take the Latin letter
        form = "".join(LOOK_ALIKE.get(c, c) for c in form)
    return form


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): Latin-script words of `column` and the number of texts that hold them, at least MIN_TEXTS; over all rows."""
    # Java's pattern has no state to backtrack into here: one class, possessive
    words = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"({_WORD}+)"), F.lit(1)))
    return texts.where(F.col(column).rlike("[A-Za-z]")).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)


def canonical_spellings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, spelling) of each distinct token by the vocabulary (word, n).

    Both sides are sent to the group of their folded first two letters, where edits that cost aren't looked for.
    The vocabulary of a group is dealt to as many tries as it takes for each to hold about TRIE words; a
    token is looked up in all of them, and the best word of all is taken.
    """
    first = F.substring(F.lower("word"), 1, 2)

    @F.pandas_udf("string")
    def part(token: pd.Series) -> pd.Series:
        return pd.Series([folded(t)[:2] for t in token], dtype=object)

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        token, best = left["token"].to_pylist(), []
        if token and len(right):
            trie = Trie(zip(right["word"].to_pylist(), right["n"].to_pylist()))
            best = [(t, *x) for t in token if (x := trie.best(t, edits(t)))]
        t, cost, n, word = zip(*best) if best else ((), (), (), ())
        return pa.table({"token": pa.array(t, pa.string()), "cost": pa.array(cost, pa.int32()), "n": pa.array(n, pa.int64()), "word": pa.array(word, pa.string())})

    words = materialized(words.withColumn("part", first))
    tries = materialized(words.groupBy("part").agg(F.ceil(F.count("*") / TRIE).cast("int").alias("tries")))
    a = materialized(tokens.select("token").distinct().withColumn("part", part("token")))
    left = a.join(tries, "part").select("token", "part", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"))
    right = words.join(sent_if_small(tries), "part").withColumn("trie", F.pmod(F.xxhash64("word"), F.col("tries")).cast("int")).join(sent_if_small(materialized(a.select("part").distinct())), "part", "left_semi")
    met = left.groupBy("part", "trie").cogroup(right.select("part", "trie", "word", "n").groupBy("part", "trie")).applyInArrow(walk, "token string, cost int, n bigint, word string")
    best = met.groupBy("token").agg(F.min(F.struct("cost", "n", "word"))["word"].alias("found"))

    @F.pandas_udf("string")
    def spelling(token: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([canonical(t, w) for t, w in zip(token, found)], dtype=object)

    return a.select("token").join(best, "token", "left").select("token", spelling("token", "found").alias("spelling"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, text) of the three fields, null texts left out."""
    page = spread(table(spark, sf_dir, "document_page").select(F.lit("document_page.text").alias("field_name"), F.col("page_id").alias("record_id"), "text"))
    norm = table(spark, sf_dir, "normalized_page").select(F.lit("normalized_page.raw_text").alias("field_name"), F.col("page_id").alias("record_id"), F.col("raw_text").alias("text"))
    span = table(spark, sf_dir, "evidence_span").select(F.lit("evidence_span.quote").alias("field_name"), F.col("span_id").alias("record_id"), F.col("quote").alias("text"))
    return page.unionByName(norm).unionByName(span).where("text is not null")


def value_tokens(values: DataFrame) -> DataFrame:
    """(field_name, record_id, token): the suspicious tokens of each value."""

    def run(batch):
        out: dict = {"field_name": [], "record_id": [], "token": []}
        for f, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for token in suspect_tokens(t):
                out["field_name"].append(f)
                out["record_id"].append(r)
                out["token"].append(token)
        yield out

    return map_batches(values.select("field_name", "record_id", "text").where(F.col("text").rlike(SUSPECT)), "field_name string, record_id bigint, token string", run)


def changed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, token, spelling) of the tokens that must change."""
    values = fields(spark, sf_dir)
    tokens = materialized(value_tokens(values))
    words = vocabulary(values, "text")
    spellings = canonical_spellings(tokens, words).where(~F.col("token").eqNullSafe(F.col("spelling")))
    return tokens.join(spellings, "token")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_tokens(spark, sf_dir).select("field_name", "record_id").distinct()


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three fields in the consistent form, with a flag whether it changed."""
    change = changed_tokens(spark, sf_dir).groupBy("field_name", "record_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "spelling"))).alias("m"))
    joined = fields(spark, sf_dir).dropDuplicates(["field_name", "record_id"]).join(change, ["field_name", "record_id"], "left")

    @F.pandas_udf("string")
    def apply(text: pd.Series, m: pd.Series) -> pd.Series:
        def one(t, spell):
            spell = dict(spell) if spell is not None else {}
            return _token().sub(lambda x: spell.get(x.group(), x.group()), t) if spell else t

        return pd.Series([one(t, s) for t, s in zip(text, m)], dtype=object)

    return joined.select("field_name", "record_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(apply("text", "m")).alias("text"), F.col("m").isNotNull().alias("changed"))
