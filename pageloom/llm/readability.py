"""Reading level of each document, by a familiar-word formula.

The level grows with the share of words outside a list of familiar words and
with the average sentence length. The list holds, per language, the words that
stand in at least FAMILIAR_SHARE of its documents, all of them counted; as a
document has finitely many words, a list is bounded by the average number of
distinct words of a document over FAMILIAR_SHARE. Chinese is counted in pairs of
adjacent characters and sentence length in characters.

Defined results: null, empty and wordless texts have a null level; documents
without a language are scored with the list (of the same script) that knows
most of their words; ties in frequency are settled by the word itself.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialized, spread, table

#: A familiar word stands in at least this share of a language's documents.
FAMILIAR_SHARE = 0.01
#: The published weights of the familiar-word formula (percentage of other words, words a sentence, constant).
PERCENT, LENGTH, BASE = 0.1579, 0.0496, 3.6365
#: Distinct words a worker counts before it passes them on.
HELD = 300_000

_HAN = re.compile("[㐀-鿿豈-﫿]+")
_WORD = re.compile("[^\\W\\d_]+(?:['’][^\\W\\d_]+)*")


def words(text: str) -> list[str]:
    """The words of `text` in lower case; runs of hanzi give their pairs of adjacent characters."""
    out = []
    for w in _WORD.findall(text.lower()):
        if w < "㐀":
            out.append(w)
        else:
            for run in _HAN.findall(w):
                out += map("".join, zip(run, run[1:])) if len(run) > 1 else [run]
    return out


_SENTENCE = re.compile("[^\\W\\d_][^.!?。！？\\n]*")


def sentence_length(text: str) -> float | None:
    """Average words (hanzi count one each) a sentence; None without words."""
    n = sum(len(w) if w >= "㐀" else 1 for w in _WORD.findall(text))
    return n / len(_SENTENCE.findall(text)) if n else None


def _chinese(text: str) -> bool:
    return sum(map(len, _HAN.findall(text))) * 4 > len(text)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(l, word, df) of docs (t, l): in how many documents of a language a word stands; the word '' counts the documents with words.

    Workers count before the shuffle.
    """

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            flat = [(la, w, n) for la, c in held.items() for w, n in c.items()]
            held.clear()
            la, w, n = zip(*flat) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(la, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["l", "word", "df"])

        for b in batches:
            for t, la in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w := words(t):
                    held.setdefault(la, Counter()).update({"", *w})
            if sum(map(len, held.values())) > HELD:
                yield rows()
        yield rows()

    return docs.select("t", "l").mapInArrow(run, "l string, word string, df bigint").groupBy("l", "word").agg(F.sum("df").alias("df"))


def familiar_words(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = FAMILIAR_SHARE) -> DataFrame:
    """(l, word): the familiar words of each language."""
    part = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    df = materialized(document_frequencies(part))
    total = df.where("word = ''").select("l", F.col("df").alias("n"))  # a row a language code
    return df.where("word <> ''").join(F.broadcast(total), "l").where(F.col("df") >= share * F.col("n")).select("l", "word")


def reading_levels(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = FAMILIAR_SHARE) -> DataFrame:
    """(key, lang, unfamiliar_share, sentence_length, level) of each document; lang is the list that was used."""
    lists: dict[str, set[str]] = {}
    # bounded for each language code by the share (see above)
    for la, w in familiar_words(docs, text, lang, share).collect():
        lists.setdefault(la, set()).add(w)
    known = docs.sparkSession.sparkContext.broadcast(lists)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, lang string, unfamiliar_share double, sentence_length double"

    def one(t, la):
        ws = words(t) if t else []
        if not ws:
            return la, None, None
        if la not in known.value:
            wide = _chinese(t)
            fit = [(sum(w in x for w in ws), name) for name, x in known.value.items() if (name[:2] == "zh") == wide]
            la = max(fit, default=(0, la))[1]
        familiar = known.value.get(la, set())
        return la, sum(w not in familiar for w in ws) / len(ws), sentence_length(t)

    def run(batches):
        for b in batches:
            rows = [one(t, la) for t, la in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            la, other, length = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(la, pa.string()), pa.array(other, pa.float64()), pa.array(length, pa.float64())], names=[key, "lang", "unfamiliar_share", "sentence_length"])

    level = BASE + PERCENT * 100 * F.col("unfamiliar_share") + LENGTH * F.col("sentence_length")
    return docs.select(key, text, lang).mapInArrow(run, schema).withColumn("level", level)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = materialized(reading_levels(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))).select("doc_id", "level"))
    pair = table(spark, sf_dir, "reading_pair").distinct()
    side = pair.select("pair_id", F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id"))
    # the greater level; of equal ones the smaller id
    best = F.max_by("doc_id", F.struct(F.coalesce("level", F.lit(-1.0)), -F.col("doc_id")))
    return side.join(levels, "doc_id").groupBy("pair_id").agg(best.alias("doc_id"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document, with its rank within the language as a share."""
    levels = reading_levels(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    return levels.select("doc_id", "lang", *[F.round(c, 6).alias(c) for c in ("unfamiliar_share", "sentence_length", "level")])


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language and level, in whole levels."""
    levels = reading_levels(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    return levels.groupBy("lang", F.floor("level").cast("int").alias("level")).agg(F.count("*").alias("documents"))
