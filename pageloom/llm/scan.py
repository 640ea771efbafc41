"""Noise in text from scanned pages: find it, and repair the text into continuous paragraphs.

Words are Latin-script tokens (digits of numbers masked) and, around hanzi that
have look-alikes, windows of five characters. Over the whole corpus each word is
counted. A rare word and a frequent one that differs from it only by plausible
glyph edits (both fall on one key when the glyphs of a class are merged) are a
candidate; for the words of the candidates skip-gram vectors are trained: the
words and their contexts (the two units before and after) get vectors that tell,
by logistic loss, the contexts a word has from those it would have by chance.
Training alternates: workers fit the words' vectors to those of the contexts and
sum the contexts' gradients, until ROUNDS are done; it uses every occurrence in
the corpus and, in place of sampled negatives, their expectation. A rare word is
linked to its frequent neighbour if their vectors point the same way, and is a
misreading on a page where its contexts fit the word it's linked to. Misreadings
are corrected there; then furniture is removed, words cut at line ends are
joined and lines are reflowed.

Defined results: null and empty texts have no noise and repair to themselves; a
hyphen that the corpus writes within lines too is its own; page numbers and
running headers aren't searched for misreadings; a word without contexts fits;
pages delivered twice count once in the result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SENT_BYTES, map_batches, materialized, parts, sent_if_small, spread, table
from .charforms import folded
from .furniture import line_kinds
from .numeric import Batch, mixed, span_hash, sums, tables

#: Hanzi that are misread for one another, written in pairs.
HANZI_PAIRS = (
    "入人 曰日 木本 朝期 验险 忖付 珍诊 么公 颔额 全金 绐给 田由 台合 列例 皖院 爱受 往住 甩用 射身 困因 兔免 清请 郊效 纳约 甲申 冶治 络终 末未 贵责 "
    "已己 巳己 土士 千干 于干 大太 犬大 天夫 无元 刀力 儿几 八入 目日 白自 自目 王玉 玉五 主王 牛午 午干 手毛 贝见 风凤 乌鸟 鸣呜 晴睛 清晴 拔拨 折拆 "
    "析折 侯候 徒徙 戍戌 戊戍 辨辩 辩辫 货贷 贷贫 炙灸 崇祟 暑署 署薯 冒胃 胄胃 盲肓 侍待 持待 特持 扣和 仑仓 令今 今令 历厉 厂广 仿访 坊防 幻幼 挖控 "
    "栽裁 载栽 抱拘 狠狼 很狠 洒酒 汤杨 场扬 枚牧 妹姝 传佳 何河 亨享 享亭 凉谅 籍藉 徽微 壁璧 毫亳 赢羸 茶荼 斥斤 厘厦 原源 叚段 拆诉 "
)
#: Latin letters and digits that are misread for one another, as classes; two letters read as one.
LATIN_CLASSES, MERGED = ("ce", "li1", "bh", "ft", "o0", "s5"), ("rn", "m")
#: Letters read for digits within numbers.
DIGIT_LETTERS = "osli"
#: A rare word is at least so many times rarer than the word it is linked to.
RATIO = 3
#: Dimensions of the vectors, and buckets that the contexts are hashed into (the size of the model).
DIMENSIONS, CONTEXTS = 32, 4096
#: Rounds of training, steps of a word's vector in a round, negative contexts for each real one, and weight of the vectors' squares.
ROUNDS, STEPS, NEGATIVES, SQUARES = 4, 6, 1.0, 0.5
#: Least cosine of the vectors of linked words, for a word seen often, and the occurrences at which it's half sure: of n, it is COSINE * sqrt(n / (n + DOUBT)).
COSINE, DOUBT = 0.7, 4
#: Least mean score of a page's contexts with the word meant.
FITS = 0.0
#: Words fitted together.
FITTED = 512
#: Words a worker holds before it passes their counts on.
HELD = 400_000
#: What stands in a window for what lies beyond a page's end.
EDGE = 0x2E3A
#: Bits of a character's kind: stands in words, digit, letter read for a digit, sign of a wrong encoding, such a sign or hanzi, space, hanzi with look-alikes, Latin letter.
TOKEN, DIGIT, SMALL, ODD, STRANGE, SPACE, LOOKS, LATIN = (1 << i for i in range(8))


def _classes() -> dict[str, str]:
    root: dict[str, str] = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    for pair in HANZI_PAIRS.split():
        a, b = find(pair[0]), find(pair[1])
        root[max(a, b)] = min(a, b)
    return {c: find(c) for pair in HANZI_PAIRS.split() for c in pair}


_CLASS = _classes()
_tables: dict = {}


def _glyphs() -> dict[str, np.ndarray]:
    if not _tables:
        t = tables()
        latin = t["letter"].copy()
        latin[0x250:] = False
        rep = np.arange(0x10000, dtype=np.uint32)
        for c in LATIN_CLASSES:
            for x in c:
                rep[ord(x)] = ord(c[0])
        han = np.zeros(0x10000, np.uint32)
        for c, r in _CLASS.items():
            han[ord(c)] = ord(r)
        letters = np.zeros(0x10000, bool)
        letters[[ord(c) for c in DIGIT_LETTERS]] = True
        # what stands in text read with a wrong encoding, and hardly in a word's neighbourhood otherwise
        odd = np.zeros(0x10000, bool)
        for lo, hi in ((0x80, 0xA0), (0xA1, 0xC0), (0x2C6, 0x300), (0x400, 0x530), (0x2200, 0x2300), (0x2500, 0x25A0), (0x3105, 0x3130), (0xE000, 0xF900), (0xFF61, 0xFFA0), (0xFFFD, 0xFFFE)):
            odd[lo:hi] = True
        odd[[ord(c) for c in "§«»·°£"]] = False
        shown = np.where(han > 0, han, np.arange(0x10000, dtype=np.uint32))
        unit = (mixed(t["mix"][shown]) % np.uint64(CONTEXTS)).astype(np.int32)
        unit[EDGE] = -1
        token = latin | t["digit"] & (np.arange(0x10000) < 128)
        kinds = ((TOKEN, token), (DIGIT, t["digit"]), (SMALL, letters), (ODD, odd), (STRANGE, odd | t["han"]), (SPACE, t["space"]), (LOOKS, han > 0), (LATIN, latin))
        _tables.update(unit=unit, rep=rep, han=han, kind=sum(np.where(there, bit, 0) for bit, there in kinds).astype(np.uint8))
    return _tables


def _counts(there: np.ndarray) -> np.ndarray:
    """How often it's true before each place, and in all."""
    out = np.zeros(len(there) + 1, np.int32)
    np.cumsum(there, out=out[1:])
    return out


def batch_words(texts: list[str | None], units: bool = False) -> dict[str, np.ndarray]:
    """Of each word: row, hash, key; functions from indices to strings (`text`) and to the buckets of the contexts (`ctx`: four columns, -1 for none); and, with `units`, how often each bucket's unit stands there."""
    g = _glyphs()
    b = Batch(texts)
    cp, row = b.cp, b.row
    n = len(cp)
    if n < 8:
        return {"row": np.empty(0, np.int64), "hash": np.empty(0, np.int64), "key": np.empty(0, np.int64), "ctx": lambda i: np.empty((len(i), 4), np.int32), "text": lambda i: [], "units": np.zeros(CONTEXTS, np.int64)}
    # words cut at a line end are whole
    kind = g["kind"][cp]
    i = np.flatnonzero(cp[1:-2] == 45) + 1
    i = i[(cp[i + 1] == 10) & (kind[i - 1] & kind[i + 2] & LATIN > 0) & (row[i - 1] == row[i + 2])]
    if len(i):
        whole = np.ones(n, bool)
        whole[i] = whole[i + 1] = False
        cp, row, kind = cp[whole], row[whole], kind[whole]
    tok = kind & TOKEN
    edge = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])]))
    stop = np.append(edge[1:], len(cp))
    keep = tok[edge] > 0
    start, stop = edge[keep], stop[keep]
    c_digit = _counts(kind & DIGIT > 0)
    letters_only = c_digit[np.append(start[1:], len(cp))[: len(start)]] == c_digit[start]
    bad = np.zeros(len(start), bool)
    for side, there in ((start - 1, start > 0), (stop, stop < len(cp))):
        side = np.clip(side, 0, len(cp) - 1)
        bad |= there & (row[side] == row[start]) & (kind[side] & np.where(letters_only, STRANGE, ODD).astype(np.uint8) > 0)
    keep = ~bad & ~(letters_only & (stop - start < 2))
    start, stop = start[keep], stop[keep]
    size = stop - start
    number = np.flatnonzero(c_digit[stop] > c_digit[start])
    c_either = _counts(kind & (DIGIT | SMALL) > 0)
    number = number[(c_either[stop] - c_either[start] == size)[number]]
    inside = np.repeat(start[number] - np.cumsum(size[number]) + size[number], size[number]) + np.arange(size[number].sum())  # the places within numbers
    word, key = cp.copy(), g["rep"][cp]
    word[inside[kind[inside] & DIGIT > 0]] = 48
    key[inside] = g["rep"][ord("o")]
    rn = np.flatnonzero((cp[:-1] == ord("r")) & (cp[1:] == ord("n")))
    key[rn] = ord("m")
    key[rn + 1] = 0  # hashed as nothing
    s_word = sums(word)
    live = key > 0
    at = _counts(live)
    s_key = sums(key[live])
    h, k = span_hash(s_word, start, stop), span_hash(s_key, at[start], at[stop])
    r = row[start].astype(np.int64)
    # windows around hanzi that have look-alikes, over the text without spaces of the pages that hold any; EDGE stands beyond a page's ends
    shown = np.zeros(b.rows, bool)
    shown[row[kind & LOOKS > 0]] = True
    solid = np.flatnonzero((kind & SPACE == 0) & shown[row])
    r2, kind = row[solid], kind[solid]
    spot = np.arange(len(r2)) + 4 * (r2.astype(np.int64) + 1)
    c2 = np.full(len(r2) + 4 * (b.rows + 1), EDGE, np.uint32)
    c2[spot] = np.where(kind & DIGIT > 0, np.uint32(48), cp[solid])
    here = np.flatnonzero(kind & LOOKS)
    odd = g["kind"][c2[spot[here] - 2]]
    for d in (-1, 0, 1, 2):
        odd = odd | g["kind"][c2[spot[here] + d]]
    here = here[odd & ODD == 0]
    centre, r2 = spot[here], r2[here]
    s2 = sums(c2)
    hw = span_hash(s2, centre - 2, centre + 3)
    kw = mixed(span_hash(s2, centre - 2, centre) * np.uint64(3) + span_hash(s2, centre + 1, centre + 3) + g["han"][c2[centre]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    unit_of = lambda i: (k[i] % np.uint64(CONTEXTS)).astype(np.int32)
    unit = g["unit"]
    m = len(h)

    def text(index):
        out = []
        for x in index.tolist():
            part = word[start[x] : stop[x]] if x < m else c2[centre[x - m] - 2 : centre[x - m] + 3]
            out.append("".join(map(chr, part.tolist())))
        return out

    def ctx(index):
        out = np.empty((len(index), 4), np.int32)
        word_ = index < m
        i, c = index[word_], centre[index[~word_] - m]
        beside = np.stack([i + d for d in (-2, -1, 1, 2)], 1)
        there = np.clip(beside, 0, max(0, m - 1))
        out[word_] = np.where((beside == there) & (r[there] == r[i][:, None]), unit_of(there), -1) if len(i) else -1
        out[~word_] = np.stack([unit[c2[c + d]] for d in (-4, -3, 3, 4)], 1)
        return out

    every = np.zeros(CONTEXTS, np.int64)
    if units:
        beside = unit[c2[np.concatenate([centre - 3, centre + 3])]]
        every += np.bincount(unit_of(slice(None)), minlength=CONTEXTS) + np.bincount(beside[beside >= 0], minlength=CONTEXTS)
    return {
        "row": np.concatenate([r, r2.astype(np.int64)]),
        "hash": np.concatenate([h, hw]).view(np.int64),
        "key": np.concatenate([k, kw]).view(np.int64),
        "ctx": ctx,
        "units": every,
        "text": text,
    }


def word_table(pages: DataFrame, text: str = "text") -> DataFrame:
    """(hash, key, word, n) of every word of the corpus; workers count before the shuffle."""
    names = ["hash", "key", "word", "n"]

    def fold(held):
        u, first, inv = np.unique(np.concatenate([p[0] for p in held]), return_index=True, return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([p[3] for p in held]), minlength=len(u)).astype(np.int64)
        words = [w for p in held for w in p[2]]
        return u, np.concatenate([p[1] for p in held])[first], [words[i] for i in first.tolist()], n

    def emit(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.array(p[2], pa.string()), pa.array(p[3])], names=names)

    def run(batches):
        held = []
        for _, texts in parts(batches, 0):
            w = batch_words(texts)
            u, first, n = np.unique(w["hash"], return_index=True, return_counts=True)
            if not len(u):
                continue
            held.append((u, w["key"][first], w["text"](first), n))
            if sum(len(p[0]) for p in held) > HELD:
                held = [fold(held)]
                if len(held[0][0]) > HELD // 2:
                    yield emit(held.pop())
        if held:
            yield emit(fold(held))

    part = pages.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "hash bigint, key bigint, word string, n bigint")
    return part.groupBy("hash").agg(F.min("key").alias("key"), F.min("word").alias("word"), F.sum("n").alias("n"))


def candidates(words: DataFrame) -> DataFrame:
    """(hash, word, n, meant_hash, meant, n_meant): rare words and the frequent word that differs by plausible glyph edits."""
    top = words.groupBy("key").agg(F.max(F.struct("n", "word", "hash")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    x = words.join(top, "key").where((F.col("n") * RATIO <= F.col("top.n")) & (F.col("word") != F.col("top.word")))
    return x.select("hash", "word", "n", F.col("top.hash").alias("meant_hash"), F.col("top.word").alias("meant"), F.col("top.n").alias("n_meant"))


def context_counts(pages: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(hash, bucket, n): how often a context of each bucket stands beside each of the words `wanted` (hash); with a null hash, how often its unit stands anywhere. Workers count before the shuffle."""
    few = wanted.count() * 16 <= SENT_BYTES
    sent = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64)) if few else None)

    def fold(held):
        h, c, n = (np.concatenate([p[i] for p in held]) for i in range(3))
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)])
        return h[first], c[first], np.add.reduceat(n, first) if len(first) else n

    def emit(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0], pa.int64()), pa.array(p[1], pa.int32()), pa.array(p[2], pa.int64())], names=["hash", "bucket", "n"])

    def run(batches):
        every, held = np.zeros(CONTEXTS, np.int64), []
        for _, texts in parts(batches, 0):
            w = batch_words(texts, units=True)
            every += w["units"]
            if few and len(sent.value):
                at = np.searchsorted(sent.value, w["hash"])
                take = np.flatnonzero(sent.value[np.minimum(at, len(sent.value) - 1)] == w["hash"])
            else:
                take = np.arange(0 if few else len(w["hash"]))
            ctx = w["ctx"](take)
            h, there = np.repeat(w["hash"][take], ctx.shape[1]), ctx.ravel() >= 0
            held.append((h[there], ctx.ravel()[there], np.ones(there.sum(), np.int64)))
            if sum(len(p[0]) for p in held) > HELD:
                held = [fold(held)]
                if len(held[0][0]) > HELD // 2:
                    yield emit(held.pop())
        if held:
            yield emit(fold(held))
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(every[some])], names=["hash", "bucket", "n"])

    part = pages.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "hash bigint, bucket int, n bigint")
    if not few:
        part = part.where("hash is null").unionByName(part.join(wanted, "hash", "left_semi"))
    return part.groupBy("hash", "bucket").agg(F.sum("n").alias("n"))


def fitted(count: np.ndarray, chance: np.ndarray, u: np.ndarray, v: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The vectors `v` of words after steps uphill: `count` holds the words' contexts (a row a word), `chance` each context's share of all, `u` the contexts' vectors."""
    total = count.sum(1, keepdims=True)
    drawn = count + NEGATIVES * total * chance
    rate = 1 / (SQUARES + 0.25 * (1 + NEGATIVES) * total * max(1e-6, float((u * u).sum(1).max())) / 2)
    for _ in range(steps):
        score = 1 / (1 + np.exp(-np.clip(v @ u.T, -30, 30)))
        v = v + rate * ((count - drawn * score) @ u - SQUARES * v)
    return v


def _first_vectors() -> np.ndarray:
    return np.random.default_rng(17).normal(0, DIMENSIONS**-0.5, (CONTEXTS, DIMENSIONS)).astype(np.float32)


def trained(counts: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The contexts' vectors (a table of the model's fixed size) and (hash, vector) of each word of `counts` (hash, bucket, n)."""
    spark = counts.sparkSession
    chance = np.zeros(CONTEXTS, np.float32)
    for bucket, n in counts.where("hash is null").select("bucket", "n").collect():  # CONTEXTS rows at most
        chance[bucket] = n
    chance /= max(1.0, chance.sum())
    # a word has CONTEXTS buckets at most
    words = materialized(counts.where("hash is not null").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).select("hash", F.col("c.bucket").alias("bucket"), F.col("c.n").alias("n")))
    u = _first_vectors()

    def each(batches, u):
        for b in batches:
            for i in range(0, b.num_rows, FITTED):
                part = b.slice(i, FITTED)
                buckets, n = part.column(1), part.column(2)
                count = np.zeros((part.num_rows, CONTEXTS), np.float32)
                rows = np.repeat(np.arange(part.num_rows), np.diff(buckets.offsets.to_numpy()))
                count[rows, buckets.flatten().to_numpy()] = n.flatten().to_numpy()
                yield part, count, fitted(count, chance, u, np.zeros((part.num_rows, DIMENSIONS), np.float32))

    d = [f"d{i}" for i in range(DIMENSIONS)]
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(u)

        def gradients(batches, sent=sent):
            up, bend = np.zeros((CONTEXTS, DIMENSIONS)), np.zeros(CONTEXTS)
            for _, count, v in each(batches, sent.value):
                drawn = count + NEGATIVES * count.sum(1, keepdims=True) * chance
                score = 1 / (1 + np.exp(-np.clip(v @ sent.value.T, -30, 30)))
                up += (count - drawn * score).T @ v
                bend += drawn.T @ (v * v).sum(1) / 4
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS, dtype=np.int32)), pa.array(bend), *(pa.array(np.ascontiguousarray(up[:, i])) for i in range(DIMENSIONS))], names=["bucket", "bend", *d])

        moved = words.mapInArrow(gradients, f"bucket int, bend double, {', '.join(f'{x} double' for x in d)}")
        u = u.copy()
        for row in moved.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in ("bend", *d)]).collect():  # CONTEXTS rows
            u[row[0]] += (np.array(row[2:]) - SQUARES * u[row[0]]) / (SQUARES + row[1])
        sent.unpersist()
    last = spark.sparkContext.broadcast(u)

    def vectors(batches):
        for part, _, v in each(batches, last.value):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel(), pa.float32()), DIMENSIONS).cast(pa.list_(pa.float32()))], names=["hash", "vector"])

    return u, words.mapInArrow(vectors, "hash bigint, vector array<float>")


def links(found: DataFrame, vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(hash, word, n, meant, n_meant, cosine, vector): the candidates whose vectors point the same way; `vector` is that of the word meant. A word without contexts has cosine 0 and isn't linked."""
    own = vectors.select("hash", F.col("vector").alias("own"))
    far = vectors.select(F.col("hash").alias("meant_hash"), "vector")
    x = found.join(own, "hash").join(far, "meant_hash")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, y: s + y)
    cosine = F.coalesce(F.try_divide(dot("own", "vector"), F.sqrt(dot("own", "own") * dot("vector", "vector"))), F.lit(0.0))
    sure = F.sqrt(F.col("n") / (F.col("n") + DOUBT))
    return x.withColumn("cosine", F.round(cosine, 6)).where(F.col("cosine") >= least * sure).select("hash", "word", "n", "meant", "n_meant", "cosine", "vector")


def learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The words of all pages, the links between them, and the contexts' vectors."""
    raw = spread(table(spark, sf_dir, "document_page").select("text"))
    words = materialized(word_table(raw))
    found = materialized(candidates(words))
    wanted = materialized(found.select(F.explode(F.array("hash", "meant_hash")).alias("hash")).distinct())
    u, vectors = trained(materialized(context_counts(raw, wanted)))
    return words, materialized(links(found, materialized(vectors))), u


_HAN = re.compile("[㐀-鿿]")
_HYPHEN = re.compile(r"[-‐‑](?<=[^\W\d_].)\s*\n\s*(?=[^\W\d_])")  # the mark first, so that the search runs from mark to mark
_LETTERS = re.compile(r"[^\W\d_]+")


def _halves(m: re.Match) -> tuple[str, str]:
    """The letters before and after a hyphen at a line end."""
    text, a = m.string, m.start()
    while a and text[a - 1].isalpha():
        a -= 1
    return text[a : m.start()], _LETTERS.match(text, m.end()).group()


def words_cut(text: str) -> set[tuple[str, str]]:
    """The halves of words that a hyphen at a line end cuts."""
    return {_halves(m) for m in _HYPHEN.finditer(text)}


def fits(ctx: np.ndarray, vector: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whether the contexts `ctx` (buckets, -1 for none; a row an occurrence) fit the words with these vectors: their mean score is FITS at least."""
    there = ctx >= 0
    score = np.einsum("nkd,nd->nk", u[np.maximum(ctx, 0)], vector)
    return (score * there).sum(1) >= FITS * np.maximum(1, there.sum(1))


def page_noise(pages: DataFrame, linked: DataFrame, u: np.ndarray) -> DataFrame:
    """(page_id, noise_kind, joined, compound, hash) of pages (page_id, text, name).

    Kind `cut` rows hold the two spellings of a word cut at a line end, kind `misread` rows the misread word.
    """
    few = linked.count() * (DIMENSIONS * 4 + 16) <= SENT_BYTES
    known = sorted(linked.select("hash", "vector").collect()) if few else []
    vectors = np.array([r[1] for r in known], np.float32).reshape(len(known), DIMENSIONS)
    sent = pages.sparkSession.sparkContext.broadcast((np.array([r[0] for r in known], np.int64), vectors, u))

    def look(batch, texts):
        out: dict = {"page_id": [], "noise_kind": [], "joined": [], "compound": [], "hash": [], "ctx": []}

        def add(p, kind, joined=None, compound=None, h=None, ctx=None):
            for k, v in zip(out, (p, kind, joined, compound, h, ctx)):
                out[k].append(v)

        ids, bodies = batch.column(0).to_pylist(), []
        for p, t, name in zip(ids, texts, batch.column(2).to_pylist()):
            _, number, header = line_kinds(t, name)
            if any(number):
                add(p, "page_number")
            if any(header):
                add(p, "running_header")
            bodies.append("\n".join("" if a or b else x for x, a, b in zip(t.split("\n"), number, header)))
            for a, b in words_cut(bodies[-1]):
                if b[0].islower() and not _HAN.search(a + b):
                    add(p, "cut", folded(a + b), folded(a + "-" + b))
        w = batch_words(bodies)
        hashes, vector, contexts = sent.value
        if few:
            at = np.searchsorted(hashes, w["hash"])
            hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == w["hash"]) if len(hashes) else np.empty(0, np.int64)
            hit = hit[fits(w["ctx"](hit), vector[at[hit]], contexts)] if len(hit) else hit
            for r, h in set(zip(w["row"][hit].tolist(), w["hash"][hit].tolist())):
                add(ids[r], "misread", None, None, h)
        else:
            for r, h, c in zip(w["row"].tolist(), w["hash"].tolist(), w["ctx"](np.arange(len(w["hash"]))).tolist()):
                add(ids[r], "word", None, None, h, c)
        return out

    def run(batch):
        for part, texts in parts([batch], 1):
            yield look(part, texts)

    def fitting(batch):
        hit = fits(np.array(batch.column(2).to_pylist(), np.int32).reshape(batch.num_rows, 4), np.array(batch.column(3).to_pylist(), np.float32).reshape(batch.num_rows, DIMENSIONS), sent.value[2])
        yield {"page_id": batch.column(0).filter(pa.array(hit)), "hash": batch.column(1).filter(pa.array(hit))}

    noise = map_batches(pages.select("page_id", "text", "name").where("text is not null"), "page_id bigint, noise_kind string, joined string, compound string, hash bigint, ctx array<int>", run)
    if not few:
        noise = materialized(noise)
        met = noise.where("noise_kind = 'word'").join(linked.select("hash", "vector"), "hash").select("page_id", "hash", "ctx", "vector")
        misread = map_batches(met, "page_id bigint, hash bigint", fitting).distinct().select("page_id", F.lit("misread").alias("noise_kind"), F.lit(None).cast("string").alias("joined"), F.lit(None).cast("string").alias("compound"), "hash")
        noise = noise.where("noise_kind <> 'word'").drop("ctx").unionByName(misread)
    return noise.drop("ctx")


def compound_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """(compound, n): words written with a hyphen within lines, and their occurrences over all pages."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+-[\p{L}]+)(?=[^\p{L}-])"), F.lit(1))
    return pages.where(F.col(text).contains("-")).select(F.explode(found).alias("compound")).groupBy("compound").agg(F.count("*").alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark_source").groupBy("source_id").agg(F.min("source_name").alias("name"))
    pages = spread(table(spark, sf_dir, "document_page").select("page_id", "source_id", "text"))
    return pages.join(sent_if_small(names), "source_id", "left").select("page_id", "text", "name")


def noise_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Noise rows (page_id, noise_kind, hash); the words cut at line ends (page_id, joined); and the links."""
    words, linked, u = learnt(spark, sf_dir)
    noise = materialized(page_noise(_pages(spark, sf_dir), linked, u))
    cut = noise.where("noise_kind = 'cut'")
    whole = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    own = compound_counts(table(spark, sf_dir, "document_page").select("text")).select("compound", F.col("n").alias("n_compound"))
    cut = cut.join(whole, "joined", "left").join(own, "compound", "left").where("coalesce(n_compound, 0) <= coalesce(n_joined, 0)")
    return noise.where("noise_kind <> 'cut'").select("page_id", "noise_kind", "hash"), cut.select("page_id", "joined"), linked


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise, cut, _ = noise_cases(spark, sf_dir)
    return noise.select("page_id", "noise_kind").unionByName(cut.select("page_id", F.lit("hyphenation").alias("noise_kind"))).distinct()


_AS_DIGIT = {"o": "0", "s": "5", "l": "1", "i": "1"}


@lru_cache(20_000)
def _correction(word: str, meant: str):
    """Pattern and replacement for one misread word; windows change their middle character, numbers their letters, other words keep their case."""
    if len(word) == len(meant) == 5 and word[:2] + word[3:] == meant[:2] + meant[3:] and _HAN.match(word[2]):
        edge = ["", r"\A", "", r"\Z", ""] if ord(word[1]) == EDGE or ord(word[3]) == EDGE else [r"\A", "", "", "", r"\Z"]
        p = [r"\d" if c == "0" else edge[i] if ord(c) == EDGE else re.escape(c) for i, c in enumerate(word)]
        return re.compile(f"({p[0]}\\s*{p[1]}\\s*){p[2]}(\\s*{p[3]}\\s*{p[4]})", re.I), lambda m: m[1] + meant[2] + m[2]
    if set(meant) == {"0"}:
        p = "".join(r"\d" if c == "0" else c for c in word)
        return re.compile(rf"(?<![^\W_]){p}(?![^\W_])", re.I), lambda m: "".join(c if c.isdigit() else _AS_DIGIT.get(c, c) for c in m[0].lower())
    p = "(?:-\n)?".join(map(re.escape, word))
    return re.compile(rf"(?<![^\W\d_]){p}(?![^\W\d_])", re.I), lambda m: meant.capitalize() if m[0][0].isupper() else meant


def corrected(text: str, words: dict[str, str]) -> str:
    """`text` with its misread words replaced."""
    for word, meant in words.items():
        pattern, replace = _correction(word, meant)
        text = pattern.sub(replace, text)
    return text


def reflowed(text: str, cut: set[str]) -> str:
    """`text` as paragraphs: words cut at line ends joined, wrapped lines joined, blank lines and unwrapped ends kept as breaks."""
    text = _HYPHEN.sub(lambda m: "" if folded("".join(_halves(m))) in cut else "-", text)
    lines = [x.strip() for x in text.split("\n")]
    width = max(map(len, lines), default=0)
    out, open_ = [], False
    for x in lines:
        if not x:
            open_ = False
            continue
        if open_:
            glue = "" if out[-1][-1] > "⺀" or x[0] > "⺀" else " "
            out[-1] += glue + x
        else:
            out.append(x)
        open_ = len(x) >= 0.75 * width and not re.search("[.。！？!?:：]$", x)
    return "\n".join(out)


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without furniture and misreadings, as continuous paragraphs."""
    noise, cut, linked = noise_cases(spark, sf_dir)
    misread = noise.where("noise_kind = 'misread'").join(linked, "hash").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("words"))
    joined = cut.groupBy("page_id").agg(F.collect_set("joined").alias("cut"))
    pages = _pages(spark, sf_dir).dropDuplicates(["page_id"]).join(misread, "page_id", "left").join(joined, "page_id", "left")

    def run(batch):
        out: dict = {"page_id": [], "text": []}
        for p, t, name, words, cuts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if t:
                _, number, header = line_kinds(t, name)
                t = "\n".join(x for x, a, b in zip(t.split("\n"), number, header) if not a and not b)
                t = reflowed(corrected(t, dict(words or ())), set(cuts or ()))
            out["page_id"].append(p)
            out["text"].append(t)
        yield out

    return map_batches(pages.select("page_id", "text", "name", "words", "cut"), "page_id bigint, text string", run)


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every misread word of the corpus with the word it stands for, and the cosine of their vectors."""
    return learnt(spark, sf_dir)[1].select("word", "meant", "n", "n_meant", "cosine")
