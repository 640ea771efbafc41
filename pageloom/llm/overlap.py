"""Same or nearly same records across splits.

Pages become bodies, without layout, repeated lines, headers and page numbers;
pages with the same body are one class. The bodies are concatenated into a sparse
suffix array: suffixes start at anchors chosen by their content (local minima of
a rolling hash, and the first character), so that equal spans have equal anchors
wherever they stand; short texts have one at every character. The array is
partitioned by the hash of the suffixes' first PREFIX characters and, in a
partition, ordered by prefix and by the letters that follow up to the next
anchor, so that suffixes with a common prefix are neighbours and the common
prefix of any two is the least one between them. Suffixes of different splits with a common prefix are a
shared span, from the anchor to the end of the common prefix or to the next
anchor. A suffix brings the marks of all anchors of its record along, so that a
pair of records is known at once to have enough in common or is dropped before
anything is shuffled; the spans of the rest are merged into the part of the
records they cover. These pairs are compared exactly by edit distance and
expanded to the pairs of pages asked for.

Defined results: null, empty and unreadable texts (fewer than READABLE letters
beyond replacement marks) are in no pair; sources without a split are in no
pair; records delivered twice count once; groups of any size are compared in
full, large ones in blocks, and the result doesn't depend on batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate
from .base import map_batches, materialized, parts, sent_if_small, spread, table
from .furniture import line_kinds
from .numeric import Batch, span_hash, sums, tables

#: Anchors are minima over so many characters to both sides; characters of the rolling hash, of the prefix, and of the letters after it that order the array.
WINDOW, GRAM, PREFIX, LETTERS = 16, 8, 32, 32
#: Texts of at most so many characters have a suffix of so many characters at every place: of alike ones (DIFFER), one suffix at least is the same.
SHORT, SMALL = 120, 5
#: Suffixes of a side in a block of a large group; suffix pairs looked at together; classes in a block of the exact comparison; pairs looked at together.
BLOCK, MEET, CLASSES, PAIRS = 4096, 1 << 20, 8192, 64
#: Candidates share at least this share of the anchors of the record with more, and their merged spans cover this share of the longer.
ANCHORS, COVERAGE = 0.1, 0.08
#: Bits of the table that anchors' marks are compared in.
BITS = 2048
#: Records are alike if at most this share of the longer one's characters differs.
DIFFER = 0.14
#: Letters a readable record has at least.
READABLE = 20

_LOST = re.compile("(?:锟斤拷?|斤拷|锟|�)+[锟斤拷�]*")


def anchors(texts: list[str | None], order: bool = True) -> dict[str, np.ndarray]:
    """Of each anchor: row, hash of its prefix, place from the row's start, characters to its end, to the next anchor, and of its prefix; and, for the `order` of the array, `letters`, those after the prefix and before the next anchor, as strings of at most LETTERS characters."""
    b = Batch(texts)
    t = tables()
    space = t["space"][b.cp]
    space |= (b.cp == 0xFFFD) | (b.cp == 0x951F) | (b.cp == 0x65A4) | (b.cp == 0x62F7)  # marks of lost text
    b.take(~space)
    cp, row, n = b.cp, b.row, len(b.cp)
    letters = np.bincount(row, weights=t["letter"][cp], minlength=b.rows) if n else np.zeros(b.rows)
    if n < GRAM:
        return {k: np.empty(0, np.int64) for k in ("row", "prefix", "at", "rest", "gap", "length")} | {"letters": np.empty(0, f"U{LETTERS}")}
    s = sums(cp)
    pos, most = np.arange(n - GRAM + 1), np.iinfo(np.uint64).max
    own = row[pos] == row[pos + GRAM - 1]
    place = pos + row[pos].astype(np.int64) * WINDOW  # gaps between the rows, so that no window reaches into another
    h = np.full(n + b.rows * WINDOW, most, np.uint64)
    h[place] = np.where(own, span_hash(s, pos, pos + GRAM), most)
    low = sliding_window_view(h, WINDOW).min(1)
    full = np.full(WINDOW - 1, most, np.uint64)
    least = (h <= np.concatenate([low, full])) & (h <= np.concatenate([full, low]))
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(pos)]
    enough = letters[row] >= READABLE
    here = np.flatnonzero((least[place] & own | first) & enough[: len(pos)])
    here = here[here + PREFIX <= np.searchsorted(row, row[here], "right")]
    short = np.flatnonzero((np.bincount(row, minlength=b.rows) <= SHORT)[row] & enough)
    short = short[short + SMALL <= np.searchsorted(row, row[short], "right")]
    start, length = np.concatenate([here, short]), np.repeat([PREFIX, SMALL], [len(here), len(short)])
    r = row[start]
    stop = np.searchsorted(row, r, "right")
    gap = np.minimum(np.concatenate([np.append(x[1:], n)[: len(x)] for x in (here, short)]), stop) - start
    out = {"row": r.astype(np.int64), "prefix": span_hash(s, start, start + length).view(np.int64), "at": start - np.searchsorted(row, r), "rest": stop - start, "gap": gap, "length": length}
    if not order:
        return out
    # the letters after the prefix; from the next anchor on, where every span ends, nothing
    where = (start + length)[:, None] + np.arange(LETTERS)
    after = np.where(where < (start + gap)[:, None], cp[np.minimum(where, n - 1)], np.uint32(0)).astype(np.uint32)
    return out | {"letters": np.ascontiguousarray(after).view(f"U{LETTERS}").ravel()}


def anchor_marks(row: np.ndarray, prefix: np.ndarray, rows: int) -> list[bytes]:
    """Of each row the marks of its anchors, numbers below BITS: their steps upwards, a byte each (255: so much, and the next byte), or, where that isn't shorter, a table of BITS bits."""
    held = np.unique(row * BITS + (prefix.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BITS)
    own, mark = held // BITS, held % BITS
    step = np.where(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)], mark, np.diff(mark, prepend=0))
    end = np.cumsum(step // 255 + 1)
    flat = np.full(end[-1] if len(end) else 0, 255, np.uint8)
    flat[end - 1] = step % 255
    first = np.searchsorted(own, np.arange(rows + 1))
    cuts = np.concatenate([[0], end])[first].tolist()
    out = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    for i in np.flatnonzero(np.diff(cuts) >= BITS // 8).tolist():
        bits = np.zeros(BITS, bool)
        bits[mark[first[i] : first[i + 1]]] = True
        out[i] = np.packbits(bits).tobytes()
    return out


def mark_table(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of BITS bits, in words, of each record's marks (`anchor_marks`), and the number of bits set."""
    whole = np.array([len(m) == BITS // 8 for m in marks], bool)
    size = np.array([0 if w else len(m) for m, w in zip(marks, whole)], np.int64)
    flat = np.frombuffer(b"".join(m for m, w in zip(marks, whole) if not w), np.uint8)
    upto, row = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)]), np.repeat(np.arange(len(marks)), size)
    last = flat < 255
    bits = np.zeros((len(marks), BITS), bool)
    bits[row[last], (upto[1:] - upto[np.cumsum(size) - size][row])[last]] = True
    table_ = np.packbits(bits, 1)
    if whole.any():
        table_[whole] = np.frombuffer(b"".join(m for m, w in zip(marks, whole) if w), np.uint8).reshape(-1, BITS // 8)
    table_ = table_.view(np.uint64)
    return table_, np.bitwise_count(table_).sum(1, dtype=np.int64)


def most_edits(size):
    """Edits at most between alike bodies of which the longer has `size` characters."""
    return (DIFFER * size).astype(np.int64)


def common_prefixes(letters: np.ndarray, length: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Common prefixes of neighbours in the array (place i: of i - 1 and i; 0 between groups), and their minima over 2, 4, 8.. places."""
    m = letters.astype(f"U{LETTERS}").view(np.uint32).reshape(len(letters), -1)
    same = m[1:] == m[:-1]
    after = np.where(same.all(1), same.shape[1], same.argmin(1))
    levels = [np.concatenate([[0], np.where(group[1:] == group[:-1], length[1:] + after, 0)]).astype(np.int32)]
    while 2 << len(levels) - 1 <= len(letters):
        step, low = 1 << len(levels) - 1, levels[-1]
        levels.append(np.minimum(low[:-step], low[step:]))
    return levels


def common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The common prefix of the suffixes at places i < j of the array."""
    k = np.log2(j - i).astype(np.int64)
    out = np.empty(len(i), np.int32)
    for level in np.unique(k):
        w = k == level
        out[w] = np.minimum(levels[level][i[w] + 1], levels[level][j[w] + 1 - (1 << level)])
    return out


def shared_spans(prefix, cell, letters, length, size, record, side, at, rest, gap, marks):
    """(x, y, covered, size) of the shared spans of one side's records x and the other's y that share enough anchors: characters covered, and the longer size. The array is whole groups in order.

    Bodies whose sizes differ by more than the edits allowed aren't alike, and an
    anchor whose distances from both ends differ by more is no common part of alike ones.
    """
    table_, set_ = mark_table(list(marks))
    group = np.cumsum(np.concatenate([[0], (prefix[1:] != prefix[:-1]) | (cell[1:] != cell[:-1])]))
    levels = common_prefixes(letters, length, group)
    dev, held = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    dev = dev[np.lexsort((size[dev], group[dev]))]
    key = group[dev] << 32 | size[dev]
    h_size, base = size[held].astype(np.int64), group[held] << 32
    lo = np.searchsorted(key, base | (h_size - most_edits(h_size)))
    hi = np.searchsorted(key, base | (h_size / (1 - DIFFER)).astype(np.int64) + 1, "right")
    upto = np.cumsum(hi - lo)
    out, at_once = [(np.empty(0, np.int64),) * 4], 0
    while at_once < len(held):
        end = max(at_once + 1, int(np.searchsorted(upto, (upto[at_once - 1] if at_once else 0) + MEET, "right")))
        count = (hi - lo)[at_once:end]
        j = np.repeat(held[at_once:end], count)
        i = dev[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at_once:end], count)]
        longer = np.maximum(size[i], size[j])
        keep = (record[i] != record[j]) & (np.abs(at[i] - at[j]) + np.abs(rest[i] - rest[j]) <= most_edits(longer))
        i, j, longer = i[keep], j[keep], longer[keep]
        enough = np.zeros(len(i), np.int64)
        for w in range(table_.shape[1]):
            enough += np.bitwise_count(table_[i, w] & table_[j, w])
        keep = enough >= ANCHORS * np.maximum(set_[i], set_[j])
        i, j, longer = i[keep], j[keep], longer[keep]
        span = common_prefix(levels, np.minimum(i, j), np.maximum(i, j))
        out.append((record[i], record[j], np.minimum(span, np.minimum(gap[i], gap[j])), longer))
        at_once = end
    return tuple(np.concatenate(x) for x in zip(*out))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "document_split_assignment").where("split in ('development', 'held_out') and source_id is not null")
    return own.groupBy("source_id").agg(F.min(F.when(F.col("split") == "development", 0).otherwise(1)).alias("side"))


def prefixes(one: DataFrame) -> DataFrame:
    """(prefix, d, h): suffixes of either side of the classes (class, sides, body), by prefix; those with both sides."""

    def run(batches):
        for b, texts in parts(batches, 1):
            a = anchors(texts, order=False)
            sides = b.column(0).to_numpy()[a["row"]]
            p, inv = np.unique(a["prefix"], return_inverse=True)
            n = [np.bincount(inv, weights=sides & bit > 0, minlength=len(p)).astype(np.int32) for bit in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(p), *map(pa.array, n)], names=["prefix", "d", "h"])

    counted = one.select("sides", "body").mapInArrow(run, "prefix bigint, d int, h int")
    return counted.groupBy("prefix").agg(F.sum("d").alias("d"), F.sum("h").alias("h")).where("d > 0 and h > 0")


_SUFFIX = ["prefix", "letters", "length", "size", "class", "side", "at", "rest", "gap", "marks"]


def suffixes(one: DataFrame) -> DataFrame:
    """The anchors of classes (class, sides, body) as rows of _SUFFIX; those of both sides (3) have a row for each."""

    def run(batches):
        for b, texts in parts(batches, 2):
            a = anchors(texts)
            sides = b.column(1).to_numpy()[a["row"]]
            at = np.concatenate([np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)])
            side = np.repeat([0, 1], [np.count_nonzero(sides & 1), np.count_nonzero(sides & 2)])
            size = np.array([len(t) for t in texts])[a["row"]]
            number = lambda x: pa.array(x.astype(np.int32))
            marks = pa.array(anchor_marks(a["row"], a["prefix"], len(texts)), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["prefix"][at]), pa.array(a["letters"][at], pa.string()), number(a["length"][at]), number(size[at]), b.column(0).take(pa.array(a["row"][at])), number(side), *(number(a[k][at]) for k in ("at", "rest", "gap")), marks.take(pa.array(a["row"][at]))],
                names=_SUFFIX,
            )

    return one.select("class", "sides", "body").mapInArrow(run, "prefix bigint, letters string, length int, size int, class bigint, side int, at int, rest int, gap int, marks binary")


def suffix_array(one: DataFrame) -> DataFrame:
    """The suffixes whose prefix both sides have, each in a cell, partitioned and in order.

    Groups of more than BLOCK suffixes are cut into blocks of either side, and each block of one meets each of the other in a cell.
    """
    both = materialized(prefixes(one))
    array = suffixes(one).join(sent_if_small(both), "prefix")
    blocks = lambda c: f"cast(if(d + h > {BLOCK}, ceil({c} / {BLOCK}), 1) as int)"
    array = array.withColumn("d", F.expr(blocks("d"))).withColumn("h", F.expr(blocks("h")))
    cells = "if(side = 0, transform(sequence(0, h - 1), j -> cast(pmod(class, d) as int) * h + j), transform(sequence(0, d - 1), i -> i * h + cast(pmod(class, h) as int)))"
    array = array.select(*_SUFFIX, F.explode(F.expr(cells)).alias("cell"))
    return array.repartition("prefix", "cell").sortWithinPartitions("prefix", "cell", "letters")


def candidate_pairs(array: DataFrame) -> DataFrame:
    """(x, y, share): a class of one side and one of the other that share enough anchors and whose merged spans cover enough of the longer, and that share. Groups are compared whole, whatever the batches."""

    def links(cols):
        x, y, covered, size = shared_spans(*cols)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(covered.astype(np.int32)), pa.array(size.astype(np.int32))], names=["x", "y", "covered", "size"])

    def run(batches):
        kept = None
        for b in batches:
            cols = [np.array(b.column(i).to_pylist(), f"U{LETTERS}") if i == 2 else b.column(i).to_numpy(zero_copy_only=i < 10) for i in range(11)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            other = np.flatnonzero((cols[0] != cols[0][-1:]) | (cols[1] != cols[1][-1:]))
            whole = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            kept = [c[whole:] for c in cols]
            if whole:
                yield links([c[:whole] for c in cols])
        if kept is not None and len(kept[0]):
            yield links(kept)

    spans = array.select("prefix", "cell", "letters", "length", "size", "class", "side", "at", "rest", "gap", "marks").mapInArrow(run, "x bigint, y bigint, covered int, size int")
    total = spans.groupBy("x", "y").agg(F.sum("covered").alias("covered"), F.max("size").alias("size"))
    return total.where(F.col("covered") >= COVERAGE * F.col("size")).select("x", "y", F.round(F.col("covered") / F.col("size"), 6).alias("share"))


def body(text: str, name: str | None, drop: list[int] | None) -> str:
    """The comparable body of a page: folded, without layout, lost text, headers, page numbers and the lines `drop` (from 1)."""
    drop = set(drop or ())
    lines, number, header = line_kinds(text, name)
    kept = [x for i, (x, n, h) in enumerate(zip(lines, number, header), 1) if not n and not h and i not in drop]
    return re.sub(r"\s+", "", _LOST.sub("", "".join(kept)))


def bodies(pages: DataFrame, names: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, source_id, side, body, key) of pages (page_id, source_id, side, text), readable ones only; equal bodies have an equal key of 128 bits."""
    drop = sent_if_small(materialized(lines.groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))))
    src = pages.where("text is not null").join(sent_if_small(names), "source_id", "left").join(drop, "page_id", "left").select("page_id", "source_id", "side", "text", "name", "drop")

    def run(batch):
        out: dict = {"page_id": [], "source_id": [], "side": [], "body": []}
        for p, source, s, t, n, d in zip(*(batch.column(i).to_pylist() for i in range(6))):
            x = body(t, n, d)
            if sum(map(str.isalpha, x)) >= READABLE:
                for k, v in zip(out, (p, source, s, x)):
                    out[k].append(v)
        yield out

    return map_batches(src, "page_id bigint, source_id string, side int, body string", run).withColumn("key", F.unhex(F.md5("body")))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance of a and b by bit vectors; any number above `most` if it's more."""
    while a and b and a[0] == b[0] and (k := next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))):
        a, b = a[k:], b[k:]
    k = next((i for i in range(min(len(a), len(b))) if a[-1 - i] != b[-1 - i]), min(len(a), len(b)))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, left = full, 0, len(a), len(b)
    for c in b:
        left -= 1
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score - left > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def alike(a: str, b: str, differ: float = DIFFER) -> bool:
    most = int(differ * max(len(a), len(b)))
    return a == b or distance(a, b, most) <= most


def _placed(text: str) -> np.ndarray:
    """The pairs of characters of `text` with their places, sorted."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.sort((cp[:-1] * 1000003 + cp[1:] & 0x7FFFFFFF) << 24 | np.arange(len(cp) - 1))


def near(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[i] (`_placed`) can be at most most[i] edits apart: an edit takes at most two pairs of characters, and moves none by more than a place."""
    count = np.array([len(x) for x in a])
    who = np.repeat(np.arange(len(a)), count)
    key = np.concatenate(a)
    all_b = np.concatenate([x | i << 55 for i, x in enumerate(b)] + [np.array([np.iinfo(np.int64).max])])
    place, base, d = key & 0xFFFFFF, key >> 24 << 24 | who << 55, most[who]
    there = all_b[np.searchsorted(all_b, base | np.maximum(place - d, 0))] <= base + np.minimum(place + d, 0xFFFFFF)
    return count - np.bincount(who, weights=there, minlength=len(a)) <= 2 * most


def _verified(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Those of class pairs (x, y) whose bodies are alike; `one` holds (class, body). Bodies meet in blocks, so that each travels once a block and not once a pair, and those of no pair stay where they are read."""
    blocks = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct().count() // CLASSES + 1
    met = pairs.withColumn("cell", F.expr(f"pmod(x, {blocks}) * {blocks} + pmod(y, {blocks})"))
    wanted = met.select(F.col("cell").alias("block"), F.explode(F.array("x", "y")).alias("class")).distinct()
    held = one.select("class", "body").join(sent_if_small(wanted), "class").select("block", "class", "body")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = dict(zip(right["class"].to_pylist(), right["body"].to_pylist()))
        placed: dict = {}
        todo = sorted(zip(left["x"].to_pylist(), left["y"].to_pylist()))
        out = []
        for k in range(0, len(todo), PAIRS):
            some = todo[k : k + PAIRS]
            for c in {c for xy in some for c in xy} - placed.keys():
                placed[c] = _placed(text[c])
            most = most_edits(np.array([max(len(text[x]), len(text[y])) for x, y in some]))
            can = near([placed[x] for x, _ in some], [placed[y] for _, y in some], most)
            out += [xy for xy, c in zip(some, can) if c and alike(text[xy[0]], text[xy[1]])]
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return met.groupBy("cell").cogroup(held.groupBy("block")).applyInArrow(run, "x bigint, y bigint")


def class_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y, share) of alike classes, of the training and the evaluation side, with the share of the longer covered by shared spans; and the members (page_id, source_id, side, class)."""
    pages = spread(table(spark, sf_dir, "document_page").select("page_id", "source_id", "text")).join(sent_if_small(_sides(spark, sf_dir)), "source_id")
    found = boilerplate.equal_lines(spark, sf_dir)
    names = table(spark, sf_dir, "benchmark_source").groupBy("source_id").agg(F.min("source_name").alias("name"))
    text = materialized(bodies(pages, names, found).withColumn("uid", F.monotonically_increasing_id()))
    kinds = materialized(text.groupBy("key").agg(F.min("uid").alias("class"), F.expr("bit_or(side + 1)").alias("sides")))
    one = text.select(F.col("uid").alias("class"), "body").join(sent_if_small(kinds.select("class", "sides")), "class").select("class", "sides", "body")
    pairs = materialized(candidate_pairs(suffix_array(one)))
    alike_pairs = _verified(pairs, one).join(pairs, ["x", "y"])
    same = kinds.where("sides = 3").select(F.col("class").alias("x"), F.col("class").alias("y"), F.lit(1.0).alias("share"))
    return materialized(alike_pairs.unionByName(same)), text.select("page_id", "source_id", "side", "key").join(kinds.select("key", "class"), "key").drop("key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = class_pairs(spark, sf_dir)
    dev = members.where("side = 0").select(F.col("page_id").alias("dev"), F.col("class").alias("x")).distinct()
    held = members.where("side = 1").select(F.col("page_id").alias("held"), F.col("class").alias("y")).distinct()
    found = pairs.select("x", "y").join(dev, "x").join(held, "y")
    return found.select(F.least("dev", "held").alias("page_id_a"), F.greatest("dev", "held").alias("page_id_b")).distinct()


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair of sources: alike pages, the least part covered by shared spans, and whether the near-duplicate families already tell of them.

    Counted from the members of each class, without making the pairs of pages.
    """
    family = table(spark, sf_dir, "document_split_assignment").groupBy("source_id").agg(F.min("near_duplicate_family").alias("family"))
    pairs, members = class_pairs(spark, sf_dir)
    n = members.groupBy("class", "side", "source_id").agg(F.count_distinct("page_id").alias("n"))
    dev = n.where("side = 0").select(F.col("class").alias("x"), F.col("source_id").alias("dev_source"), F.col("n").alias("nx"))
    held = n.where("side = 1").select(F.col("class").alias("y"), F.col("source_id").alias("held_source"), F.col("n").alias("ny"))
    met = materialized(pairs.join(dev, "x").join(held, "y"))
    both = ["dev_source", "held_source"]
    out = met.groupBy(both).agg(F.sum(F.col("nx") * F.col("ny")).alias("pairs"), F.min("share").alias("least_share"))
    for c, k, m in (("dev_pages", "x", "nx"), ("held_pages", "y", "ny")):
        out = out.join(met.select(*both, k, m).distinct().groupBy(both).agg(F.sum(m).alias(c)), both)
    for c in ("dev", "held"):
        out = out.join(family.select(F.col("source_id").alias(f"{c}_source"), F.col("family").alias(f"{c}_family")), f"{c}_source", "left")
    return out.select("dev_source", "held_source", "pairs", "dev_pages", "held_pages", "least_share", F.coalesce(F.col("dev_family") == F.col("held_family"), F.lit(False)).alias("known"))
