"""Garbled text from a wrong character encoding: find the affected spans and restore them.

A span is *garbled* when its characters, mapped back to the bytes of a legacy
encoding, form well-formed multibyte sequences whose decoded text is plausible.
The byte automata are compiled, per legacy encoding, into regular expressions
over characters, so that whole texts are scanned by one machine in C and only
suspicious spans are looked at one by one. Only the spans found are decoded;
the rest of a text is left as it is.

Defined results: null and empty texts have no spans and restore to themselves;
text destroyed by replacement marks (the three-character trace that UTF-8's
mark leaves in GBK) is reported as a span without restoration.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, spread, table

#: Legacy encodings under which UTF-8 bytes are commonly misread, one byte a character.
SINGLE_BYTE = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r")
#: Fixed values: (encoding the text was read with, encoding its bytes are in), two bytes a character.
DOUBLE_BYTE = (("gbk", "utf-8"), ("cp932", "utf-8"), ("big5", "gbk"), ("gbk", "big5"), ("big5", "utf-8"), ("cp932", "gbk"))

_C1 = {b: chr(b) for b in range(0x80, 0xA0)}


def _bytes_of(codec: str) -> dict[str, int]:
    """Characters of a one-byte encoding and their bytes from 0x80; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        out |= {c: b for b, c in _C1.items()}
    return out


def _class(chars) -> str:
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


def _utf8_automaton(byte_of: dict[str, int]) -> str:
    """Well-formed multibyte UTF-8 over the characters of a one-byte encoding."""
    of = lambda lo, hi: _class(c for c, b in byte_of.items() if lo <= b <= hi)
    tail = of(0x80, 0xBF)
    return f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}})"


@lru_cache(None)
def _level1() -> frozenset[str]:
    """The common hanzi: rows 16 to 55 of the national set, by its own ordering."""
    return frozenset(c for hi in range(0xB0, 0xD8) for lo in range(0xA1, 0xFF) for c in bytes([hi, lo]).decode("gb2312", "ignore"))


def _plausible(text: str, cyrillic: bool = False) -> bool:
    """Whether all characters are of the kinds that texts of these languages hold."""
    for c in text:
        o = ord(c)
        if not (o < 0x100 and o not in range(0x80, 0xA0) or o in (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E) or 0x391 <= o <= 0x3C9 or 0x2010 <= o <= 0x2044 or o in (0x20AC, 0x2116, 0x2122) or 0x2150 <= o <= 0x27BF or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFF65 or o in (0xA0, 0x200B, 0xFEFF, 0xFFFD, 0x2009, 0x202F, 0x2007) or 0x2F00 <= o <= 0x2FDF or 0x2E80 <= o <= 0x2EFF or cyrillic and 0x400 <= o <= 0x45F):
            return False
    return True


@lru_cache(None)
def _machines() -> dict:
    m: dict = {"single": [], "bytes": {}}
    for codec in SINGLE_BYTE:
        byte_of = _bytes_of(codec)
        unit = _utf8_automaton(byte_of)
        if codec in ("cp1251", "koi8_r"):  # not inside a real Cyrillic word
            unit = f"(?<![а-яё])(?:{unit})+(?![а-яё])"
        else:
            unit = f"(?:{unit})+"
        m["bytes"][codec] = {ord(c): b for c, b in byte_of.items()}
        m["single"].append((codec, re.compile(unit)))
    high = {c for c, b in _bytes_of("cp1252").items() if 0xA1 <= b <= 0xFE}
    m["gb_in_latin"] = re.compile(_class(high) + "{4,}")
    letters = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))
    alike = "авеіјкмнорсѕтухАВЕЗІЈКМНОРСЅТУХ"
    wrong = "".join(c for c, b in _bytes_of("cp1251").items() if "а" <= c.lower() <= "ё" and c not in alike and bytes([b]).decode("cp1252", "ignore").isalpha())
    m["cyrillic_in_latin"] = re.compile(f"(?<=[{letters}])[{wrong}]|[{wrong}](?=[a-z])")
    rare = "".join(chr(o) for o in [*range(0x3105, 0x312A), *range(0x4E00, 0xA000), *range(0xFF61, 0xFFA0)] if chr(o) not in _level1())
    m["rare"] = re.compile(f"(?:[{rare}][^\\n]{{0,3}}){{3}}")
    m["run"] = re.compile("[^\\x00-\\x7f]+(?:[\\x20-\\x7e]{1,2}[^\\x00-\\x7f]+)*")
    m["lost"] = re.compile("(?:锟斤拷|锟斤|斤拷|锟�)+[锟斤拷�]*")
    m["lone"] = re.compile(r"(?<![⺀-￯])([一-鿿-]{1,3})(?![⺀-￯])")
    m["any"] = re.compile("[" + re.sub(r"^\[|\]$", "", _class({c for codec in SINGLE_BYTE for c, b in _bytes_of(codec).items() if 0xC2 <= b <= 0xF4})) + "]")
    m["utf8"] = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2})+")
    return m


def _common(text: str) -> float:
    """Share of common hanzi and usual marks among the characters beyond ASCII."""
    wide = [c for c in text if c > "\x7f"]
    return sum(c in _level1() or c in "，。、：；（）《》“”！？【】·①②③④⑤⑥⑦⑧⑨β" for c in wide) / max(1, len(wide))


def _latin_spans(text: str) -> list[tuple[int, int, str | None]]:
    m, out = _machines(), []
    for codec, machine in m["single"]:
        for x in machine.finditer(text):
            raw = bytes(x.group().translate(m["bytes"][codec]).encode("latin-1"))
            try:
                back = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _plausible(back):
                out.append((x.start(), x.end(), back))
            elif codec == "cp1252" and all(ord(c) in m["bytes"]["cp1252"] for c in back):
                out.append((x.start(), x.end(), back))  # misread twice
    for x in m["gb_in_latin"].finditer(text):
        raw = x.group().translate(m["bytes"]["cp1252"]).encode("latin-1")
        # a letter of its own before the pairs would put them out of step
        read = [[r for r in well_formed(raw[k:], "gbk", k) if _common(r[0]) >= 0.5 and any(c in _level1() for c in r[0])] for k in (0, 1)]
        for back, at, upto in max(read, key=lambda rs: sum(_common(r[0]) * len(r[0]) for r in rs)):
            out.append((x.start() + at, x.start() + upto, back))
    for x in m["cyrillic_in_latin"].finditer(text):
        out.append((x.start(), x.end(), x.group().encode("cp1251").decode("cp1252")))
    return out


#: The pairs of bytes of the two-byte encodings, as patterns; single bytes stand for themselves.
_PAIR = {
    "gbk": re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+"),
    "big5": re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\xa1-\xfe])+"),
}


def well_formed(raw: bytes, meant: str, shift: int = 0) -> list[tuple[str, int, int]]:
    """The maximal runs of pairs of bytes of `raw` that the encoding `meant` decodes without a fault: decoded, with their starts and ends, counted from `shift` on."""
    out = []
    for m in _PAIR[meant].finditer(raw):
        start = m.start()
        while start < m.end():
            try:
                end = m.end()
                back = raw[start:end].decode(meant)
            except UnicodeDecodeError as e:  # up to the fault; on after its pair
                end = start + e.start
                back = raw[start:end].decode(meant)
            if back:
                out.append((back, shift + start, shift + end))
            start = end + 2
    return out


def _pieces(run: str, read: str) -> list[tuple[str, bytes | None]]:
    """`run` in pieces that the encoding it was read with can hold, with their bytes, and single characters that it can't, which come from elsewhere."""
    out: list[tuple[str, bytes | None]] = []
    try:
        return [(run, run.encode(read))]
    except UnicodeEncodeError:
        pass
    for c in run:
        try:
            raw = c.encode(read)
        except UnicodeEncodeError:
            raw = None
        if raw is not None and out and out[-1][1] is not None:
            out[-1] = (out[-1][0] + c, out[-1][1] + raw)
        else:
            out.append((c, raw))
    return out


def decoded(raw: bytes, meant: str) -> str:
    """`raw` in the encoding `meant`; bytes that aren't well-formed in it come out as replacement marks, none vanishes."""
    return raw.decode(meant, "replace")


def _wide_spans(text: str) -> list[tuple[int, int, str | None]]:
    m, out = _machines(), []
    for x in m["lost"].finditer(text):
        out.append((x.start(), x.end(), None))
    for x in m["lone"].finditer(text):  # an accented letter or a sign of UTF-8, read as one wide character
        around = text[max(0, x.start() - 1) : x.start()] + text[x.end() : x.end() + 1]
        if not re.search("[A-Za-z0-9]", around):
            continue
        tail = text[x.end() : x.end() + 1]
        try:
            raw = x.group().encode("gbk")
        except UnicodeEncodeError:
            continue
        if (y := m["utf8"].match(raw)) and y.end() >= len(raw) - 1:
            rest = raw[y.end() :]
            if rest and rest[0] >= 0x80:  # half of a pair: what it belonged to is lost
                continue
            back = decoded(y.group(), "utf-8") + rest.decode("ascii")
            if _plausible(back) and any(c < "ƀ" or c in "“”‘’–—…€•‑" for c in back if c > "\x7f") and not (0x4E00 <= ord(back[0]) <= 0x9FFF) and (tail or back):
                out.append((x.start(), x.end(), back))
    if m["rare"].search(text):
        for x in m["run"].finditer(text):
            run = x.group()
            if not m["rare"].search(run):
                continue
            best = None
            for read, meant in DOUBLE_BYTE:
                # characters that the encoding lacks, lost marks among them, part what was read with it and stay as they are
                pieces = _pieces(run, read)
                back = [t if raw is None else decoded(raw, meant) for t, raw in pieces]
                if meant == "utf-8":
                    size = sum(len(raw or b"..") for _, raw in pieces)
                    whole = "".join("".join(decoded(p, meant) for p in m["utf8"].findall(raw)) for _, raw in pieces if raw)
                    found = sum(c > " " for c in whole)
                    if not (found >= 2 and 3 * found >= 0.45 * size and _common(whole) >= 0.6):
                        continue
                    score = found * _common(whole)
                else:
                    # a lost mark shifts what follows by a byte, so each piece between marks is looked at on its own
                    read_well = [y.replace("�", "") for (_, raw), y in zip(pieces, back) if raw]
                    good = "".join(x for x in read_well if sum(c > "\x7f" for c in x) >= 4 and _common(x) >= 0.7)
                    wide = [c for c in good if c > "\x7f"]
                    if not wide or _common(run) > 0.6 * _common(good):
                        continue
                    score = len(wide) * _common(good) * 0.9
                whole = "".join(back)
                if best is None or score > best[0]:
                    best = (score, whole)
            if best:
                out.append((x.start(), x.end(), best[1]))
    return out


def garbled_spans(text: str | None) -> list[tuple[int, int, str | None]]:
    """(start, end, restored text or None) of each garbled span of `text`, in order, without overlaps; the longest wins."""
    if not text or text.isascii():
        return []
    found = (_latin_spans(text) if _machines()["any"].search(text) else []) + _wide_spans(text)
    out: list[tuple[int, int, str | None]] = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= o[0] or o[1] <= s[0] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[:2])


def restored(text: str | None) -> str | None:
    """`text` with its garbled spans decoded, again while that still finds spans and makes the text shorter; the rest unchanged.

    Each decoding of multibyte characters takes characters away, so it ends.
    """
    before = None
    while before is None or text is not None and len(text) < before:
        spans = garbled_spans(text)
        if not any(back is not None for *_x, back in spans):
            break
        before = len(text)
        parts, at = [], 0
        for start, end, back in spans:
            parts += [text[at:start], text[start:end] if back is None else back]
            at = end
        text = "".join(parts) + text[at:]
    return text


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, garbled, restored) of the values of column `text` that hold a garbled span.

    Null and empty values give no row; equal rows give equal rows (take distinct for a set).
    Other columns are not carried along.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]"))

    def run(batch):
        out: dict = {"k": [], "garbled": [], "restored": []}
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if spans := garbled_spans(t):
                out["k"].append(k)
                out["garbled"].append("\n".join(t[a:b] for a, b, _ in spans))
                out["restored"].append(restored(t))
        yield out

    kind = df.schema[key].dataType.simpleString()
    return map_batches(src, f"k {kind}, garbled string, restored string", run).withColumnRenamed("k", key)


def garbled_flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keys whose value of `text` is garbled, wholly or in part."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]"))

    def run(batch):
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield {"k": [k for k, t in pairs if garbled_spans(t)]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(src, f"k {kind}", run).distinct().withColumnRenamed("k", key)


def p5_found(spark, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "document_page").select("page_id", "text", "quality_notes"))
    notes = pages.select("page_id", F.explode("quality_notes").alias("note"))
    return garbled_flags(pages, "page_id", "text").select(F.lit("text").alias("field_name"), "page_id").unionByName(
        garbled_flags(notes, "page_id", "note").select(F.lit("quality_notes").alias("field_name"), "page_id")
    )


def p5_restored(spark, sf_dir: str) -> DataFrame:
    """The affected texts and notes, their garbled parts and the restored value; `note_no` is a note's place in its page's notes, from 1, and null for a text."""
    pages = table(spark, sf_dir, "document_page")
    texts = pages.select(F.lit("text").alias("field_name"), "page_id", F.lit(None).cast("int").alias("note_no"), F.col("text").alias("value"))
    notes = pages.select(F.lit("quality_notes").alias("field_name"), "page_id", F.posexplode("quality_notes").alias("note_no", "value")).withColumn("note_no", F.col("note_no") + 1)
    values = texts.unionByName(notes).select(F.struct("field_name", "page_id", "note_no").alias("record"), "value")
    return find_garbled(values, "record", "value").select("record.*", "garbled", "restored").distinct()
