"""Whole batches of text as arrays of code points, for counting and hashing at the speed of arrays.

A batch is joined into one array; folding, masking and hashing are table lookups
and prefix sums over it, never loops over characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .charforms import LOOK_ALIKE, _fold_table, folded

_SPECIAL = re.compile("[ﬀ-ﬆ̀-ͯ\U00010000-\U0010ffff㌀-㏿]")
_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(None)
def tables() -> dict[str, np.ndarray]:
    """Per code point of the basic plane: `fold` (0: dropped), `lower` folded form in lower case, and flags."""
    fold = np.arange(0x10000, dtype=np.uint32)
    for o, s in _fold_table().items():
        if o < 0x10000 and len(s) <= 1:
            fold[o] = ord(s) if s else 0
    low = fold.copy()
    letter, han, digit, space = (np.zeros(0x10000, bool) for _ in range(4))
    for o in range(0x10000):
        c = chr(o)
        if 0xD800 <= o < 0xE000:
            continue
        letter[o], space[o] = c.isalpha(), c.isspace()
        digit[o] = c.isdecimal()
        if len(x := c.lower()) == 1:
            low[o] = fold[ord(x)] if ord(x) < 0x10000 else ord(x)
    han[0x3400:0xA000] = han[0xF900:0xFB00] = True
    for a in LOOK_ALIKE:
        low[ord(a)] = fold[ord(LOOK_ALIKE[a].lower())]
    rng = np.random.default_rng(20)
    return {"fold": fold, "lower": low, "letter": letter, "han": han, "digit": digit, "space": space, "mix": rng.integers(1, 1 << 63, 0x10000, dtype=np.uint64) | np.uint64(1)}


def quick_folded(text: str) -> str:
    """`charforms.folded`, by array lookup; texts with forms of several characters go the long way."""
    if text.isascii():
        return text.lower()
    if _SPECIAL.search(text):
        return folded(text)
    cp = tables()["lower"][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return cp[cp > 0].tobytes().decode("utf-32-le")


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of an odd number and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(max(n, 2 * len(_powers[i])), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Batch:
    """Texts as one array `cp` of lower-case folded code points, without dropped characters; `row` tells the text of each."""

    def __init__(self, texts: list[str | None]):
        texts = [("" if t is None else t) for t in texts]
        texts = [unicodedata.normalize("NFC", t.translate(_fold_table())) if not t.isascii() and _SPECIAL.search(t) else t for t in texts]
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        raw = np.where(raw < 0x10000, raw, np.uint32(0xFFFD))
        t = tables()
        cp = t["lower"][raw]
        keep = cp > 0
        self.rows, self.cp, self.row = len(texts), cp[keep], row[keep]

    def take(self, keep: np.ndarray) -> None:
        self.cp, self.row = self.cp[keep], self.row[keep]


def sums(cp: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows (`span_hash`)."""
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(tables()["mix"][cp] * powers(len(cp))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the array behind the prefix sums `s`; equal spans have equal hashes."""
    return mixed((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(np.uint64))
