"""Running headers and page numbers: lines of a page that aren't part of its text."""

from __future__ import annotations

import re
from functools import lru_cache

from .charforms import folded
from .numeric import quick_folded

#: Words that go with a printed page number.
PAGE_WORDS = ("page", "pages", "seite", "pagina", "página", "pág", "pg", "p", "s", "no", "nr", "页码", "页次", "第", "共", "页", "of", "von", "sur", "de", "/")
#: Characters often printed for digits, or read for them.
_DIGIT = "0-9oOlIiSsBZzgq|"
#: Marks that may stand around a page number.
_MARK = r"[-–—\[\](){}|·•.:：~*#\s]"
_NUMBER = re.compile(
    rf"{_MARK}*(?:(?:页码|页次|第|共|page|seite|pagina|página|pág|pg|p|s|nr|no)[.:：]?\s*)?{_MARK}*(?:[{_DIGIT}]*[0-9][{_DIGIT}]*|[olisbzgq|]{{1,4}}(?=\s*页)|(?<=[p:：第]\s)[oli]{{1,3}})\s*"
    rf"(?:(?:页|/|of|von|sur|de|共|{_MARK})\s*)*(?:(?:第|共)?\s*[{_DIGIT}]+\s*页?)?{_MARK}*",
    re.I,
)


_SIGN = re.compile("[0-9页:]|\\bp")


def is_page_number(line: str) -> bool:
    """Whether `line` holds nothing but a page's number, in one of the usual forms, perhaps with misread digits."""
    return _page_number(folded(line))


def _page_number(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 24 and _SIGN.search(s) is not None and _NUMBER.fullmatch(s) is not None


_MARKS = re.compile(r"[\W_]+")


@lru_cache(4096)
def _name(name: str) -> tuple[str, tuple[str, ...]]:
    """The name's letters, and short pieces of its words of which a damaged copy keeps most."""
    low = folded(name)
    pieces = []
    for w in _MARKS.split(low):
        k = 2 if w > "⺀" else 4
        pieces += [w[i : i + k] for i in range(0, len(w) - k + 1, k)] or ([w] if w else [])
    return _MARKS.sub("", low), tuple(pieces)


def _within(pattern: str, text: str, most: int) -> bool:
    """Whether `text` holds a span at most `most` edits from `pattern` (Sellers' algorithm on bit vectors)."""
    m = len(pattern)
    if m <= most:
        return False
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most:
            return True
    return False


#: A running header has at most so many times the letters of the name, plus ROOM for a section title.
TIMES, ROOM = 4, 60


def is_running_header(line: str, name: str | None) -> bool:
    """Whether `line` repeats the source's name, perhaps damaged, cut or with additions such as a section title or a page number."""
    return bool(name) and _header(folded(line), name)


def _header(line: str, name: str) -> bool:
    if len(line) > TIMES * len(name) + ROOM:
        return False
    whole, pieces = _name(name)
    if len(whole) < 4 or sum([p in line for p in pieces]) * 3 < len(pieces):
        return False
    s = _MARKS.sub("", line)
    if len(s) < len(whole) * 0.6:
        return False
    return whole in s or _within(whole, s[: len(whole) + ROOM], max(1, len(whole) // 5))


def line_kinds(text: str, name: str | None) -> tuple[list[str], list[bool], list[bool]]:
    """The folded lines of `text`, whether each is a page number, and whether it's a running header; the text is folded once."""
    lines = quick_folded(text).split("\n")
    number = [_page_number(x) for x in lines]
    return lines, number, [bool(name) and not n and _header(x, name) for x, n in zip(lines, number)]
