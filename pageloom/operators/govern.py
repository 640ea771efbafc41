"""Choosing and checking datasets."""

from __future__ import annotations

#: The strata of cases, in the order they are dealt.
LABELS = (
    "single_sentence", "multi_sentence_conditions_outcomes", "rule_plus_exception", "cross_page_clause",
    "complete_short_clause", "internally_split_clause", "adjacent_or_lexically_similar_hard_negative",
)


def select_subset(sizes: list[tuple[str, int]], target: int) -> set[str]:
    """Names whose sizes sum nearest to `target`: neither none nor all of the sum, of equally near sums the smaller.

    Names are taken in their order; of the subsets with that sum it's the one
    whose last name comes first, then the one before it, and so on. Names of
    size 0 are never taken. The empty set if no sum lies between.
    """
    sizes = sorted((name, n) for name, n in sizes if n > 0)
    total = sum(n for _, n in sizes)
    reach: dict[int, tuple[int, str] | None] = {0: None}
    for name, n in sizes:
        for s in sorted(reach, reverse=True):
            if s + n not in reach:
                reach[s + n] = (s, name)
    best = min((s for s in reach if 0 < s < total), key=lambda s: (abs(s - target), s), default=0)
    out: set[str] = set()
    while reach[best] is not None:
        best, name = reach[best]
        out.add(name)
    return out
