"""The packing kernel: consecutive segments under a token budget, as ranges found on prefix sums."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate


def packed(weights: Sequence[int], budget: int, most: int = 0, glue: int = 0) -> list[tuple[int, int]]:
    """Greedy ranges (first, end) whose weights, with ``glue`` between neighbours, stay within ``budget``.

    A segment heavier than the budget stands alone; ``most`` > 0 also limits the segments of a range.
    """
    sums = list(accumulate((w + glue for w in weights), initial=0))
    out, at = [], 0
    while at < len(weights):
        end = max(at + 1, bisect_right(sums, sums[at] + budget + glue) - 1)
        if most > 0:
            end = min(end, at + most)
        out.append((at, end))
        at = end
    return out


def filled(weights: Sequence[int], budget: int, back: int) -> list[tuple[int, int]]:
    """Ranges that grow until they reach ``budget``; each begins up to ``back`` segments before the last one's end.

    The range that reaches the end is followed by one of its own tail, as long as going back makes progress.
    """
    sums = list(accumulate(weights, initial=0))
    out, at = [], 0
    while at < len(weights):
        end = min(len(weights), max(at + 1, bisect_left(sums, sums[at] + budget)))
        out.append((at, end))
        again = end - min(back, end - at)
        at = again if again > at else end
    return out


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Sliding ranges over ``n`` tokens; the last is the first that touches the end."""
    step = size - overlap if overlap < size else size
    count = 1 if n <= size else -(-(n - size) // step) + 1
    return [(i * step, min(i * step + size, n)) for i in range(count)] if n else []
