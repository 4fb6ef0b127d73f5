"""Allocations on the driver: rows over strata, characters over cells, bands of a ranking."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

#: Where the bands of a gradient draw stand, as shares of the way down a ranking.
ANCHORS = {"top": 0.0, "middle": 0.5, "negative": 0.9}


def _level(total: Callable[[int], int], k: int, highest: int) -> int:
    """The least level at which a sum that grows with it reaches k."""
    return bisect_left(range(highest + 1), k, key=total)


def repair_allocations(wanted: list[int], k: int) -> list[int]:
    """Allocations in about the given proportions that sum to k, each at least one while there are rows.

    A sum that is too high is cut from the top: all above some level come down to it, and as many of them as
    needed, first ones first, to one below. A sum that is too low is filled from the bottom likewise.
    """
    n, total = len(wanted), sum(wanted)
    if not n or total == k:
        return list(wanted)
    if k < n and total > 0:
        return [1] * k
    if total <= 0:
        return [(k + n - 1 - i) // n for i in range(n)]
    scaled = [max(1, round(w * k / total)) for w in wanted]
    if sum(scaled) >= k:
        cap = _level(lambda level: sum(min(s, level) for s in scaled), k, max(scaled))
        spare = sum(min(s, cap) for s in scaled) - k
        reached = list(accumulate(s >= cap for s in scaled))
        return [cap - (r <= spare) if s >= cap else s for s, r in zip(scaled, reached, strict=True)]
    floor = _level(lambda level: sum(max(s, level) for s in scaled), k, k)
    missing = k - sum(max(s, floor - 1) for s in scaled)
    below = list(accumulate(s < floor for s in scaled))
    return [floor - (r > missing) if s < floor else s for s, r in zip(scaled, below, strict=True)]


def gradient_bands(m: int) -> list[tuple[str, int, float]]:
    """(band, rows, anchor): half from the top, a quarter each from the middle and near the bottom."""
    if m <= 0:
        return []
    top = math.ceil(m / 2)
    middle = math.ceil((m - top) / 2)
    return [(name, n, ANCHORS[name]) for name, n in (("top", top), ("middle", middle), ("negative", m - top - middle))]


def fair_shares(lengths: list[int], budget: int) -> list[int]:
    """Max-min fair shares: items up to a common level get their length, the others the level; what is left of rounding goes to the longest.

    The level is what remains beside the m shortest items in equal parts, for the least m whose next item exceeds it.
    """
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    used = [0, *accumulate(lengths[i] for i in order)]
    n = len(order)
    whole = next((m for m in range(n) if lengths[order[m]] * (n - m) > budget - used[m]), n)
    shares = list(lengths)
    if whole < n:
        level, rest = divmod(budget - used[whole], n - whole)
        for place, i in enumerate(order[whole:]):
            shares[i] = level + (place >= n - whole - rest)
    return shares


def cell_budgets(lengths: list[int], budget: int, cap: int) -> list[int]:
    """Budgets of cells in one pass: what cells up to an equal part leave is shared once among the longer ones."""
    if not lengths:
        return []
    capped = [min(n, cap) for n in lengths]
    short = [n for n in capped if n * len(capped) <= budget]
    longer = len(capped) - len(short)
    level = (budget - sum(short)) // longer if longer else budget
    return [n if n * len(capped) <= budget else min(n, level) for n in capped]
