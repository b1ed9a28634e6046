"""Sets of integers as sorted, disjoint, closed intervals, and their cover by aligned blocks."""

from __future__ import annotations

LOW, HIGH = -(2**63), 2**63 - 1
ALL = ((LOW, HIGH),)
NONE: tuple = ()
#: Blocks are aligned to powers of 2**STEP; level 0 is a single number and level 64 is everything.
STEP = 4


def make(lo: int, hi: int) -> tuple:
    lo, hi = max(lo, LOW), min(hi, HIGH)
    return ((lo, hi),) if lo <= hi else NONE


def union(a: tuple, b: tuple) -> tuple:
    out: list = []
    for lo, hi in sorted((*a, *b)):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return tuple(out)


def intersect(a: tuple, b: tuple) -> tuple:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def complement(a: tuple) -> tuple:
    out, at = [], LOW
    for lo, hi in a:
        if at < lo:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= HIGH:
        out.append((at, HIGH))
    return tuple(out)


def blocks(lo: int, hi: int, step: int = STEP) -> list[tuple[int, int]]:
    """The fewest aligned blocks ``(level, prefix)`` that cover exactly ``lo..hi``; ``prefix`` is ``n >> level``."""
    if (lo, hi) == (LOW, HIGH):
        return [(64, 0)]
    out = []
    while lo <= hi:
        level = 0
        while level + step < 64 and not lo & ((1 << (level + step)) - 1) and lo + (1 << (level + step)) - 1 <= hi:
            level += step
        out.append((level, lo >> level))
        lo += 1 << level
    return out
