"""Helpers of the span finders: order and digests of (kind, start, end) spans."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate
from typing import Sequence


def ordered(found: Sequence[tuple], kinds: Sequence[str]) -> list[tuple]:
    """By start, then kind as listed, then end."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(found, key=lambda s: (s[1], place[s[0]], s[2]))


def joined(found: Sequence[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in found)


def digest(found: Sequence[tuple]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()


def apart(added: Sequence[tuple], base: Sequence[tuple]) -> list[tuple]:
    """The spans of ``added`` that overlap none of ``base``."""
    if not added or not base:
        return list(added)
    known = sorted((s[1], s[2]) for s in base)
    starts, reach = [s for s, _ in known], list(accumulate((e for _, e in known), max))
    out = []
    for a in added:
        i = bisect_left(starts, a[2])
        if not i or reach[i - 1] <= a[1]:
            out.append(a)
    return out
