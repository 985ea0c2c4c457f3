"""Banded sequence alignment over words or any other hashable symbols."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence


def positions(symbols: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each symbol, its places as the bits of a number."""
    found: dict[Hashable, int] = {}
    for i, s in enumerate(symbols):
        found[s] = found.get(s, 0) | (1 << i)
    return found


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], limit: int) -> int | None:
    """Edit distance of two sequences if it is at most ``limit``, else None.

    Only cells within ``limit`` of the diagonal are computed. A column of that band is held as two bit vectors, of the
    steps up and the steps down between neighbouring cells, and one column follows from the last by a few operations
    on whole vectors.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a)
    if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > limit:
        return None  # more symbols without a partner than edits allowed
    return _banded(positions(a), len(a), b, min(limit, len(a)))


def _banded(match: dict[Hashable, int], n: int, b: Sequence[Hashable], limit: int) -> int | None:
    """``n`` is at least ``len(b)`` and the difference at most ``limit``. The band moves down one row a column."""
    width = 2 * limit + 2  # the top bit of column j is row j + limit
    ones, top, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    plus, minus, dist, most = ones & ~((1 << (limit + 1)) - 1), 0, limit, 2 * limit + len(b) - n
    for j, s in enumerate(b):
        at = j + limit + 1 - width
        eq = match.get(s, 0)
        eq = (eq >> at if at >= 0 else eq << -at) & ones
        diagonal = ((((eq & plus) + plus) & ones) ^ plus) | eq | minus
        up = minus | (ones & ~(diagonal | plus))
        down = diagonal & plus
        if j < n - limit:  # along the lower edge of the band
            dist += not diagonal & top
            if dist > most:
                return None
        else:  # along the last row
            dist += bool(up & row) - bool(down & row)
            row >>= 1
        half = diagonal >> 1
        plus = down | (ones & ~(half | up))
        minus = half & up
    return dist if dist <= limit else None


def similarity(a: Sequence[Hashable], b: Sequence[Hashable], least: float) -> float | None:
    """1 - edit distance / length of the longer, if it is at least ``least``; None otherwise. Two empty ones are equal."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    found = edit_distance(a, b, int(longer * (1 - least) + 1e-9))
    return None if found is None else 1 - found / longer


def _ends(match: dict[Hashable, int], n: int, text: Sequence[Hashable]) -> tuple[int, int]:
    """Least edit distance of a pattern of ``n`` symbols to a part of ``text``, and where the first such part ends."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, dist, best = full, 0, n, (n, 0)
    for j, s in enumerate(text):
        eq = match.get(s, 0)
        diagonal = ((((eq & plus) + plus) & full) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        dist += bool(up & last) - bool(down & last)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if dist < best[0]:
            best = dist, j + 1
    return best


def find(pattern: Sequence[Hashable], text: Sequence[Hashable], limit: int) -> tuple[int, int, int] | None:
    """The part of ``text`` nearest to ``pattern`` as (distance, start, end), if the distance is at most ``limit``."""
    dist, end = _ends(positions(pattern), len(pattern), text)
    if dist > limit or not pattern:
        return None
    back = list(reversed(text[:end]))
    _, length = _ends(positions(list(reversed(pattern))), len(pattern), back)
    return dist, end - length, end
