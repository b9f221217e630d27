"""Long repeats of a block of texts by interval expansion on a Burrows-Wheeler transform.

``repeated_starts`` sorts the suffixes of the joined texts, transforms them and
extends intervals of rows backwards, breadth first: the intervals of level l are
those of strings of l bytes, and a boundary between two neighbouring suffixes
that is first met at level l has a common prefix of exactly l bytes. The search
ends at the wanted length; boundaries not met by then have common prefixes at
least that long. Each boundary is met once, so the work follows the block's
size, not the number of repeats.

The transform needs suffixes in the order of their first ``length`` bytes. Doubling
gets there in steps that overshoot it, so its groups of equal ranks agree on more
bytes than wanted and would miss strings that agree on just the length; the
expansion is what tells common prefixes to the byte.
"""

from __future__ import annotations

import numpy as np

PACKED = 7


def _suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols; zeros differ pairwise."""
    n = len(symbols)
    pack = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols, np.zeros(PACKED, symbols.dtype)]).astype(np.uint64)
    open_ = np.ones(n, bool)
    for k in range(PACKED):
        nxt = padded[k : k + n]
        pack = pack * np.uint64(257) + np.where(open_, nxt, np.uint64(0))
        open_ &= nxt != 0
    closed = ~open_
    order = np.argsort(pack)
    ends = closed[order]
    if ends.any():
        some = order[ends]
        order[ends] = some[np.lexsort((some, pack[some]))]
    sorted_pack = pack[order]
    head = np.ones(n, bool)
    head[1:] = (sorted_pack[1:] != sorted_pack[:-1]) | ends[1:]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(head)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    step = PACKED
    while step < depth:
        # Only rows whose group has more than one member are sorted further.
        single = head & np.append(head[1:], True)
        rows = np.flatnonzero(~single)
        if not len(rows):
            break
        active = order[rows]
        after = active + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        key = rank[active] * np.int64(n + 1) + second
        by = np.argsort(key)
        order[rows] = active[by]
        key = key[by]
        head[rows] = np.append(True, key[1:] != key[:-1])
        group = rows[head[rows]]
        sizes = np.diff(np.append(np.flatnonzero(head[rows]), len(rows)))
        rank[order[rows]] = np.repeat(group, sizes)
        step *= 2
    return order


class _Wavelet:
    """Counts of every symbol before a row, by the bits of the symbols."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length())
        self.levels = []
        n = len(values)
        for b in reversed(range(self.bits)):
            zero = ((values >> b) & 1) == 0
            before = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])
        symbol = np.arange(1 << self.bits)
        start = np.zeros(len(symbol), np.int64)
        for b, (before, zeros) in zip(reversed(range(self.bits)), self.levels):
            one = (symbol >> b) & 1 == 1
            start = np.where(one, zeros + start - before[start], before[start])
        self.start = start

    def symbols(self, low: np.ndarray, high: np.ndarray):
        """Symbols other than zero inside each interval, and their counts before both ends."""
        symbol = np.zeros(len(low), np.int64)
        for before, zeros in self.levels:
            low0, high0 = before[low].astype(np.int64), before[high].astype(np.int64)
            low1, high1 = zeros + low - low0, zeros + high - high0
            left, right = high0 > low0, high1 > low1
            low = np.concatenate([low0[left], low1[right]])
            high = np.concatenate([high0[left], high1[right]])
            symbol = np.concatenate([symbol[left] * 2, symbol[right] * 2 + 1])
        real = symbol > 0
        low, high, symbol = low[real], high[real], symbol[real]
        return symbol, low - self.start[symbol], high - self.start[symbol]


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions in ``data`` where a string of ``length`` bytes starts that another position has too.

    ``data`` holds texts back to back, ``offsets`` their bounds; strings do not
    cross a bound.
    """
    texts = len(offsets) - 1
    n = len(data) + texts
    found = np.zeros(len(data), bool)
    if texts == 0 or n < length + 2:
        return found
    used, dense = np.unique(data, return_inverse=True)
    symbols = np.zeros(n, np.uint16)
    place = np.arange(len(data)) + np.repeat(np.arange(texts), np.diff(offsets))
    symbols[place] = dense + 1
    order = _suffixes(symbols, length)
    last = symbols[order - 1]
    count = np.bincount(last, minlength=len(used) + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    back = np.empty(n, np.int64)
    back[np.argsort(last, kind="stable")] = np.arange(n)
    change = np.zeros(n, np.int32)
    np.cumsum(last[1:] != last[:-1], out=change[1:])
    wavelet = _Wavelet(last)
    unset = np.ones(n + 1, bool)
    unset[n] = unset[0] = False
    low = np.concatenate([np.arange(texts), first[1:-1]])
    high = np.concatenate([np.arange(texts) + 1, first[2:]])
    unset[high] = False
    for _ in range(1, length):
        even = change[low] == change[high - 1]
        plain = even & (last[low] != 0)
        next_low, next_high = back[low[plain]], back[high[plain] - 1] + 1
        if not even.all():
            symbol, a, b = wavelet.symbols(low[~even], high[~even])
            next_low = np.concatenate([next_low, first[symbol] + a])
            next_high = np.concatenate([next_high, first[symbol] + b])
        fresh = unset[next_high]
        low, high = next_low[fresh], next_high[fresh]
        if not len(low):
            break
        unset[high] = False
    rows = np.flatnonzero(unset)
    at = np.full(n, -1, np.int64)
    at[place] = np.arange(len(data))
    for side in (order[rows], order[rows - 1]):
        found[at[side]] = True
    return found
