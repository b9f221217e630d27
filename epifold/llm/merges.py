"""Pieces of many parts of texts at once, for models of which parts are independent.

The distinct parts of a block are told by Arrow's dictionary. Characters and
pieces are numbered as symbols, and every pair of symbols whose joined text is a
piece is in one sorted table. Parts of like length are the columns of a matrix;
a round merges the best pair of every column, the leftmost of equal ones, as one
part alone would be merged. Columns without a pair left are done.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from epifold.llm import words

#: Most characters of the parts of one matrix; longer parts are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: Places of one matrix.
CELLS = 1 << 18
PLACE_BITS = 6
NONE = np.int32(2**31 - 1)
SPACE = 0x20


class Merger:
    """The ids of the parts of valid texts without a written "▁", by the pieces of one model."""

    def __init__(self, model, blank: str, solve: Callable[[str], bytes]):
        self.solve = solve
        symbols = {p: k for k, p in enumerate(model.ids)}
        for p in model.ids:
            for c in p:
                symbols.setdefault(c, len(symbols))
        #: The symbol of characters that no piece holds; it is in no pair.
        other = len(symbols)
        self.id_of = np.full(other + 1, -1, np.int32)
        self.id_of[: len(model.ids)] = list(model.ids.values())
        self.of_char = np.full(0x110000, other, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.of_char[SPACE] = symbols[blank]
        self.byte_ids = np.array([model.byte_ids[b] for b in range(256)], np.int32)
        # Equal scores are one rank.
        order = np.unique([model.ranks[p] for p in model.ids], return_inverse=True)[1]
        self.base = np.int64(other + 1)
        pairs = {}
        for p, k in list(symbols.items())[: len(model.ids)]:
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.base) + right] = k
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[x] for x in self.pairs.tolist()], np.int32)
        self.rank = (order[self.joined] << PLACE_BITS).astype(np.int32)
        known = {c for p in model.ids for c in p}
        self.alone = np.array([b < 128 and b != SPACE and chr(b) not in known for b in range(256)])

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that have a character each, with a blank put before each, and the ids before every text."""
        rows = len(offsets) - 1
        at = offsets + np.arange(rows + 1)
        text = np.full(len(data) + rows, SPACE, np.uint8)
        own = np.ones(len(text), bool)
        own[at[:-1]] = False
        text[own] = data
        # As the model's pattern for parts: blanks and what follows them, or a character alone.
        space, alone = text == SPACE, self.alone[text]
        begin = np.ones(len(text), bool)
        begin[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begin[at[:-1]] = True
        starts = np.flatnonzero(begin)
        found = words.binary(text, np.append(starts, len(text))).dictionary_encode()
        ids, bounds = self.parts(found.dictionary)
        part = found.indices.to_numpy()
        size = np.diff(bounds)[part]
        before = words.offsets_of(size)
        take = np.repeat(bounds[part] - before[:-1], size) + np.arange(before[-1])
        return ids[take], before[np.searchsorted(starts, at)]

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, one after the other, and the ids before each."""
        data, offsets = words.column(pa.RecordBatch.from_arrays([parts], ["part"]), "part")
        head = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        symbols = self.of_char[chars]
        first = np.searchsorted(head, offsets)
        length = np.diff(first)
        # The symbol that starts at a character, or -1.
        ends = np.full(len(chars), -1, np.int32)
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((length > low) & (length <= width))
            step = CELLS // width
            for k in range(0, len(some), step):
                pick = some[k : k + step]
                self._merge(symbols, ends, first[pick], length[pick], width)
            low = width
        kept = np.flatnonzero(ends >= 0)
        ids = self.id_of[ends[kept]]
        # What is no piece is one character, and stands as its bytes.
        size = np.ones(len(ids), np.int64)
        lost = ids < 0
        size[lost] = (np.append(head, len(data))[kept[lost] + 1]) - head[kept[lost]]
        before = words.offsets_of(size)
        out = np.repeat(ids, size)
        raw = np.flatnonzero(out < 0)
        owner = np.searchsorted(before, raw, "right") - 1
        out[raw] = self.byte_ids[data[head[kept[owner]] + raw - before[owner]]]
        bounds = before[np.searchsorted(kept, first)]
        long = np.flatnonzero(length > WIDTHS[-1])
        if len(long):
            texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8") for r in long.tolist()]
            solved = [np.frombuffer(self.solve(t), np.int32) for t in texts]
            out = np.insert(out, np.repeat(bounds[long], [len(s) for s in solved]), np.concatenate(solved))
            extra = np.zeros(len(length), np.int64)
            extra[long] = [len(s) for s in solved]
            bounds = bounds + words.offsets_of(extra)
        return out, bounds

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' numbers in the table, -1 if they are not there."""
        key = left * self.base + right
        if not len(self.pairs):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def _merge(self, symbols: np.ndarray, ends: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> None:
        """Write into ``ends`` the symbols of the parts from ``first`` on when no pair is left."""
        n = len(first)
        place = np.arange(width)[:, None]
        inside = place < length
        # Flat matrices, a column for each part: place * n + column.
        where = np.minimum(first + place, len(symbols) - 1)
        now = np.where(inside, symbols[where], -1).astype(np.int32).ravel()
        pair = np.full(width * n, -1, np.int32)
        both = np.flatnonzero((place + 1 < length).ravel())
        pair[both] = self._pairs(now[both].astype(np.int64), now[both + n])
        cost = np.full(width * n, NONE, np.int32)
        hit = np.flatnonzero(pair >= 0)
        cost[hit] = self.rank[pair[hit]] + (hit // n).astype(np.int32)
        after = (np.arange(width * n) + n).astype(np.int64)
        prior = (np.arange(width * n) - n).astype(np.int64)
        stop = length.astype(np.int64) * n + np.arange(n)
        column = np.arange(n)
        while True:
            table = cost.reshape(width, n)
            best = table[:, column].min(axis=0) if len(column) < n // 2 else table.min(axis=0)[column]
            alive = best < NONE
            column = column[alive]
            if not len(column):
                break
            at = (best[alive] & ((1 << PLACE_BITS) - 1)) * np.int64(n) + column
            gone = after[at]
            now[at] = self.joined[pair[at]]
            now[gone] = -1
            cost[gone] = NONE
            beyond = after[gone]
            after[at] = beyond
            end = stop[column]
            more = beyond < end
            prior[beyond[more]] = at[more]
            cost[at] = NONE
            back = prior[at]
            ahead = back >= 0
            left = np.concatenate([at[more], back[ahead]])
            right = np.concatenate([beyond[more], at[ahead]])
            found = self._pairs(now[left].astype(np.int64), now[right])
            pair[left] = found
            cost[left] = np.where(found >= 0, self.rank[found] + (left // n).astype(np.int32), NONE)
        ends[where[inside]] = now.reshape(width, n)[inside]
