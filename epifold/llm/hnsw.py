"""Hierarchical navigable small-world graph of one shard, in numpy.

Points get a top layer at random. Each layer is a graph over its points, built
from the sparsest layer down: points join in batches, find their neighbours with
a beam search that starts where the search of the layer above ended, and keep
those that are not closer to a kept one than to the point. Searches run for many
queries in step, so the work is in array operations.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

DEGREE = 12
BEAM = 48
BATCH = 512
FIRST = 128
#: Queries of an audit that are compared with all points at once.
AUDITED = 64


def _select(sims: np.ndarray, between: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates (rows sorted by similarity) become neighbours: a row of booleans for each point."""
    rows, width = sims.shape
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)
    count = np.zeros(rows, int)
    for i in range(width):
        take = np.isfinite(sims[:, i]) & (count < keep) & (sims[:, i] > nearest[:, i])
        chosen[take, i] = True
        count += take
        np.maximum(nearest, np.where(take[:, None], between[:, i, :], -np.inf), out=nearest)
    # Places left are filled with the nearest of the rest.
    rest = np.isfinite(sims) & ~chosen
    chosen |= rest & (np.cumsum(rest, axis=1) <= (keep - count)[:, None])
    return chosen


def _pack(ids: np.ndarray, chosen: np.ndarray, keep: int) -> np.ndarray:
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    packed = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(ids, order, 1), -1)
    return np.pad(packed, ((0, 0), (0, keep - packed.shape[1])), constant_values=-1)


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int):
    """The ``beam`` best points found for each query, best first, -1 where there are fewer."""
    rows = len(queries)
    every = np.arange(rows)
    seen = np.zeros((rows, len(points) + 1), bool)
    seen[:, -1] = True
    ids = np.full((rows, beam), -1, np.int32)
    sims = np.full((rows, beam), -np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    k = min(entry.shape[1], beam)
    ids[:, :k] = entry[:, :k]
    valid = ids[:, :k] >= 0
    sims[:, :k] = np.where(valid, np.einsum("rd,rkd->rk", queries, points[ids[:, :k]]), -np.inf)
    done[:, :k] = ~valid
    seen[every[:, None], ids[:, :k]] = True
    order = np.argsort(-sims, axis=1)
    ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
    cells, across = seen.reshape(-1), seen.shape[1]
    while True:
        best = np.argmin(done, axis=1)
        live = np.flatnonzero(~done[every, best])
        if not len(live):
            return ids, sims
        at = best[live]
        done[live, at] = True
        near = links[ids[live, at]]
        # A link that is not there leads to the last column, which counts as seen.
        cell = (live * across)[:, None] + np.where(near < 0, across - 1, near)
        row, col = np.nonzero(~cells[cell])
        cells[cell[row, col]] = True
        new, asks = near[row, col], live[row]
        found = np.einsum("rd,rd->r", queries.take(asks, axis=0), points.take(new, axis=0))
        # What is no better than the last of a beam leaves it as it is.
        better = found > sims[asks, -1]
        row, new, found = row[better], new[better], found[better]
        count = np.bincount(row, minlength=len(live))
        some = np.flatnonzero(count)
        if not len(some):
            continue
        live, first, wide = live[some], np.cumsum(count) - count, beam + int(count.max())
        place = np.repeat(np.arange(len(some)) * wide + beam - first[some], count[some]) + np.arange(len(row))
        all_sims, all_ids, all_done = (np.full((len(some), wide), x, y.dtype) for x, y in ((-np.inf, sims), (-1, ids), (True, done)))
        for into, x, more in ((all_sims, sims, found), (all_ids, ids, new), (all_done, done, False)):
            into[:, :beam] = x[live]
            into.reshape(-1)[place] = more
        order = np.argsort(-all_sims, axis=1)[:, :beam] + (np.arange(len(some)) * wide)[:, None]
        sims[live], ids[live], done[live] = (x.reshape(-1)[order] for x in (all_sims, all_ids, all_done))


class Layer:
    """Members of a layer with their links, which are places in the layer."""

    def __init__(self, points: np.ndarray, members: np.ndarray, links: np.ndarray):
        self.members, self.links, self.points = members, links, points[members]
        self.place = np.full(len(points) + 1, -1, np.int32)
        self.place[members] = np.arange(len(members), dtype=np.int32)

    def places(self, points: np.ndarray) -> np.ndarray:
        """Places of points of the shard, -1 for those that are not here."""
        return self.place[points]


class Graph:
    """Layers from the sparsest to the one of all points; entries lead one layer down."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.points = points
        self.beam = BEAM
        n = len(points)
        rng = np.random.default_rng(seed)
        top = np.minimum(np.floor(-np.log(rng.random(n)) / np.log(DEGREE)).astype(int), 6)
        shuffled = rng.permutation(n)
        self.layers: list[Layer] = []
        for level in range(int(top.max(initial=0)), -1, -1):
            members = shuffled[top[shuffled] >= level]
            if level and len(members) < 2 * DEGREE:
                continue
            self.layers.append(self._build(members, 2 * DEGREE if level == 0 else DEGREE))

    def _entries(self, queries: np.ndarray, layers: list[Layer]) -> np.ndarray:
        """Points of the whole shard at which a search below these layers starts."""
        found = None
        for layer in layers:
            entry = np.zeros((len(queries), 1), np.int32) if found is None else layer.places(found)
            ids, _ = beam_search(layer.points, layer.links, queries, entry, 4)
            found = np.where(ids >= 0, layer.members[ids], -1)
        return found

    def _build(self, members: np.ndarray, keep: int) -> Layer:
        n = len(members)
        links = np.full((n, keep), -1, np.int32)
        layer = Layer(self.points, members, links)
        x = layer.points
        done = 0
        while done < n:
            size = min(n - done, FIRST if not done else min(BATCH, done))
            new = np.arange(done, done + size, dtype=np.int32)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(keep, size)
            part = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sims = new[part], np.take_along_axis(own, part, 1)
            if done:
                entry = self._entries(x[new], self.layers)
                entry = np.zeros((size, 1), np.int32) if entry is None else layer.places(entry)
                entry = np.where((entry >= 0) & (entry < done), entry, -1)
                entry = np.concatenate([entry, np.full((size, 1), 0, np.int32)], axis=1)
                entry[:, -1] = np.where((entry[:, :-1] == 0).any(axis=1), -1, 0)
                old, old_sims = beam_search(x, links, x[new], entry, BEAM)
                ids, sims = np.concatenate([ids, old], axis=1), np.concatenate([sims, old_sims], axis=1)
            self._link(x, links, new, ids, sims, keep)
            # Links back, all new ones of a point at once.
            source, target = np.repeat(new, keep), links[new].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            points, start, count = np.unique(target, return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            step = self._step(x)
            for a in range(0, len(points), step):
                p, s, c = points[a : a + step], start[a : a + step], count[a : a + step]
                width = int(c.max())
                back = np.full((len(p), width), -1, np.int32)
                row = np.repeat(np.arange(len(p)), c)
                place = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                back[row, place] = source[np.repeat(s, c) + place]
                back = np.where((back[:, :, None] == links[p][:, None, :]).any(axis=2), -1, back)
                ids = np.concatenate([links[p], back], axis=1)
                sims = np.where(ids >= 0, np.einsum("rd,rkd->rk", x[p], x[ids]), -np.inf)
                self._link(x, links, p, ids, sims, keep)
            done += size
        return layer

    @staticmethod
    def _step(x: np.ndarray) -> int:
        """Rows that are linked at once: fewer, the longer vectors are."""
        return max(16, min(BATCH, (1 << 15) // x.shape[1]))

    @classmethod
    def _link(cls, x, links, rows, ids, sims, keep, limit=64):
        order = np.argsort(-sims, axis=1)[:, :limit]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        step = cls._step(x)
        for a in range(0, len(rows), step):
            near = x[ids[a : a + step]]
            chosen = _select(sims[a : a + step], near @ near.transpose(0, 2, 1), keep)
            links[rows[a : a + step]] = _pack(ids[a : a + step], chosen, keep)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        last = self.layers[-1]
        entry = self._entries(queries, self.layers[:-1])
        entry = np.zeros((len(queries), 1), np.int32) if entry is None else last.places(entry)
        ids, sims = beam_search(last.points, last.links, queries, entry, beam)
        return np.where(ids >= 0, last.members[ids], -1), sims

    def within(self, queries: np.ndarray, least: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs at least that similar; a beam full of them is widened."""
        rows, found = zip(*self.pairs(queries, least, beam)) if len(queries) else ((), ())
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(found or [np.zeros(0, int)])

    def pairs(self, queries: np.ndarray, least: float, beam: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``within`` in pieces: however many there are, few are held at once."""
        beam, n = min(beam or self.beam, len(self.points)), len(self.points)
        todo = np.arange(len(queries))
        while len(todo):
            full = []
            batch = max(16, min(BATCH, (1 << 23) // max(1, n), (1 << 17) // max(1, beam)))
            for i in range(0, len(todo), batch):
                part = todo[i : i + batch]
                if beam >= n:
                    sims = queries[part] @ self.points.T
                    q, p = np.nonzero(sims >= least)
                else:
                    ids, sims = self.search(queries[part], beam)
                    hit = sims >= least
                    more = hit[:, -1]
                    full.append(part[more])
                    q, place = np.nonzero(hit & ~more[:, None])
                    p = ids[q, place]
                yield part[q], p
            todo = np.concatenate(full) if full else todo[:0]
            beam = min(n, 2 * beam)

    def audit(self, least: float, sample: int, wanted: float) -> None:
        """Widen the beam until a sample of points finds its links; a beam of all points finds them all."""
        n = len(self.points)
        queries = self.points[np.linspace(0, n - 1, min(n, sample)).astype(int)]
        links = sum(int((queries[i : i + AUDITED] @ self.points.T >= least).sum()) for i in range(0, len(queries), AUDITED))
        while self.beam < n:
            found = sum(len(q) for q, _ in self.pairs(queries, least))
            if found >= wanted * links:
                return
            self.beam = min(n, 2 * self.beam)

    def dump(self) -> bytes:
        out = io.BytesIO()
        layers = {f"{kind}{i}": x.astype(np.int32) for i, y in enumerate(self.layers) for kind, x in (("m", y.members), ("l", y.links))}
        np.savez(out, beam=self.beam, **layers)
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes, points: np.ndarray) -> Graph:
        graph = cls.__new__(cls)
        stored = np.load(io.BytesIO(content))
        graph.points, graph.beam = points, int(stored["beam"])
        graph.layers = [Layer(points, stored[f"m{i}"], stored[f"l{i}"]) for i in range((len(stored.files) - 1) // 2)]
        return graph
