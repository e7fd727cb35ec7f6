"""Hierarchical navigable small-world graphs in NumPy.

Nodes are ordered by level, so a layer is a prefix of the nodes and its links one matrix.
Nodes are inserted in batches: the batch searches the graph so far, sees its own members
too, keeps diverse neighbours (one is kept if it is nearer to the node than to any neighbour
already kept), and its neighbours choose anew among their links and the new ones. Searches
run in lockstep for many queries, a beam each.
"""

from __future__ import annotations

import numpy as np

#: Links of a node, and on the ground layer.
LINKS, GROUND = 16, 32
#: Beam while building, and on the layers above the ground.
BUILD_BEAM, UPPER_BEAM = 64, 8
#: Nodes of the top layer are all looked at.
TOP = 64
#: Beam members that a step expands, and queries that run in lockstep.
STEP, LANE = 4, 512


def beam_search(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (descending, -1 and -2 where there are none) of up to `beam` near nodes of each query."""
    ids_out, sims_out = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)
    for a in range(0, len(q), LANE):
        _lane(q[a : a + LANE], x, links, entry[a : a + LANE], ids_out[a : a + LANE], sims_out[a : a + LANE])
    return ids_out, sims_out


def _lane(q, x, links, entry, ids_out, sims_out) -> None:
    beam, rows = ids_out.shape[1], np.arange(len(q))
    seen = np.zeros((len(q), len(links)), bool)
    ids, sims, done = ids_out.copy(), sims_out.copy(), np.ones(ids_out.shape, bool)

    def offer(ids, sims, done, q, seen, new):
        """Merges unseen nodes (a row of candidates per query) into the beams."""
        new = np.sort(new, axis=1)
        r = np.arange(len(q))[:, None]
        ok = new >= 0
        ok[:, 1:] &= new[:, 1:] != new[:, :-1]
        ok &= ~seen[r, np.maximum(new, 0)]
        i, j = np.nonzero(ok)
        at = new[i, j]
        seen[i, at] = True
        s = np.full(new.shape, -2, np.float32)
        s[i, j] = np.einsum("nd,nd->n", q[i], x[at])
        s_all, i_all, d_all = np.concatenate((sims, s), 1), np.concatenate((ids, np.where(ok, new, -1)), 1), np.concatenate((done, ~ok), 1)
        k = np.argpartition(-s_all, beam - 1, axis=1)[:, :beam]
        return i_all[r, k].astype(np.int32), s_all[r, k], d_all[r, k]

    ids, sims, done = offer(ids, sims, done, q, seen, entry)
    while True:
        live = ~done.all(1)
        if not live.all():
            out = rows[~live]
            o = np.argsort(-sims[~live], axis=1, kind="stable")
            ids_out[out], sims_out[out] = np.take_along_axis(ids[~live], o, 1), np.take_along_axis(sims[~live], o, 1)
            rows, q, seen, ids, sims, done = rows[live], q[live], seen[live], ids[live], sims[live], done[live]
        if not len(rows):
            return
        r = np.arange(len(rows))[:, None]
        t = min(STEP, beam)
        k = np.argpartition(np.where(done, np.float32(3), -sims), t - 1, axis=1)[:, :t]
        best = np.where(done[r, k], -1, ids[r, k])
        done[r, k] = True
        new = np.where(best[:, :, None] >= 0, links[np.maximum(best, 0)], -1).reshape(len(rows), -1)
        ids, sims, done = offer(ids, sims, done, q, seen, new)


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to `keep` of each row's candidates (in descending order): diverse ones first, then the nearest."""
    n, c = ids.shape
    kept, count = np.full((n, keep), -1, np.int32), np.zeros(n, np.int32)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        own = np.flatnonzero((ids[:, j] >= 0) & (count < keep))
        if not own.size:
            continue
        v = x[ids[own, j]]
        s = np.einsum("nd,nkd->nk", v, x[np.maximum(kept[own], 0)])
        s[kept[own] < 0] = -2
        good = own[s.max(1) < sims[own, j]]
        kept[good, count[good]] = ids[good, j]
        count[good] += 1
        taken[good, j] = True
    for j in range(c):
        own = np.flatnonzero((ids[:, j] >= 0) & (count < keep) & ~taken[:, j])
        kept[own, count[own]] = ids[own, j]
        count[own] += 1
    return kept


class Graph:
    """x: unit vectors (float32) in the order of levels; layers: links of each layer, top first."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @staticmethod
    def order(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Order of nodes by level, levels drawn from hashes of the nodes (uint64); sizes of the layers, top first."""
        u = np.argsort(keys, kind="stable")
        sizes, n = [], len(keys)
        while n > TOP:
            sizes.append(n)
            n //= LINKS
        return u, [*sizes, n][::-1] if n else sizes[::-1]

    @classmethod
    def build(cls, x: np.ndarray, sizes: list[int]) -> Graph:
        g = cls(x, [])
        for n in sizes:
            g.layers.append(g._layer(n, GROUND if n == len(x) else LINKS))
        return g

    def _near(self, q: np.ndarray, a: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest k of the first a nodes, by all of them."""
        s = q @ self.x[:a].T
        k = min(k, a)
        i = np.argpartition(-s, k - 1, axis=1)[:, :k]
        o = np.argsort(-np.take_along_axis(s, i, 1), axis=1)
        i = np.take_along_axis(i, o, 1)
        return i.astype(np.int32), np.take_along_axis(s, i, 1)

    def _layer(self, n: int, links: int) -> np.ndarray:
        out = np.full((n, links), -1, np.int32)
        # the layer above is inserted first, as searches enter by its nodes
        a, first = 0, min(n, max(256, len(self.layers[-1]) if self.layers else 0))
        while a < n:
            b = first if not a else min(n, a + min(1024, max(64, a // 4)))
            q = self.x[a:b]
            own, mine = self._among(q, a)
            if a:
                ids, sims = beam_search(q, self.x, out[:a], self.descend(q), BUILD_BEAM)
                ids, sims = np.concatenate((ids, own), 1), np.concatenate((sims, mine), 1)
                o = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
            else:
                ids, sims = own, mine
            out[a:b, : links // 2] = diverse(self.x, ids, sims, links // 2)
            self._back(out, a, b)
            a = b
        return out

    def _among(self, q: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest members of the same batch, itself left out."""
        s = q @ q.T
        np.fill_diagonal(s, -2)
        k = min(LINKS, len(q))
        i = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, i, 1)
        o = np.argsort(-v, axis=1)
        i, v = np.take_along_axis(i, o, 1), np.take_along_axis(v, o, 1)
        return np.where(v > -2, i + a, -1).astype(np.int32), v

    def _back(self, out: np.ndarray, a: int, b: int) -> None:
        """Links from the neighbours of nodes a to b back to them."""
        new, to = np.repeat(np.arange(a, b), out.shape[1]), out[a:b].ravel()
        new, to = new[to >= 0], to[to >= 0]
        links = out.shape[1]
        while len(to):
            o = np.argsort(to, kind="stable")
            new, to = new[o], to[o]
            head = np.flatnonzero(np.diff(to, prepend=-1))
            rank = np.arange(len(to)) - np.repeat(head, np.diff(np.append(head, len(to))))
            now = rank < links  # a node with more new links takes them in turns
            t = to[head]
            cand = np.full((len(t), 2 * links), -1, np.int32)
            cand[:, :links] = out[t]
            cand[np.searchsorted(t, to[now]), links + rank[now]] = new[now]
            cand[:, links:][(cand[:, links:, None] == cand[:, None, :links]).any(2)] = -1
            sims = np.full(cand.shape, -2, np.float32)
            i, j = np.nonzero(cand >= 0)
            sims[i, j] = np.einsum("nd,nd->n", self.x[t[i]], self.x[cand[i, j]])
            o = np.argsort(-sims, axis=1, kind="stable")
            out[t] = diverse(self.x, np.take_along_axis(cand, o, 1), np.take_along_axis(sims, o, 1), links)
            new, to = new[~now], to[~now]

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Entry points below the layers that are there."""
        if not self.layers:
            return np.zeros((len(q), 1), np.int32)
        entry = self._near(q, len(self.layers[0]), UPPER_BEAM)[0]
        for links in self.layers[1:]:
            entry = beam_search(q, self.x, links, entry, UPPER_BEAM)[0]
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.layers) == 1:
            return self._near(q, len(self.x), beam)
        top = Graph(self.x, self.layers[:-1])
        return beam_search(q, self.x, self.layers[-1], top.descend(q), min(beam, len(self.x)))
