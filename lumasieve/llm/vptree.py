"""Vantage-point trees over 64-bit fingerprints under Hamming distance.

``near_pairs`` joins many small shards at once: each shard has home rows and visiting rows, and all pairs of two
home rows, or of a home and a visiting row, within the radius come out exactly once. All trees of a batch are
split together, level by level, with array operations. A node splits its home rows at a radius ``mu`` around a
vantage fingerprint. By the triangle inequality a row within ``radius`` of an inner row (distance to the vantage at
most mu) has a distance of at most mu + radius itself, and a row near an outer one has at least mu + 1 - radius:
all other rows are pruned. Outer home rows near the boundary visit the inner child, never the reverse, so that no
pair comes out twice.

A node with many rows that no radius parts, such as fingerprints that spread evenly, is a leaf that is searched by pigeonholes: the 64 bits are cut into
radius + 2 pieces, of which a pair within the radius shares two at least, so that only rows which agree in two pieces meet.

``Trunk`` is the same tree fitted on a bounded sample; it only routes the rows of overfull shards to smaller ones.
"""

from __future__ import annotations

import numpy as np

LEAF = 24
CHUNK = 2_000_000
#: A node of more rows is left whole if its children would have more than this share of its comparisons: fingerprints that spread evenly are all
#: near each other's boundaries, and their visiting rows would only multiply. Such a node is searched by pigeonholes.
LARGE, WORTH = 4096, 0.9


def _expand(first: np.ndarray, count: np.ndarray):
    """Index pairs (k, first[k] + 0 .. count[k] - 1), in pieces of bounded size."""
    if not len(count):
        return
    ends = np.cumsum(count)
    start, done = 0, 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = count[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield left, np.repeat(first[start:stop], n) + inner
        done = int(ends[stop - 1])
        start = stop


def _leaf_pairs(hi, hs, vi, vs, h, t, radius, window, own):
    """Pairs of leaf nodes: rows are ordered by node and time, so that each meets only those in its window.

    A row's key is the sum of the gaps before it in that order, each counted as window + 1 at most; a change of node counts as such a gap. So two
    keys differ by at most ``window`` just if the rows are of one node and that close in time, and no key exceeds the number of rows times window + 1.
    """
    rows, nodes, guest = np.concatenate([hi, vi]), np.concatenate([hs, vs]), np.repeat([False, True], [len(hi), len(vi)])
    order = np.lexsort((t[rows], nodes))
    rows, nodes, guest = rows[order], nodes[order], guest[order]
    gap = np.where(nodes[1:] == nodes[:-1], np.minimum(np.diff(t[rows]), window + 1), window + 1)
    key = np.concatenate([[0], np.cumsum(gap)])
    hi, hs, hk, vi, vk = rows[~guest], nodes[~guest], key[~guest], rows[guest], key[guest]
    end = np.searchsorted(hk, hk + window, "right")
    first = np.arange(len(hi)) + 1
    for a, b in _expand(first, np.where(own[hs], end - first, 0)):
        i, j = hi[a], hi[b]
        near = np.bitwise_count(h[i] ^ h[j]) <= radius
        yield i[near], j[near]
    if len(vi):
        lo, up = np.searchsorted(vk, hk - window, "left"), np.searchsorted(vk, hk + window, "right")
        for a, b in _expand(lo, up - lo):
            i, j = hi[a], vi[b]
            near = np.bitwise_count(h[i] ^ h[j]) <= radius
            yield i[near], j[near]


def _pieces(radius: int) -> list[int]:
    """Masks of radius + 2 pieces of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _near_classes(node: np.ndarray, h: np.ndarray, radius: int):
    """Index pairs of different fingerprints of one node within ``radius`` bits, by pigeonholes; each once, at the first two pieces in which it agrees."""
    masks = [np.uint64(m) for m in _pieces(radius)]
    every, none, still = np.arange(len(h)), np.zeros(0, np.int64), np.zeros(len(h), np.int64)
    for q in range(1, len(masks)):
        for p in range(q):
            # The holes: numbers in place of (node, bits of both pieces).
            bits = h & (masks[p] | masks[q])
            order = np.lexsort((bits, node))
            new = np.ones(len(h), np.int64)
            new[1:] = (node[order][1:] != node[order][:-1]) | (bits[order][1:] != bits[order][:-1])
            hole = np.empty(len(h), np.int64)
            hole[order] = np.cumsum(new) - 1
            for i, j in _leaf_pairs(every, hole, none, none, h, still, radius, 0, np.ones(len(h), bool)):
                differ = h[i] ^ h[j]
                earlier = np.zeros(len(i), bool)
                for k in range(q):
                    if k != p:
                        earlier |= (differ & masks[k]) == 0
                yield i[~earlier], j[~earlier]


def _pigeonhole_pairs(hi, hs, vi, vs, h, t, radius, window, own):
    """Pairs of large leaf nodes: rows of one fingerprint, then rows of near ones; so copies don't multiply the search."""
    rows, node, guest = np.concatenate([hi, vi]), np.concatenate([hs, vs]), np.repeat([False, True], [len(hi), len(vi)])
    order = np.lexsort((t[rows], h[rows], node))
    rows, node, guest = rows[order], node[order], guest[order]
    new = np.ones(len(rows), bool)
    new[1:] = (node[1:] != node[:-1]) | (h[rows[1:]] != h[rows[:-1]])
    kind, first = np.cumsum(new) - 1, np.flatnonzero(new)
    yield from _leaf_pairs(rows[~guest], kind[~guest], rows[guest], kind[guest], h, t, radius, window, own[node[first]])
    # Times as ranks among all bounds, so that (class, time) fits one number whatever the times.
    _, rank = np.unique(np.concatenate([t[rows], t[rows] - window, t[rows] + window]), return_inverse=True)
    span = int(rank.max()) + 1
    at, low, high = rank.reshape(3, -1)
    sides = {g: (np.flatnonzero(guest == g), kind[guest == g] * span + at[guest == g]) for g in (False, True)}
    for a, b in _near_classes(node[first], h[rows[first]], radius):
        for g1, g2 in ((False, False), (False, True), (True, False)):
            mine, keys1 = sides[g1]
            theirs, keys2 = sides[g2]
            x, y = a, b
            if not (g1 or g2):
                among = own[node[first[a]]]
                x, y = a[among], b[among]
            begin, end = np.searchsorted(keys1, x * span), np.searchsorted(keys1, (x + 1) * span)
            for pair, k in _expand(begin, end - begin):
                row, other = mine[k], y[pair]
                lo, up = np.searchsorted(keys2, other * span + low[row]), np.searchsorted(keys2, other * span + high[row], "right")
                for i, j in _expand(lo, up - lo):
                    yield rows[row[i]], rows[theirs[j]]


def near_pairs(shard: np.ndarray, visits: np.ndarray, h: np.ndarray, t: np.ndarray, radius: int, window: int, own: np.ndarray | None = None):
    """Index arrays (i, j), in pieces of at most CHUNK, of all pairs of a shard within ``radius`` bits and ``window`` time units.

    shard: number of each row's shard, 0 to n - 1. visits: true for visiting rows, which don't pair among
    themselves. own: per shard, whether its home rows pair among themselves (default: yes). Fewer than two rows
    give no pair; rows of equal fingerprints pair like any others.
    """
    if len(shard) < 2:
        return
    hi, vi = np.flatnonzero(~visits), np.flatnonzero(visits)
    hs, vs = shard[hi].astype(np.int64), shard[vi].astype(np.int64)
    n_nodes = int(shard.max()) + 1
    own = np.ones(n_nodes, bool) if own is None else own
    while len(hi):
        order = np.argsort(hs, kind="stable")
        hi, hs = hi[order], hs[order]
        size = np.bincount(hs, minlength=n_nodes)
        begin = np.cumsum(size) - size
        split = size > LEAF
        mu = np.full(n_nodes, -1)
        dist = np.zeros(len(hi), np.int64)
        vantage = np.zeros(n_nodes, np.uint64)
        if split.any():
            nodes = np.flatnonzero(split)
            vantage[nodes] = h[hi[begin[nodes] + size[nodes] // 2]]
            dist = np.bitwise_count(h[hi] ^ vantage[hs]).astype(np.int64)
            ranked = dist[np.lexsort((dist, hs))]
            low, high, mid = ranked[begin[nodes]], ranked[begin[nodes] + size[nodes] - 1], ranked[begin[nodes] + size[nodes] // 2]
            mu[nodes] = np.where(mid < high, mid, mid - 1)
            split[nodes[low == high]] = False  # equally far from the vantage: no radius parts them
        inner = dist <= mu[hs]
        border = ~inner & (dist <= mu[hs] + radius) & own[hs]
        v_dist = np.bitwise_count(h[vi] ^ vantage[vs]).astype(np.int64)
        v_in, v_out = v_dist <= mu[vs] + radius, v_dist > mu[vs] - radius
        per = lambda nodes: np.bincount(nodes, minlength=n_nodes).astype(np.float64)
        n_in, n_visits = per(hs[inner]), per(vs)
        n_out = size - n_in
        work = size * (own * size / 2 + n_visits)
        below = n_in * (own * n_in / 2 + per(hs[border]) + per(vs[v_in])) + n_out * (own * n_out / 2 + per(vs[v_out]))
        split &= (size + n_visits <= LARGE) | (below <= WORTH * work)
        at_leaf, v_leaf = ~split[hs], ~split[vs]
        large = size + n_visits > LARGE
        for search, of_kind in ((_leaf_pairs, ~large), (_pigeonhole_pairs, large)):
            a, b = at_leaf & of_kind[hs], v_leaf & of_kind[vs]
            if a.any():
                yield from search(hi[a], hs[a], vi[b], vs[b], h, t, radius, window, own)
        hi, hs, inner, border = hi[~at_leaf], hs[~at_leaf], inner[~at_leaf], border[~at_leaf]
        vi, vs, v_in, v_out = vi[~v_leaf], vs[~v_leaf], v_in[~v_leaf], v_out[~v_leaf]
        if not len(hi):
            break
        number = np.cumsum(split) - 1
        vi, vs = np.concatenate([hi[border], vi[v_in], vi[v_out]]), np.concatenate([2 * number[hs[border]], 2 * number[vs[v_in]], 2 * number[vs[v_out]] + 1])
        own = np.repeat(own[split], 2)
        hs = 2 * number[hs] + ~inner
        n_nodes = 2 * int(split.sum())


class Trunk:
    """Routing tree: node k has children 2k + 1 (inner) and 2k + 2 (outer); leaves have mu -1."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.depth, self.radius = depth, radius
        self.vantage, self.mu = np.zeros(2 ** (depth + 1), np.uint64), np.full(2 ** (depth + 1), -1)
        self._fit(np.unique(sample.astype(np.uint64)), 0, depth)

    def _fit(self, points, node, depth):
        if depth == 0 or len(points) < 4:
            return
        dist = np.bitwise_count(points ^ points[len(points) // 2]).astype(np.int64)
        # The radius whose fuller side, with its visitors, is smallest.
        seen = np.cumsum(np.bincount(dist, minlength=66 + 2 * self.radius))
        radii = np.arange(int(dist.min()), int(dist.max()))
        if not len(radii):
            return
        most = np.maximum(seen[radii + self.radius], len(points) - seen[radii])
        best = int(np.argmin(most))
        if most[best] > 0.9 * len(points):
            return
        self.vantage[node], self.mu[node] = points[len(points) // 2], radii[best]
        self._fit(points[dist <= radii[best]], 2 * node + 1, depth - 1)
        self._fit(points[dist > radii[best]], 2 * node + 2, depth - 1)

    def route(self, h: np.ndarray, visits: np.ndarray):
        """(row, leaf, visits) of every shard that a row belongs to or may have a partner in."""
        row, node, guest = np.arange(len(h)), np.zeros(len(h), np.int64), visits.copy()
        for _ in range(self.depth):
            mu = self.mu[node]
            inside = mu >= 0
            dist = np.bitwise_count(h[row] ^ self.vantage[node]).astype(np.int64)
            into_in = inside & np.where(guest, dist <= mu + self.radius, dist <= mu)
            border = inside & ~guest & (dist > mu) & (dist <= mu + self.radius)
            into_out = inside & np.where(guest, dist > mu - self.radius, dist > mu)
            stay = ~inside
            node = np.concatenate([node[stay], 2 * node[into_in] + 1, 2 * node[border] + 1, 2 * node[into_out] + 2])
            guest = np.concatenate([guest[stay], guest[into_in], np.ones(int(border.sum()), bool), guest[into_out]])
            row = np.concatenate([row[stay], row[into_in], row[border], row[into_out]])
        return row, node, guest
