"""Pairs of near 64-bit hashes by array operations, within a set or between two.

Few rows are compared one by one. Many are cut into threshold + 2 pieces (8 at least), of which a pair within the threshold shares two, so that only
rows which agree in two pieces meet; where that would spare little, as when all agree in some pieces, they are compared one by one after all.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
#: Comparisons that need no pigeonholes; how many plain comparisons one between rows of a hole costs.
FEW, DEARER = 4_000_000, 4


def pieces(threshold: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of threshold + 2 pieces of the 64 bits, 8 at least, so that two of them fit 16 bits."""
    n = max(8, threshold + 2)
    edges = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _each(x: np.ndarray, y: np.ndarray, threshold: int, same: bool):
    step = max(1, CHUNK // max(1, len(y)))
    for lo in range(0, len(x), step):
        first = lo if same else 0
        for at in range(first, len(y), CHUNK):
            i, j = np.nonzero(np.bitwise_count(x[lo : lo + step, None] ^ y[None, at : at + CHUNK]) <= threshold)
            i, j = i + lo, j + at
            keep = i < j if same else slice(None)
            yield i[keep], j[keep]


def _expand(first: np.ndarray, count: np.ndarray):
    """Index pairs (k, first[k] + 0 .. count[k] - 1), in pieces of bounded size (of one k at least)."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        done = ends[start] - count[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = count[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        yield left, np.arange(len(left)) + np.repeat(first[start:stop] - (ends[start:stop] - n - done), n)
        start = stop


def near(x: np.ndarray, y: np.ndarray | None, threshold: int):
    """Index pairs (i, j), in pieces, of x[i] and y[j] within the threshold, each once; without y those of x with i < j. x, y: uint64, no value twice in either."""
    same = y is None
    y = x if same else y
    if len(x) * len(y) <= FEW:
        yield from _each(x, y, threshold, same)
        return
    cut = pieces(threshold)
    masks = [np.uint64(((1 << width) - 1) << lo) for lo, width in cut]
    part = lambda h: [((h & m) >> np.uint64(lo)).astype(np.uint16) for m, (lo, _) in zip(masks, cut)]
    px = part(x)
    py = px if same else part(y)
    pairs = [(p, q) for q in range(1, len(cut)) for p in range(q)]
    hole = lambda parts, p, q: (parts[p] << np.uint16(cut[q][1])) | parts[q]
    tally = lambda holes, p, q: np.bincount(holes, minlength=1 << (cut[p][1] + cut[q][1]))
    meet = sum(int(tally(hole(px, p, q), p, q) @ tally(hole(py, p, q), p, q)) for p, q in pairs)
    if DEARER * meet > len(x) * len(y):
        yield from _each(x, y, threshold, same)
        return
    for p, q in pairs:
        hx, hy = hole(px, p, q), hole(py, p, q)
        count = tally(hy, p, q)
        end = np.cumsum(count)
        order = np.argsort(hy, kind="stable")
        if same:
            rows, first = order, np.arange(len(x)) + 1
            count = end[hx[order]] - first
        else:
            rows = np.argsort(hx, kind="stable")
            first, count = (end - count)[hx[rows]], count[hx[rows]]
        xs, ys = x[rows], y[order]
        for i, j in _expand(first, count):
            differ = xs[i] ^ ys[j]
            found = np.flatnonzero(np.bitwise_count(differ) <= threshold)
            i, j, differ = i[found], j[found], differ[found]
            # A pair counts in the hole of the first two pieces in which it agrees.
            first_time = np.ones(len(i), bool)
            for k in range(q):
                if k != p:
                    first_time &= (differ & masks[k]) != 0
            i, j = rows[i[first_time]], order[j[first_time]]
            yield (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)
