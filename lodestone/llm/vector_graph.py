"""Robust-pruned neighbour graphs of one cell of vectors, and range search on them.

Plain NumPy on the bounded group that one Spark task holds. Rows of ``units`` are unit
vectors in double precision; a neighbour table has a row a vector, padded with -1.
"""

from __future__ import annotations

import numpy as np

#: Neighbours a vector keeps, nearest candidates it chooses from, far ones among them.
DEGREE, POOL, FAR = 24, 56, 8
ALPHA = 1.2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, safe for components whose squares overflow or vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def centres(units: np.ndarray, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """``k`` centres by spherical k-means, begun at random vectors."""
    rng = np.random.default_rng(seed)
    found = units[rng.choice(len(units), min(k, len(units)), replace=False)]
    for _ in range(rounds):
        nearest = (units @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, nearest, units)
        length = np.linalg.norm(total, axis=1)
        some = length > 1e-9
        found[some] = total[some] / length[some, None]
    return found


def prune(units: np.ndarray, rows: np.ndarray, pool: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of ``rows`` out of ``pool`` (candidates a row, -1 for none), ``degree`` at most.

    The nearest candidate stays, and those go that are nearer to it, by the factor
    ``ALPHA``, than to the row; then the next.
    """
    out = np.full((len(rows), degree), -1, np.int64)
    for s in range(0, len(rows), 256):
        at = rows[s : s + 256]
        cand = pool[s : s + 256]
        there = units[np.maximum(cand, 0)]
        far = np.where(cand >= 0, 1 - np.einsum("bld,bd->bl", there, units[at]), np.inf)
        order = far.argsort(axis=1, kind="stable")
        cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
        there = np.take_along_axis(there, order[:, :, None], 1)
        between = 1 - there @ there.transpose(0, 2, 1)
        alive, each = cand >= 0, np.arange(len(at))
        for r in range(degree):
            first = alive.argmax(axis=1)
            some = alive[each, first]
            if not some.any():
                break
            out[s : s + 256, r] = np.where(some, cand[each, first], -1)
            alive &= ~(some[:, None] & (ALPHA * between[each, first] <= far))
            alive[each, first] = False
    return out


def build(units: np.ndarray, seed: int) -> np.ndarray:
    """Neighbour table of a cell: pruned nearest and some far vectors, their reverses pruned
    again, and the neighbours on two rings of vectors sorted by a random projection.

    The rings make the graph one piece and chain vectors of one direction, which pruning parts.
    """
    n, rng = len(units), np.random.default_rng(seed)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    take, rows = min(POOL, n - 1), np.arange(n)
    pool = np.full((n, take + FAR), -1, np.int64)
    for s in range(0, n, 256):
        near = units[s : s + 256] @ units.T
        near[np.arange(len(near)), rows[s : s + 256]] = -np.inf
        pool[s : s + 256, :take] = np.argpartition(-near, take - 1, axis=1)[:, :take]
    others = rng.integers(0, n, (n, FAR))
    pool[:, take:] = np.where((others == rows[:, None]) | (others[:, :, None] == pool[:, None, :take]).any(axis=2), -1, others)
    chosen = prune(units, rows, pool)
    a, b = np.repeat(rows, DEGREE)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    order = np.lexsort((-np.einsum("pd,pd->p", units[a], units[b]), a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    width = POOL + FAR
    again = np.full((n, width), -1, np.int64)
    again[a[nth < width], nth[nth < width]] = b[nth < width]
    crowded = np.bincount(a, minlength=n) > DEGREE
    chosen = again[:, :DEGREE].copy()
    chosen[crowded] = prune(units, rows[crowded], again[crowded])
    rings = []
    for _ in range(2):
        ring = (units @ rng.standard_normal(units.shape[1])).argsort(kind="stable")
        after = np.empty(n, np.int64)
        after[ring] = np.roll(ring, -1)
        before = np.empty(n, np.int64)
        before[ring] = np.roll(ring, 1)
        rings += [after, before]
    return np.concatenate([chosen, np.stack(rings, axis=1)], axis=1)


def range_search(units: np.ndarray, near: np.ndarray, queries: np.ndarray, starts: np.ndarray, threshold: float, beam: int):
    """Vectors with a cosine of ``threshold`` or more that each query's search meets: (query, vector, cosine).

    Greedy search of all queries in step: the best ``beam`` of what a query has met are
    expanded, and everything in range is, until nothing is left to expand.
    """
    n = len(units)
    met = np.full((len(queries), n), -2.0)
    open_ = np.zeros((len(queries), n), bool)

    def meet(q: np.ndarray, x: np.ndarray) -> None:
        key = np.unique(q * n + x)
        q, x = key // n, key % n
        fresh = met[q, x] < -1.5
        q, x = q[fresh], x[fresh]
        for s in range(0, len(q), 1 << 15):
            some, other = q[s : s + (1 << 15)], x[s : s + (1 << 15)]
            met[some, other] = np.einsum("pd,pd->p", queries[some], units[other])
        open_[q, x] = True

    given = starts >= 0
    meet(np.repeat(np.arange(len(queries)), starts.shape[1])[given.ravel()], starts[given])
    width = min(beam, n)
    while open_.any():
        best = np.partition(met, n - width, axis=1)[:, n - width]
        q, x = np.nonzero(open_ & (met >= np.minimum(best, threshold)[:, None]))
        if not len(q):
            break
        q, x = q[: 1 << 14], x[: 1 << 14]
        open_[q, x] = False
        to = near[x]
        some = to >= 0
        meet(np.repeat(q, to.shape[1])[some.ravel()], to[some])
    q, x = np.nonzero(met >= threshold)
    return q, x, met[q, x]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of the group of each of ``n`` things linked by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        one, two = least[a], least[b]
        if (one == two).all():
            return least
        low = np.minimum(one, two)
        np.minimum.at(least, one, low)
        np.minimum.at(least, two, low)
        while not (least == least[least]).all():
            least = least[least]
