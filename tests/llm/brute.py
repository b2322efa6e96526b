"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    if not w:
        return 0
    hashes = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    """Smallest member of the connected group of each node; ``linked(i, j)`` on positions."""
    group = list(range(len(nodes)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j):
                group[root(i)] = root(j)
    low = {}
    for i, n in enumerate(nodes):
        r = root(i)
        low[r] = min(low.get(r, n), n)
    return [low[root(i)] for i in range(len(nodes))]


def components(rows):
    """{doc_id: (hex fingerprint, component)} for unique ids."""
    fps = [fingerprint(t) for _, t in rows]
    low = closure([i for i, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    return {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, low)}


def substring(rows, n=13):
    """{doc_id: (n_words, n_removed, sha256)}."""
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    out, left, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > cap[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s], left = float(cap[s]), left - cap[s]
        open_ = [s for s in open_ if s not in over]
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if seen[g] > 1 for o in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def edit_similarity(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, row = row, np.empty_like(row)
        row[0] = i
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def similar_lines(a, b, similarity=0.8):
    """Whether normalised lines are similar by words or, up to 128 characters, by characters, and their numbers don't differ."""
    numbers = [re.findall(r"[^\W\d_]*(\d+)", x) for x in (a, b)]
    if all(numbers) and numbers[0] != numbers[1]:
        return False
    short = max(len(a), len(b)) <= 128 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-9
    return edit_similarity(a.split(), b.split()) >= similarity - 1e-9 or (short and edit_similarity(a, b) >= similarity - 1e-9)
