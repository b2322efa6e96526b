"""License scan: MinHash bands over overlapping windows, then exact containment.

A template of ``n`` words has windows of a size ``m`` a little below ``n`` (all
of it, if it is short). Texts are cut into overlapping windows of each size in
use, at a stride short enough that any stretch of ``n`` words holds a whole
window; the template side keeps the signatures of all its windows, so a copy
meets its template at the same offset. A signature is the least values of
``BANDS * ROWS`` hash functions over the window's shingles. Windows that agree
in a whole band retrieve the template: with 12 bands of 2 rows two windows of
similarity 0.8 meet with probability 1 - (1 - 0.64)^12 > 0.99999. Signatures are made
only of windows that hold a shingle of some template: others can agree in no band.

Retrieved templates are verified on the words themselves: the share of the
template's distinct shingles (five words) found in the stretch has to reach
``containment``.

Templates are a parameter, held in the driver's memory and sent to every task;
``MOST_WORDS`` bounds them. Nothing is shuffled. Words are lower-cased (A-Z)
with ASCII punctuation deleted.

Cases: null and blank texts match nothing; a template shorter than a shingle is
one shingle; templates without words are skipped; equal templates are all
reported; repeated rows are judged as rows; long texts are read whole, in parts;
an empty table gives an empty result; columns other than id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.license_templates import general_templates
from lodestone.llm.words import gram_hashes, mix, plain_words, segments, word_hashes

SHINGLE = 5
BANDS, ROWS = 12, 2
SEGMENT = 40_000
MOST_WORDS = 2_000_000

#: Bits of the hash under which the templates' shingles are noted.
KNOWN = 20

# Public license notices, as projects state them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: What is scanned for by default.
ALL_TEMPLATES = TEMPLATES | general_templates()


def window_size(n: int) -> int:
    """Window size of a template of ``n`` words: itself up to 15, else 12, 18, 27, ..., at most 0.8 n."""
    if n <= 15:
        return n
    size = 12
    while size * 3 // 2 <= 0.8 * n:
        size = size * 3 // 2
    return size


_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Keys of all bands (rows) of the windows of ``width`` shingles that start at ``at``."""
    windows = np.lib.stride_tricks.sliding_window_view(shingles, width)[at]
    keys = np.empty((BANDS, len(at)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b, np.uint64)
        for r in range(ROWS):
            least = mix(windows ^ _SEEDS[b * ROWS + r]).min(axis=1)
            key = mix(key ^ least) if r else key ^ least
        keys[b] = key
    return keys


@dataclass
class Size:
    m: int
    shingle: int
    stride: int
    keys: list[np.ndarray]  # by band, sorted
    templates: list[np.ndarray]
    offsets: list[np.ndarray]
    quick: list[np.ndarray]  # by band, whether any key has these top 16 bits


@dataclass
class Index:
    names: list[str]
    lengths: list[int]
    shingles: list[set]
    sizes: list[Size]
    reach: int
    known: dict[int, tuple[np.ndarray, np.ndarray]]  # by shingle length, the templates' shingles, and a table of their top bits


def _word_shingles(words: list[bytes], k: int) -> set:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def build_index(templates: dict[str, str]) -> Index:
    made = [(name, w) for name, text in sorted(templates.items()) if (w := plain_words(text.encode()))]
    if sum(len(w) for _, w in made) > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} words")
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, (_, w) in enumerate(made):
        by_size.setdefault((window_size(len(w)), min(SHINGLE, len(w))), []).append(k)
    sizes = []
    for (m, s), members in sorted(by_size.items()):
        keys, own, at = [], [], []
        for k in members:
            starts = np.arange(len(made[k][1]) - m + 1)
            keys.append(band_keys(gram_hashes(word_hashes(made[k][1]), s), m - s + 1, starts))
            own.append(np.full(len(starts), k))
            at.append(starts)
        every, own, at = np.concatenate(keys, axis=1), np.concatenate(own), np.concatenate(at)
        orders = [np.argsort(x, kind="stable") for x in every]
        quick = []
        for x in every:
            seen = np.zeros(1 << 16, bool)
            seen[(x >> np.uint64(48)).astype(np.int64)] = True
            quick.append(seen)
        stride = min(len(made[k][1]) for k in members) - m + 1
        sizes.append(Size(m, s, stride, [x[o] for x, o in zip(every, orders)], [own[o] for o in orders], [at[o] for o in orders], quick))
    known = {}
    for s in {min(SHINGLE, len(w)) for _, w in made}:
        held = np.unique(np.concatenate([gram_hashes(word_hashes(w), s) for _, w in made if min(SHINGLE, len(w)) == s]))
        top = np.zeros(1 << KNOWN, bool)
        top[held >> np.uint64(64 - KNOWN)] = True
        known[s] = held, top
    return Index([n for n, _ in made], [len(w) for _, w in made], [_word_shingles(w, min(SHINGLE, len(w))) for _, w in made], sizes, 2 * max([len(w) for _, w in made], default=0) + SHINGLE, known)


def _seen(index: Index, shingles: np.ndarray, s: int) -> np.ndarray:
    """How many shingles before each place are of a template."""
    held, top = index.known[s]
    maybe = np.flatnonzero(top[shingles >> np.uint64(64 - KNOWN)])
    at = np.searchsorted(held, shingles[maybe])
    there = np.zeros(len(shingles) + 1, np.int64)
    there[maybe[held[np.minimum(at, len(held) - 1)] == shingles[maybe]] + 1] = 1
    return np.cumsum(there)


def _retrieved(index: Index, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> set[tuple[int, int, int]]:
    """(part, aligned start, template) of windows that share a band with a template."""
    out, grams = set(), {}
    for size in index.sizes:
        if len(hashes) < size.m:
            continue
        if size.shingle not in grams:
            shingles = gram_hashes(hashes, size.shingle)
            grams[size.shingle] = shingles, _seen(index, shingles, size.shingle)
        (shingles, seen), width = grams[size.shingle], size.m - size.shingle + 1
        # Windows agree in a band only if they share the shingles of least value.
        at = np.flatnonzero(seen[width:] > seen[:-width])
        at = at[(place[at] % size.stride == 0) & (owner[at] == owner[at + size.m - 1])]
        if not len(at):
            continue
        for b, keys in enumerate(band_keys(shingles, width, at)):
            maybe = np.flatnonzero(size.quick[b][(keys >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(size.keys[b], keys[maybe], side="left")
            high = np.searchsorted(size.keys[b], keys[maybe], side="right")
            for w, i, j in zip(maybe[low < high], low[low < high], high[low < high]):
                for e in range(i, j):
                    out.add((int(owner[at[w]]), int(at[w] - size.offsets[b][e]), int(size.templates[b][e])))
    return out


def search(index: Index, texts: list[bytes | None], containment: float) -> list[list[tuple[str, float, int, int]]]:
    """For each text: (template, containment, first word, words) at its best place."""
    best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
    for parts in segments(texts, plain_words, SEGMENT, index.reach):
        base = np.cumsum([0, *(len(p[2]) for p in parts)])
        owner = np.repeat(np.arange(len(parts)), np.diff(base))
        place = np.concatenate([np.arange(p[1], p[1] + len(p[2])) for p in parts])
        for k, start, template in sorted(_retrieved(index, np.concatenate([p[3] for p in parts]), owner, place)):
            t, offset, words, _ = parts[k]
            n = index.lengths[template]
            slack, at = n // 10 + 1, start - int(base[k])
            there = _word_shingles(words[max(0, at - slack) : max(0, at + n + slack)], min(SHINGLE, n))
            share = len(index.shingles[template] & there) / len(index.shingles[template])
            if share >= containment - 1e-12 and share > best[t].get(template, (0.0, 0))[0]:
                best[t][template] = (share, max(0, at) + offset)
    return [[(index.names[k], s, at, index.lengths[k]) for k, (s, at) in sorted(found.items())] for found in best]


def find_licenses(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8) -> DataFrame:
    """``(id, license, containment, first_word, n_words)`` of every template in every document."""
    sent = docs.sparkSession.sparkContext.broadcast(build_index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *hit) for k, hits in enumerate(search(sent.value, batch.column(1).to_pylist(), containment)) for hit in hits]
            if rows:
                k, name, share, at, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(name), pa.array(share, pa.float64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["id", "license", "containment", "first_word", "n_words"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = f"id {read.schema['id'].dataType.simpleString()}, license string, containment double, first_word long, n_words long"
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)
