"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Every benchmark item of ``n`` words belongs to a window size ``m`` a little
below ``n``. Every window of each size in use is looked up in documents, and the
item side keeps the fingerprints of all its windows of that size, so an edited
copy meets its item at the offset at which it differs least. A window whose fingerprint is within ``RADIUS`` bits of an
item's is a candidate: of four 16-bit blocks at least one then differs in at
most one bit, so tables of all block values one bit around the items' blocks
find every such pair.

A candidate is verified on the words it aligns: the share of the item's
distinct five-word shingles found there, each weighing ln(1 + items / items
with it), has to reach ``similarity``. These counts are of the whole benchmark. An item shorter than a shingle is one.

The benchmark is read on the driver in slices of at most ``SLICE_ITEMS`` items
and ``SLICE_BYTES`` of text, each sent to the executors by itself. Documents are read once: each
batch is held against slice after slice, and a worker holds one slice at a time. Only the
benchmark's shingles are shuffled, to count them. Documents are searched in segments of bounded size.

Words: A-Z lower-cased, ASCII punctuation deleted. Cases: null and blank texts
match nothing, as do items without a word; repeated rows and ids are judged as
rows; equal items are all reported; an empty table on either side gives no
match; filtering keeps all columns, and finding reads only id and text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import keep
from lodestone.llm.words import gram_hashes, plain_words, word_hashes

SHINGLE = 5
RADIUS = 7
SLICE_ITEMS = 4096
SLICE_BYTES = 16 << 20
SEGMENT = 12_000

#: Bits of the hash under which the shingles of a slice are noted.
KNOWN = 20


def window_size(n: int) -> int:
    """Window size of an item of ``n`` words: 5, 7, 9, 12, 16, ..., at most 0.8 n."""
    if n < 7:
        return n
    size = 5
    while (wider := round(size * 4 / 3)) <= 0.8 * n:
        size = wider
    return size


def _window_fps(hashes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Fingerprints of all windows of each size: a bit is set if set in over half of the words' hashes.

    Counts of windows of 1, 2, 4, 8, ... words are doubled, and each size is put together of them.
    """
    sizes = [m for m in sizes if m <= len(hashes)]
    if not sizes:
        return {}
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = {m: None for m in sizes}
    power, step = bits if max(sizes) < 256 else bits.astype(np.uint32), 1
    out = {}
    while True:
        for m in sizes:
            if m & step:
                done = m & (step - 1)  # words that the sum already covers
                count = len(hashes) - (done + step) + 1
                sums[m] = power[:count] if sums[m] is None else sums[m][:count] + power[done : done + count]
                if done + step == m:
                    out[m] = np.packbits(sums[m] > m // 2, axis=1, bitorder="little").view(np.uint64).ravel()
        if step * 2 > max(sizes):
            return out
        power, step = power[:-step] + power[step:], step * 2


@dataclass
class Size:
    """The items of one window size."""

    m: int
    fps: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Index:
    ids: list
    lengths: np.ndarray
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    sizes: list[Size]
    reach: int
    known: np.ndarray


def _block(fps: np.ndarray, b: int) -> np.ndarray:
    """A 16-bit block of each fingerprint."""
    return np.ascontiguousarray((fps >> np.uint64(16 * b)).astype(np.uint16))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - KNOWN)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return gram_hashes(hashes, min(SHINGLE, len(hashes)))


def build_index(items: list[tuple[object, bytes | None]], seen: dict[int, int] | None = None, total: int | None = None) -> Index:
    """``seen`` holds in how many of all ``total`` items a shingle is, if in several; without it ``items`` are all."""
    hashed = [(i, word_hashes(w)) for i, t in items if (w := plain_words(t))]
    shingles = [np.unique(_shingles(h)) for _, h in hashed]
    seen = Counter(x for s in shingles for x in s.tolist()) if seen is None else seen
    total = len(hashed) if total is None else total
    weights = [np.log1p(total / np.array([seen.get(x, 1) for x in s.tolist()])) for s in shingles]
    by_size: dict[int, list[int]] = {}
    for k, (_, h) in enumerate(hashed):
        by_size.setdefault(window_size(len(h)), []).append(k)
    sizes = []
    for m, members in sorted(by_size.items()):
        fps, own, at = [], [], []
        for k in members:
            starts = np.arange(len(hashed[k][1]) - m + 1)
            fps.append(_window_fps(hashed[k][1], [m])[m])
            own.append(np.full(len(starts), k))
            at.append(starts)
        fp = np.concatenate(fps)
        tables = []
        for b in range(4):
            block = _block(fp, b).astype(np.int64)
            near = np.concatenate([block] + [block ^ (1 << i) for i in range(16)])
            order = np.argsort(near, kind="stable")
            first = np.searchsorted(near[order], np.arange(65537))
            tables.append((first, np.diff(first) > 0, np.tile(np.arange(len(fp)), 17)[order]))
        sizes.append(Size(m, fp, np.concatenate(own), np.concatenate(at), tables))
    lengths = np.array([len(h) for _, h in hashed], np.int64)
    known = np.zeros(1 << KNOWN, bool)
    for s in shingles:
        known[_slot(s)] = True
    return Index([i for i, _ in hashed], lengths, shingles, weights, sizes, int(lengths.max(initial=0)) * 2 + SHINGLE, known)


def _candidates(index: Index, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct (word index of the aligned start, item, word index of the window) rows; the start may lie before 0."""
    found = []
    windows = _window_fps(hashes, [s.m for s in index.sizes])
    for size in index.sizes:
        if size.m not in windows:
            continue
        fps = windows[size.m]
        for b, (first, there, entries) in enumerate(size.tables):
            block = _block(fps, b)
            hit = np.flatnonzero(there[block])
            if not len(hit):
                continue
            low = first[block[hit]]
            each = first[block[hit].astype(np.int64) + 1] - low
            window = np.repeat(hit, each)
            entry = entries[np.arange(len(window)) + np.repeat(low - np.cumsum(each) + each, each)]
            near = np.bitwise_count(fps[window] ^ size.fps[entry]) <= RADIUS
            window, entry = window[near], entry[near]
            whole = owner[window] == owner[window + size.m - 1]
            window, entry = window[whole], entry[whole]
            found.append(np.stack([window - size.offsets[entry], size.items[entry], window], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def search(index: Index, texts: list[bytes | None], similarity: float) -> list[list[tuple[object, float, int, int]]]:
    """For each text: (item id, similarity, first word, words) of each item in it, at its best place."""
    best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal parts, held
        if parts:
            hashes = np.concatenate([h for _, _, h in parts])
            owner = np.repeat(np.arange(len(parts)), [len(h) for _, _, h in parts])
            base = np.cumsum([0, *(len(h) for _, _, h in parts)])
            done = set()
            grams = gram_hashes(hashes, SHINGLE)
            # How many shingles up to a word may be of an item; a place without any can't hold one.
            seen = np.concatenate([[0], np.cumsum(index.known[_slot(grams)])])
            rows = _candidates(index, hashes, owner)
            own, n = owner[rows[:, 2]], index.lengths[rows[:, 1]]
            slack = n // 10 + 1
            lows, highs = np.maximum(base[own], rows[:, 0] - slack), np.minimum(base[own + 1], rows[:, 0] + n + slack)
            ends = np.clip(highs - SHINGLE + 1, 0, len(grams))
            some = (n < SHINGLE) | (seen[np.maximum(ends, np.minimum(lows, len(grams)))] > seen[np.minimum(lows, len(grams))])
            for (start, item, _), p, n, low, high in zip(rows[some].tolist(), own[some].tolist(), n[some].tolist(), lows[some].tolist(), highs[some].tolist()):
                if (p, start, item) in done:
                    continue
                done.add((p, start, item))
                there = gram_hashes(hashes[low:high], min(SHINGLE, n))
                share = float(index.weights[item][np.isin(index.shingles[item], there)].sum() / index.weights[item].sum())
                t, offset, _ = parts[p]
                if share >= similarity - 1e-12 and share > best[t].get(item, (0.0, 0))[0]:
                    best[t][item] = (share, max(0, start - int(base[p]) + offset))
        parts, held = [], 0

    for t, text in enumerate(texts):
        words = plain_words(text)
        step = SEGMENT + index.reach
        for offset in range(0, max(1, len(words) - index.reach), SEGMENT):
            if part := words[offset : offset + step]:
                parts.append((t, offset, word_hashes(part)))
                held += len(part)
                if held >= SEGMENT:
                    flush()
    flush()
    return [[(index.ids[k], s, at, int(index.lengths[k])) for k, (s, at) in sorted(found.items())] for found in best]


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, h)``: the distinct shingles of each item."""
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words := plain_words(text):
                found = np.unique(_shingles(word_hashes(words))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row, np.int64)), pa.array(found)], ["row", "h"])


def _slices(bench: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    text = F.col(text_col).cast("string").cast("binary")
    items, _ = keep(bench.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("t")), "items")
    shingles, _ = keep(items.select("row", "t").mapInArrow(_item_shingles, "row long, h long"), "item-shingles")
    total = shingles.select("row").distinct().count()
    several = shingles.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    counted = shingles.join(several, "h").groupBy("row").agg(F.collect_list("h").alias("h"), F.collect_list("n").alias("n"))
    held, seen, size = [], {}, 0
    for row in items.join(counted, "row", "left").select("id", "t", "h", "n").toLocalIterator():
        held.append((row["id"], bytes(row["t"]) if row["t"] is not None else None))
        seen.update(zip((h & (1 << 64) - 1 for h in row["h"] or ()), row["n"] or ()))
        size += len(row["t"] or b"")
        if len(held) >= SLICE_ITEMS or size >= SLICE_BYTES:
            yield build_index(held, seen, total)
            held, seen, size = [], {}, 0
    if held:
        yield build_index(held, seen, total)


def _searched(slices: list[Broadcast], texts: list[bytes | None], similarity: float) -> list[list[tuple[object, float, int, int]]]:
    """The hits of each text in all slices; a worker holds one slice at a time."""
    found: list[list] = [[] for _ in texts]
    for sent in slices:
        for hits, more in zip(found, search(sent.value, texts, similarity)):
            hits += more
        if len(slices) > 1:
            vars(sent).pop("_value", None)
    return found


def _sent(bench: DataFrame, id_col: str, text_col: str) -> list[Broadcast]:
    send = bench.sparkSession.sparkContext.broadcast
    return [send(index) for index in _slices(bench, id_col, text_col)]


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``(id, item, similarity, first_word, n_words)`` of every benchmark item in every document."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    item_type = bench.schema[item_col].dataType
    schema = f"id {read.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, similarity double, first_word long, n_words long"
    slices, types = _sent(bench, item_col, item_text), (to_arrow_type(item_type), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _searched(slices, batch.column(1).to_pylist(), similarity)
            rows = [(k, *hit) for k, hits in enumerate(found) for hit in hits]
            if rows:
                taken = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types, 1)]
                yield pa.RecordBatch.from_arrays([taken, *columns], ["id", "item", "similarity", "first_word", "n_words"])

    out = read.mapInArrow(run, schema) if slices else docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "first_word", "n_words")


def drop_leaked(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    at, slices = docs.columns.index(text_col), _sent(bench, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _searched(slices, batch.column(at).cast(pa.binary()).to_pylist(), similarity)
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if slices else docs
