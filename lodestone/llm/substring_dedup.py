"""Removal of word windows that an earlier document holds, level by level.

A window is ``window`` consecutive words. Each word covered by a window whose
words also start in a document with a smaller id is removed. Lengths double:
short windows are looked up first, and only where they repeat in another
document are windows of twice the length made, up to the window itself; for 13
words the lengths are 7 and 13. The last level decides exactly. A level of 4 below would have to
look up about 0.4 rows a word to spare four in five of the 0.25 rows a word of the level of 7.

The first level needs no row for every word. Of the short windows inside each
longer one only that with the least hash is looked up (the leftmost of equals),
which depends on those words alone, so two equal longer windows look up the
same one: if it is in no other document, neither is the longer window.

Rows between levels are (hash, id), one for each distinct hash of a document,
so a key has at most one row per document. Texts travel compressed, joined by id with the hashes that survive in
them, so a document's list is never longer than the document.

Cases: ids are whole numbers; null and blank texts have no words; texts shorter than a window lose
nothing; a null id takes no part: its text stays whole and removes nothing from
others; rows with equal ids do not remove from each other; repeated rows are
kept as rows; an empty table gives an empty result; extra columns are not read.
Windows at the last level are compared by 128 bits of hash, earlier ones by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop, keep
from lodestone.llm.words import gram_hashes, word_hashes

SECOND = 0xD6E8FEB86659FD93


def levels(window: int) -> list[int]:
    """Lengths that double up to ``window``, none under 5 but for short windows: 7, 13 for 13."""
    out = [window]
    while out[0] >= 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchors(hashes: np.ndarray, short: int, window: int) -> np.ndarray:
    """Starts of the short windows that stand for some full window."""
    grams = gram_hashes(hashes, short)
    span = window - short + 1
    if len(grams) < span:
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(seen.argmin(axis=1) + np.arange(len(seen)))


def _cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Words covered by runs of ``length`` from each start."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n), -1)
    return np.cumsum(edges[:-1]) > 0


def first_level(text: bytes | None, short: int, longer: int) -> np.ndarray:
    """Distinct hashes to look up for a text."""
    words = (text or b"").split()
    if len(words) < longer:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(gram_hashes(hashes, short)[_anchors(hashes, short, longer)])


def candidate_windows(hashes: np.ndarray, survivors: np.ndarray, short: int, window: int) -> np.ndarray:
    """Starts of the full windows whose own short window survives."""
    grams = gram_hashes(hashes, short)
    span = window - short + 1
    if len(grams) < span or not len(survivors):
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, span)
    own = seen.argmin(axis=1) + np.arange(len(seen))
    return np.flatnonzero(np.isin(grams[own], survivors))


def _next_level(short: int, longer: int):
    """Rows (id, h, g): both hashes of the windows of twice the length around surviving ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, packed, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes = word_hashes(open_(packed).split())
                survivors = found.values.to_numpy(zero_copy_only=False).view(np.uint64)
                starts = candidate_windows(hashes, survivors, short, longer)
                if len(starts):
                    full = np.unique(np.stack([gram_hashes(hashes, longer)[starts], gram_hashes(hashes, longer, SECOND)[starts]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i, np.int64)), pa.array(full[:, 0].copy().view(np.int64)), pa.array(full[:, 1].copy().view(np.int64))], ["id", "h", "g"])

    return run


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [close(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, "id long, packed binary")


def _repeated(rows: DataFrame, key: list[str], earlier: bool) -> DataFrame:
    """``(id, found)``: the hashes ``h`` of each id that another row has too, or a smaller id.

    The least id of a key is found by partial aggregation, and joined to its rows where a
    key that very many documents hold can be split.
    """
    rows, path = keep(rows, "window-rows")
    ends, _ = keep(rows.groupBy(*key).agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "window-ends")
    hit = rows.join(ends.hint("merge"), key)
    found, _ = keep((hit.where("id > low") if earlier else hit).groupBy("id").agg(F.collect_list("h").alias("found")), "windows")
    drop(rows.sparkSession, path)
    return found


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``(id, found)``: hashes of the windows of each document that an earlier one holds."""
    steps = levels(window)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_level(t, steps[0], steps[min(1, len(steps) - 1)]) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            if len(ids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], ["id", "h"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    rows, key = read.mapInArrow(look_up, "id long, h long"), ["h"]
    for short, longer in zip(steps, steps[1:]):
        survivors = _repeated(rows, key, earlier=False)
        around = _packed(docs, id_col, text_col).join(survivors, "id").select("id", "packed", "found")
        rows, key = around.mapInArrow(_next_level(short, longer), "id long, h long, g long"), ["h", "g"]
    return _repeated(rows, key, earlier=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``.

    Kept words are joined by one space.
    """
    found = repeated_windows(docs, id_col, text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for packed, gone in zip(batch.column(1).to_pylist(), batch.column(2)):
                words, left = open_(packed).split(), None
                if gone.is_valid:
                    full = gram_hashes(word_hashes(words), window)
                    starts = np.flatnonzero(np.isin(full, gone.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                    left = [words[i] for i in np.flatnonzero(~_cover(starts, window, len(words)))]
                text = b" ".join(words if left is None else left)
                out.append((len(words), 0 if left is None else len(words) - len(left), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            n, m, s, t = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.string()), pa.array(t, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = _packed(docs, id_col, text_col).join(found, "id", "left").select("id", "packed", "found")
    done = joined.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
    return done if with_text else done.drop("kept_text")
