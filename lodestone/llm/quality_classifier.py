"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded,
from its bytes and words alone, as rates of byte classes, of pairs of byte
classes and of hashed words, with a few ratios. A small network embeds the
passages, gated attention (a tanh unit times a sigmoid unit) weighs them, and
the weighted sum is scored; all parts are learned together from the labels of
whole documents.

Learning uses a sample: up to ``per_class`` labelled documents of each class, in
the order of a hash, weighted so that the classes count as they do among all
labels. That bounds what the driver holds. Every document is scored whole.

Cases: a null or blank text is one empty passage and gets a score; ids without a
document, labels other than 0 and 1 and null ids teach nothing; repeated rows are
scored as rows; with no labels, or one class only, every score is the share of
label 1 (0.5 with none); an empty table gives an empty result; columns other
than id and text never reach the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 128
PAIRS = 256
WORDS = 256
BATCH_BYTES = 4 << 20
#: Byte classes: controls, each printable sign, digits, capitals, small letters, the rest.
CLASS = np.full(256, 1, np.int64)
_k = 2
for _b in range(33, 127):
    if not chr(_b).isalnum():
        CLASS[_b] = _k
        _k += 1
CLASS[ord(" ")], CLASS[ord("\n")] = _k, _k + 1
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = _k + 2, _k + 3, _k + 4, _k + 5
CLASSES = _k + 6
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SALT = np.random.default_rng(20).integers(1, 1 << 62, (32, 256), dtype=np.uint64)
WIDTH = CLASSES + PAIRS + WORDS + 5


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features, and the number of passages of each text (1 at least)."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    size = np.array([len(t or b"") + 1 for t in texts])
    text_of_byte = np.repeat(np.arange(len(texts)), size)
    solid = ~SPACE[data]
    start = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    own = text_of_byte[start]
    n_words = np.bincount(own, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    bags = np.maximum(1, -(-n_words // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    bag_of_word = first_bag[own] + (np.arange(len(start)) - first_word[own]) // PASSAGE
    # A byte belongs to the passage of the last word begun in its text, else to the first passage.
    begins = np.zeros(len(data), np.int64)
    begins[start] = 1
    word_of_byte = np.cumsum(begins) - 1
    inside = (word_of_byte >= 0) & (own[np.maximum(word_of_byte, 0)] == text_of_byte) if len(start) else np.zeros(len(data), bool)
    bag_of_byte = np.where(inside, bag_of_word[np.maximum(word_of_byte, 0)] if len(start) else 0, first_bag[text_of_byte])
    total = int(bags.sum())
    out = np.zeros((total, WIDTH), np.float32)
    kind = CLASS[data]
    length = np.maximum(np.bincount(bag_of_byte, minlength=total), 1).astype(np.float32)[:, None]
    out[:, :CLASSES] = np.bincount(bag_of_byte * CLASSES + kind, minlength=total * CLASSES).reshape(total, -1) / length
    before = np.concatenate((CLASS[[32]], kind[:-1]))  # a space is before every text, the first too, so a score is the same in any batch
    pair = (before * 61 + kind * 7) % PAIRS
    out[:, CLASSES : CLASSES + PAIRS] = np.bincount(bag_of_byte * PAIRS + pair, minlength=total * PAIRS).reshape(total, -1) / length
    if len(start):
        place = np.arange(len(data)) - start[np.maximum(word_of_byte, 0)]
        salted = np.where(solid, _SALT[np.minimum(place, 31) & 31, LOWER[data]], np.uint64(0))
        hashed = np.add.reduceat(salted, start)
        words = np.maximum(np.bincount(bag_of_word, minlength=total), 1).astype(np.float32)
        bucket = (hashed >> np.uint64(17)).astype(np.int64) % WORDS
        out[:, CLASSES + PAIRS : CLASSES + PAIRS + WORDS] = np.sqrt(np.bincount(bag_of_word * WORDS + bucket, minlength=total * WORDS).reshape(total, -1) / words[:, None])
        order = np.lexsort((hashed, bag_of_word))
        h, b = hashed[order], bag_of_word[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
        out[:, -5] = np.bincount(b[new], minlength=total) / words
        order = np.lexsort((hashed, own))
        h, b = hashed[order], own[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))
        distinct = np.bincount(b[new], minlength=len(texts)) / np.maximum(n_words, 1)
        out[:, -4] = np.repeat(distinct, bags)
        out[:, -3] = np.bincount(bag_of_byte[solid], minlength=total) / words / 8
        out[:, -2] = np.log1p(words) / 5
        out[:, -1] = np.repeat(np.log1p(n_words) / 10, bags)
    else:
        out[:, -2] = np.log1p(1) / 5  # as a text without words has it among others
    return out, bags


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, first, bag)
    ds = (f["p"] - y) * weight / weight.sum()
    dz = (ds[:, None] * w["c"])[bag]
    da = (f["h"] * dz).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
    dg = de[:, None] * w["w"]
    dt, du = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dz + dt @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, class_weight: np.ndarray, prior: float, *, hidden: int = 48, gate: int = 24, epochs: int = 25, size: int = 64, rate: float = 2e-3, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam on small batches of documents; the seed fixes the result."""
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    shape = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
    w = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) if len(s) > 1 or k in "wc" else np.zeros(s, np.float32) for k, s in shape.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    scaled = [np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in bags]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), size):
            part = order[i : i + size]
            counts = np.array([len(scaled[k]) for k in part])
            first, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(part)), counts)
            y = labels[part].astype(np.float32)
            g = _gradient(w, np.concatenate([scaled[k] for k in part]), first, bag, y, class_weight[labels[part]].astype(np.float32))
            step += 1
            for k in w:
                grad = g[k] + (decay * w[k] if w[k].ndim > 1 else 0)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(prior, mean, scale, w)


def score(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Score of each text; work is done on a few megabytes of text at a time."""
    if model.weights is None:
        return np.full(len(texts), model.prior)
    out, part, held = [], [], 0
    for k, text in enumerate(texts):
        part.append(text)
        held += len(text or b"")
        if held >= BATCH_BYTES or k == len(texts) - 1:
            x, bags = encode(part)
            first, bag = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
            out.append(_forward(model.weights, np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float32), first, bag)["p"].ravel())
            part, held = [], 0
    return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, per_doc: int = 64) -> Model:
    """A model from the labels where ``learn`` (over the columns of ``labels``) holds.

    It is fitted on up to ``per_class`` labelled documents of each class and up to ``per_doc``
    passages of each, evenly spread over its text; of rows with one id on one text, the least.
    """
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Model(0.5)
    prior = counts.get(1, 0) / sum(counts.values())
    parts = [known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = []
            for t in batch.column(2).to_pylist():
                x = encode([t])[0].astype(np.float32)
                coded.append(x[np.unique(np.linspace(0, len(x) - 1, min(len(x), per_doc)).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], ["id", "y", "x"])

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    joined = text.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # 2 * per_class ids at most
    rows = joined.mapInArrow(run, f"id {text.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], np.int64)
    taken = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
    weight = np.array([counts.get(c, 0) / max(1, taken[c]) for c in (0, 1)], np.float32)
    return fit([np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, WIDTH) for r in rows], y, weight / max(weight.max(), 1e-9), prior)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(sent.value, batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
