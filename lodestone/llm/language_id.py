"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed against it greedily: the longest stretch that occurs in the labelled
text is one phrase, then the next begins. Text of the same language needs few
phrases; the language with the fewest per character wins.

The labelled text is a sample of bounded size: of each language, documents in
the order of a hash, ``piece`` characters from a hashed place of each, until
``chars`` characters (less if there are many languages: ``all_chars`` over all).
The automata are the only thing sent to the executors, so their size has a
bound that does not grow with the corpus. Every text is scored whole.

Texts are lower-cased, every run of non-letters is one separator. Blocks of
``BLOCK`` characters step through the transition table together, one character
at a time, and are then stitched so that phrases run on across them: counts
are those of one parse of the whole text, whatever the block size.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go to
the first language in code-point order; rows without id or language teach
nothing; repeated rows are scored as rows; without any labelled row all texts
are ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 512
LANES = 4096
SHARPNESS = 40.0
MOST_LANGUAGES = 1000


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # of every code point: 0 unknown letter, 1 no letter, else a letter's number
    local: list[np.ndarray]  # by language: a letter's column in its table, 0 if not seen there
    tables: list[np.ndarray]  # by language: states x columns, the next state or -1


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is its start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and ch not in moves[p]:
            moves[p][ch] = new
            p = link[p]
        if p != -1:
            q = moves[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(ch) == q:
                    moves[p][ch] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def _letters_only(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def build_model(labelled: dict[str, str]) -> Model:
    """A model from the labelled text of each language."""
    languages = sorted(labelled)
    plain = [_letters_only(labelled[k]) for k in languages]
    letters = sorted({c for t in plain for c in t} - {" "})
    codes = np.array([not chr(i).isalpha() for i in range(0x110000)], np.uint16)
    for k, c in enumerate(letters):
        codes[ord(c)] = k + 2
    local, tables = [], []
    for text in plain:
        moves = suffix_automaton(text)
        own = sorted({c for m in moves for c in m})
        column = {c: k + 1 for k, c in enumerate(own)}
        table = np.full((len(moves), len(own) + 1), -1, np.int32)
        for state, m in enumerate(moves):
            for c, to in m.items():
                table[state, column[c]] = to
        here = np.zeros(len(letters) + 2, np.int64)
        for c, k in column.items():
            here[1 if c == " " else int(codes[ord(c)])] = k
        local.append(here)
        tables.append(table)
    return Model(languages, codes, local, tables)


def _step(table: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state of each lane, and whether a phrase begins with its symbol ``c``."""
    to = table[state, c]
    miss = to < 0
    return np.where(miss, np.maximum(table[0, c], 0), to), miss | (state == 0)


def _phrases(table: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases begun in each block and its last state, from first states ``state``.

    ``symbols`` has a row per step, blocks in order of falling length.
    """
    width = table.shape[1]
    flat, start = table.ravel(), np.maximum(table[0], 0)
    state = state.astype(np.int64)
    count = np.zeros(len(lengths), np.int64)
    active = np.searchsorted(-lengths, -np.arange(len(symbols)), side="left")
    for t, k in enumerate(active):
        c = symbols[t, :k]
        to = flat[state[:k] * width + c]
        miss = to < 0
        count[:k] += miss | (state[:k] == 0)  # here a phrase begins
        state[:k] = np.where(miss, start[c], to)
    return count, state


def _walk(table: np.ndarray, symbols: np.ndarray, state: int) -> tuple[int, int]:
    """Phrases begun in one block and its last state."""
    count = 0
    for c in symbols.tolist():
        to = int(table[state, c])
        count += to < 0 or state == 0
        state = to if to >= 0 else max(int(table[0, c]), 0)
    return count, state


def _parse(table: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, place: np.ndarray, follows: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """Phrases of each block as parts of whole texts, and the last block's last state.

    ``place`` is a block's lane in ``symbols``, ``follows`` marks those that go on
    with the text of the block before, ``carried`` is the first block's first state.
    All blocks are parsed from a phrase's start. Then those that follow are parsed
    from the state really left to them too, until both parses are in one state:
    from there on they agree. The few whose parses never meet leave another state
    to the next block, which is walked again, and so on until the states agree.
    """
    first = np.zeros(len(place), np.int64)
    first[place[0]] = carried
    count, guess = (x[place] for x in _phrases(table, symbols, lengths, first))
    size = lengths[place]
    left = guess.copy()
    live = 1 + np.flatnonzero(follows[1:] & (guess[:-1] != 0))
    real, tried = guess[live - 1], np.zeros(len(live), np.int64)
    apart: list[int] = []
    for t in range(len(symbols) + 1):
        over = size[live] <= t
        if over.any():
            left[live[over]] = real[over]
            apart += live[over].tolist()
            live, real, tried = live[~over], real[~over], tried[~over]
        if not len(live):
            break
        c = symbols[t, place[live]]
        real, begins = _step(table, real, c)
        tried, began = _step(table, tried, c)
        count[live] += begins.astype(np.int64) - began
        on = real != tried
        live, real, tried = live[on], real[on], tried[on]
    settled = -1
    for b in sorted(apart):
        if b <= settled:
            continue
        settled = b
        while settled + 1 < len(place) and follows[settled + 1] and left[settled] != guess[settled]:
            settled += 1
            count[settled], left[settled] = _walk(table, symbols[: size[settled], place[settled]], int(left[settled - 1]))
    return count, int(left[-1])


def phrase_counts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language, and the characters of each text (0: no letter)."""
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    blocks: list[np.ndarray] = []
    owners: list[int] = []
    follows: list[bool] = []
    carried = [0] * len(model.languages)

    def flush() -> None:
        if not blocks:
            return
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        place = np.argsort(order, kind="stable")
        grid = np.zeros((int(lengths.max()), len(blocks)), np.uint16)
        for lane, k in enumerate(order):
            grid[: lengths[k], lane] = blocks[k]
        for lang, (local, table) in enumerate(zip(model.local, model.tables)):
            state = carried[lang] if follows[0] else 0
            found, carried[lang] = _parse(table, local[grid], lengths[order], place, np.array(follows), state)
            np.add.at(counts[:, lang], np.array(owners), found)
        blocks.clear()
        owners.clear()
        follows.clear()

    for t, text in enumerate(texts):
        code = model.codes[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)]
        gap = code == 1
        code = code[~(gap & np.concatenate(([True], gap[:-1])))]
        if (code != 1).any():
            sizes[t] = len(code)
            for i in range(0, len(code), BLOCK):
                blocks.append(code[i : i + BLOCK])
                owners.append(t)
                follows.append(i > 0)
                if len(blocks) >= LANES:
                    flush()
    flush()
    return counts, sizes


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, chars: int = 30_000, all_chars: int = 3_000_000, piece: int = 300) -> Model:
    """A model from the rows of ``docs`` where ``learn`` holds."""
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), mark.alias("mark"))
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return build_model({})
    chars = min(chars, all_chars // len(sizes))
    need = -(-2 * chars // piece)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 4 * need / r["count"]))])
    some = rows.where(F.pmod("mark", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    at = F.pmod(F.xxhash64("mark"), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1
    taken = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("mark", "text"))).where(F.col("r") <= need)
    pieces = taken.select("lang", "r", F.col("text").substr(at.cast("int"), F.lit(piece)).alias("part")).collect()
    labelled: dict[str, str] = {}
    for r in sorted(pieces, key=lambda r: (r["lang"], r["r"])):
        if len(labelled.setdefault(r["lang"], "")) < chars:
            labelled[r["lang"]] += " " + r["part"]
    return build_model({k: v[:chars] for k, v in labelled.items() if any(c.isalpha() for c in v[:chars])})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            counts, sizes = phrase_counts(m, batch.column(1).to_pylist())
            if m.languages:
                rate = counts / np.maximum(sizes, 1)[:, None]
                best = rate.argmin(axis=1)
                score = 1 / np.exp(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True))).sum(axis=1)
            else:
                best, score, sizes = np.zeros(len(sizes), int), np.zeros(len(sizes)), np.zeros(len(sizes))
            names = [m.languages[b] if n else "und" for b, n in zip(best, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(sizes > 0, score, 0.0))], ["id", "lang_pred", "score"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
