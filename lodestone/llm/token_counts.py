"""Token counts of documents in flat token files, found by their separators.

A token file is a flat run of token ids, documents one after another, each
followed by an end-of-document id; it has no index. It is read in blocks that
are cut anywhere. ``scan`` searches every block for the separator with one
vectorised comparison. A block then is a short row: its tokens, and the places
of its separators. Running sums over the blocks of a file (a prefix scan) give
each block the tokens, documents and last separator before it, and so stitch
the documents that cross block boundaries.

``write_tokens`` makes such files from texts in the shared folder: every task writes its
documents one after another and gives a manifest of their ids in order; a file ends with the
document that reaches ``FILE_BLOCKS`` blocks, so a running sum covers little more than that. A
file is named by the attempt of its task, and only files of the manifest are counted: what a lost
executor left behind, or an attempt that was run again, is not. Tasks write, and read a block at
a time, by Arrow's file systems (``file``, ``hdfs``, ``s3``/``s3a``, ``gs``), as Spark has no writer of flat binary files.

Cases: a null or blank text has no token; tokens after a file's last separator
are a document that is not ``closed``; bytes at its end too few for an id are not read; two separators side by side hold an empty
document; ids may be null or repeat: they are told apart by file and place; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import keep, make_folder, scratch_path

BLOCK_TOKENS = 1 << 18
FILE_BLOCKS = 256
CACHED_PIECES = 200_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of this family of byte-level tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Tokenizer:
    """Byte-level BPE ids of texts; pieces seen before come from a bounded cache."""

    def __init__(self, vocabulary: str | bytes):
        """``vocabulary``: the vocabulary file's path or content."""
        import tiktoken

        content = _content(vocabulary) if isinstance(vocabulary, str) else vocabulary
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, content.splitlines()))}
        self.end = len(ranks)
        self.split = regex.compile(PATTERN).findall
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.split(text):
            found = known.get(piece)
            if found is None:
                if len(known) >= CACHED_PIECES:
                    known.clear()
                found = known[piece] = self.encode(piece)
            out += found
        return out


def id_type(n_ids: int) -> str:
    """Little-endian type of the ids in a file."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> tuple[str, DataFrame, int]:
    """Folder of token files, manifest ``(file, place, id)`` with the files' numbers, and the separator.

    The driver reads the vocabulary (one file of about a megabyte) and sends it to the executors.
    """
    spark, content = docs.sparkSession, _content(vocabulary)
    folder, sent, most = scratch_path(spark, "token-files"), spark.sparkContext.broadcast(content), BLOCK_TOKENS * FILE_BLOCKS
    make_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(sent.value)
        kind = id_type(tokens.end + 1)
        file, place, held, out = TaskContext.get().taskAttemptId() << 24, 0, 0, None
        to, where = _file_system(folder)

        def noted(ids: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.int64()), pa.array(range(place, place + len(ids)), pa.int64()), ids], ["file", "place", "id"])

        try:
            for batch in batches:
                done = 0
                for k, text in enumerate(batch.column(1)):
                    ids = np.array([*tokens.ids(text.as_py() or ""), tokens.end], kind)
                    out = out or to.open_output_stream(f"{where}/{file}.tokens")
                    out.write(ids.tobytes())
                    held += len(ids)
                    if held >= most:
                        out.close()
                        yield noted(batch.column(0).slice(done, k + 1 - done))
                        file, place, held, done, out = file + 1, 0, 0, k + 1, None
                if done < batch.num_rows:
                    yield noted(batch.column(0).slice(done))
                    place += batch.num_rows - done
        finally:
            if out is not None:
                out.close()

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    manifest, _ = keep(read.mapInArrow(run, f"file long, place long, id {read.schema['id'].dataType.simpleString()}"), "manifest")
    return folder, manifest, sum(1 for line in content.splitlines() if line.strip())


def _file_system(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def read_files(spark: SparkSession, path: str, kind: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the flat binary files under ``path``, of any size; ``file`` is the path.

    Spark lists the files and deals them to tasks by size; a task reads a block at a time.
    """
    size = np.dtype(kind).itemsize * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                of, where = _file_system(name)
                with of.open_input_stream(where) as file:
                    k = 0
                    while payload := file.read(size):
                        while len(payload) < size and (more := file.read(size - len(payload))):  # a remote read may be short
                            payload += more
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])
                        k += 1

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "file string, block long, payload binary")


def scan(blocks: DataFrame, ends: tuple[int, ...], kind: str = "<u2") -> DataFrame:
    """``(file, place, n_tokens, closed)`` of every document in ``blocks(file, block, payload)``."""

    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), kind, payload.as_buffer().size // size) if payload.is_valid else np.empty(0, kind)
                n.append(len(ids))
                found.append(np.flatnonzero(ids == ends[0] if len(ends) == 1 else np.isin(ids, ends)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    kept = blocks.select("file", "block", "payload")
    short = kept.mapInArrow(run, f"file {kept.schema['file'].dataType.simpleString()}, block long, n long, ends array<long>")
    short, _ = keep(short, "blocks")
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    placed = short.withColumn("begin", begin)
    last = F.when(F.size("ends") > 0, F.col("begin") + F.element_at("ends", -1))
    stitched = placed.withColumn("last", last).withColumns({"before": F.coalesce(F.max("last").over(ahead), F.lit(-1)), "documents": F.coalesce(F.sum(F.size("ends")).over(ahead), F.lit(0))})
    each = stitched.select("file", "begin", "before", "documents", "ends", F.posexplode("ends").alias("k", "at"))
    previous = F.when(F.col("k") == 0, F.col("before")).otherwise(F.col("begin") + F.get("ends", F.col("k") - 1))
    closed = each.select("file", (F.col("documents") + F.col("k")).alias("place"), (F.col("begin") + F.col("at") - previous - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = stitched.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum(F.size("ends")).alias("place"))
    tail = whole.where("n > coalesce(last, -1) + 1").select("file", "place", F.expr("n - coalesce(last, -1) - 1").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens)`` of every row, by writing token files and scanning them."""
    folder, manifest, end = write_tokens(docs, id_col, text_col, vocabulary)
    kind = id_type(end + 1)
    found = scan(read_files(docs.sparkSession, folder, kind, BLOCK_TOKENS), (end,), kind)
    found = found.withColumn("file", F.regexp_extract("file", r"(\d+)\.tokens$", 1).cast("long"))
    return manifest.join(found, ["file", "place"]).select(F.col("id").alias(id_col), "n_tokens")
