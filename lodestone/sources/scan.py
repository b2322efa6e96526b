"""Which files of a tree are indexed, and their contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_source, language, matches_any_glob
from lodestone.sources.config import Config


def selected(files: DataFrame, config: Config) -> DataFrame:
    """Source files that the configuration includes."""
    path = F.col("path")
    inside = F.lit(True) if not config.include else F.lit(False)
    for prefix in config.include:
        inside = inside | path.startswith(prefix)
    return files.where(is_source(path) & inside & language(path).isin(config.languages) & ~matches_any_glob(path, config.exclude))


def contents(root: str, paths: DataFrame) -> DataFrame:
    """``(path, content)`` of the listed paths, read where the tasks run; bytes that are no UTF-8 become U+FFFD.

    A file that is gone meanwhile has no row.
    """
    base, batch = os.path.abspath(root), 1 << 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            try:
                with open(os.path.join(base, name), "rb") as file:
                    texts.append(file.read())
            except OSError:
                continue
            names.append(name)
            size += len(texts[-1])
            if size > batch:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
                names, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])

    read = paths.select("path").repartition("path").mapInArrow(run, "path string, content binary")
    return read.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("content"))
