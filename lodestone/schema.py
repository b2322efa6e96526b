"""Tables of the index, and the closed sets of values in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
SYMBOL_KINDS = ("function", "class", "interface", "type", "enum", "variable")

DDL = {
    "files": "file_id LONG, path STRING, hash STRING, mtime LONG, lines INT, indexed_at LONG",
    "symbols": "symbol_id LONG, file_id LONG, name STRING, kind STRING, start_line INT, end_line INT, is_exported BOOLEAN, signature STRING, doc STRING, seq INT",
    "imports": "import_id LONG, file_id LONG, symbol STRING, from_path STRING, is_type_only BOOLEAN, is_external BOOLEAN, seq INT",
    "exports": "export_id LONG, file_id LONG, symbol STRING, kind STRING, is_reexport BOOLEAN, original_path STRING, seq INT",
    "calls": "call_id LONG, caller_symbol_id LONG, callee_name STRING, file_id LONG, line INT, seq INT",
    "refs": "file_id LONG, name STRING",
    "tfidf": "term STRING, file_id LONG, tf DOUBLE",
    "idf": "term STRING, idf DOUBLE",
    "sessions": "session_id LONG, started_at LONG, ended_at LONG, file_snapshot STRING",
    "contents": "file_id LONG, content STRING",
    "grams": "gram STRING, name STRING, kind STRING, file_id LONG",
}
#: What an extractor returns for one file.
EXTRACTED = (
    "STRUCT<symbols: ARRAY<STRUCT<name: STRING, kind: STRING, start_line: INT, end_line: INT, is_exported: BOOLEAN, signature: STRING, doc: STRING>>,"
    " imports: ARRAY<STRUCT<symbol: STRING, from_path: STRING, is_type_only: BOOLEAN>>,"
    " exports: ARRAY<STRUCT<symbol: STRING, kind: STRING, is_reexport: BOOLEAN, from_path: STRING>>,"
    " calls: ARRAY<STRUCT<callee_name: STRING, line: INT, parent_symbol: STRING>>, refs: ARRAY<STRING>>"
)


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


@dataclass
class Index:
    """The tables of one project. Operators take it, or single tables of this shape."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    exports: DataFrame
    calls: DataFrame
    refs: DataFrame
    tfidf: DataFrame
    idf: DataFrame
    sessions: DataFrame
    contents: DataFrame
    grams: DataFrame | None  # none: names are scanned

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(**{t: spark.createDataFrame([], schema(t)) for t in DDL})
