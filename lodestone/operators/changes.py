"""Session snapshots and the differences between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT = "map<string, struct<hash: string, symbols: array<string>>>"


def current_state(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(path, hash, symbols)``: each file with its exported names in order; none is an empty list."""
    own = symbols.where("is_exported").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("symbols"))
    return files.join(own, "file_id", "left").select("path", "hash", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def snapshot_json(state: DataFrame) -> DataFrame:
    """One row ``file_snapshot``: JSON of ``{path: {hash, symbols}}``. A project's state is one value by contract."""
    entries = F.array_sort(F.collect_list(F.struct("path", F.struct("hash", "symbols").alias("v"))))
    return state.agg(F.to_json(F.map_from_entries(entries)).alias("file_snapshot"))


def snapshot_rows(snapshots: DataFrame, column: str = "file_snapshot") -> DataFrame:
    """``(path, hash, symbols)`` of stored snapshots; an older form holds the bare hash, and null symbols.

    Raises on read (``raise_error``) if the text is not a JSON object.
    """
    v = F.try_parse_json(column)
    good = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.raise_error(F.lit("corrupted snapshot"))).otherwise(v)
    whole = snapshots.select(good.alias("v"))
    rows = whole.select(F.from_json(F.to_json(F.col("v")), "map<string, variant>").alias("m")).select(F.explode("m").alias("path", "x"))
    text = F.try_variant_get("x", "$", "string")
    is_object = F.schema_of_variant("x").startswith("OBJECT")
    return rows.select("path", F.when(is_object, F.try_variant_get("x", "$.hash", "string")).otherwise(text).alias("hash"), F.when(is_object, F.try_variant_get("x", "$.symbols", "array<string>")).alias("symbols"))


def _without(a: Column, b: Column) -> Column:
    """``a`` less what ``b`` holds; repeats in ``a`` stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(path, change, added, removed)``: files added, modified or deleted since ``before``.

    Of a modified file, exported names added and removed; where the snapshot
    has no names, all names count as added.
    """
    none = F.array().cast("array<string>")
    old = before.select("path", F.col("hash").alias("old_hash"), F.coalesce("symbols", none).alias("old_symbols"))
    both = now.select("path", F.col("hash").alias("new_hash"), F.coalesce("symbols", none).alias("new_symbols")).join(old, "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") != F.col("old_hash"), "modified")
    modified = F.col("change") == "modified"
    return (
        both.withColumn("change", change)
        .where("change is not null")
        .select("path", "change", F.when(modified, _without(F.col("new_symbols"), F.col("old_symbols"))).otherwise(none).alias("added"), F.when(modified, _without(F.col("old_symbols"), F.col("new_symbols"))).otherwise(none).alias("removed"))
        .orderBy("path")
    )


def iso_time(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC; ``unknown`` for null."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18, 6)"))
    return F.coalesce(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), F.lit("unknown"))


def last_snapshot(sessions: DataFrame) -> DataFrame:
    """The newest session that was closed with a snapshot; an open one doesn't hide it."""
    return sessions.where("file_snapshot is not null").orderBy(F.desc("session_id")).limit(1)


def changes_since_last_session(index) -> DataFrame | None:
    """Changes since the last closed session, or None if there is none."""
    last = last_snapshot(index.sessions).persist()
    if last.isEmpty():
        return None
    return changes(current_state(index.files, index.symbols), snapshot_rows(last))
