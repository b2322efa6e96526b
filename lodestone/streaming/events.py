"""File events: listing differences, debouncing, coalescing, and a streaming applier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.streaming.keyed import STATE_STORE, bursts


def listing_events(before: DataFrame, after: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """``(path, event)`` between two listings: add, change or unlink. File sources can't see deletes."""
    old, new = before.select(F.col(key).alias("path"), F.col(version).alias("was")), after.select(F.col(key).alias("path"), F.col(version).alias("now"))
    event = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "unlink").when(F.col("was") != F.col("now"), "change")
    return old.join(new, "path", "full_outer").select("path", event.alias("event")).where("event is not null")


def debounced(events: DataFrame, gap: str = "300 milliseconds", ts: str = "ts", by: str | None = "path") -> DataFrame:
    """Bursts of events with gaps below ``gap``: start, end and count, for each path or over all."""
    keys = [by] if by else []
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")


def coalesced(events: DataFrame, path: str = "path", event: str = "event", seq: str = "seq") -> DataFrame:
    """One event a path: the last, but an add that was only changed since stays an add.

    An add after an unlink, or an unlink at the end, stands as it is.
    """
    w = W.partitionBy(path).orderBy(seq)
    opened = F.max(F.when(F.col(event) != "change", F.struct(F.col(seq).alias("s"), F.col(event).alias("e")))).over(w)
    told = F.when((F.col(event) == "change") & (opened["e"] == "add"), "add").otherwise(F.col(event))
    return events.withColumn("told", told).groupBy(path).agg(F.max_by("told", seq).alias(event))


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "300 milliseconds", gap_ms: int | None = None) -> StreamingQuery:
    """Run ``apply(batch of one event a path, batch id)`` over a stream of ``(path, event, ts, seq)``.

    With ``gap_ms`` a path's events are held as keyed state until it was quiet for so long (``keyed.bursts``);
    without, a micro-batch is the debounce window. ``apply`` has to be idempotent for a batch id, as a restarted query repeats
    its last batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply(coalesced(batch), batch_id)

    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:  # a query keeps the settings under which it was started
        for k, v in STATE_STORE.items() if gap_ms is not None else ():
            spark.conf.set(k, v)
        told = events if gap_ms is None else bursts(events, gap_ms)
        return told.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
