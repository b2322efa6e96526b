"""Trailing debounce and coalescing of file events as keyed state.

Every path has one state: the event that its burst amounts to so far. Each event
starts the path's timer again; when ``gap_ms`` pass without one, the timer gives the event and
clears the state. State and timers live in the stream's checkpoint, so an add in one
micro-batch and a change in a later one are one add, also if the query was started again between.

Timers are of processing time: a quiet tree needs no further event to let go of its last burst. A
path is a key by itself, so a busy file holds back no other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keyed state with timers needs of the session that starts the query.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def followed(before: str | None, event: str) -> str:
    """What two events of one path amount to: an add that is only changed stays an add; else the later counts."""
    return "add" if event == "change" and before == "add" else event


class Burst(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "event string, ts timestamp, seq long, n long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        event, n, until = None, 0, None
        if self.pending.exists():
            event, _, _, n, until = self.pending.get()
        for r in sorted(rows, key=lambda r: r["seq"]):
            event, ts, seq, n = followed(event, r["event"]), r["ts"], r["seq"], n + 1
        if until is not None:
            self.handle.deleteTimer(until)
        until = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.pending.update((event, ts, seq, n, until))
        self.handle.registerTimer(until)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        event, ts, seq, n, _ = self.pending.get()
        self.pending.clear()
        yield Row(path=key[0], event=event, ts=ts, seq=seq, n=n)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_ms: int = 300) -> DataFrame:
    """One event for each burst of a path in a stream of ``(path, event, ts, seq)``: with its last time and place, and how many it was.

    The query has to be started under ``STATE_STORE``, as ``events.watch`` does.
    """
    return events.where("path is not null").groupBy("path").transformWithState(Burst(gap_ms), "path string, event string, ts timestamp, seq long, n long", "append", "processingTime")
