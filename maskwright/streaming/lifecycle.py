"""The life of sessions over a stream of events: state, time-out while processing, expiry after a day without news.

Each session holds one settled event (the last one that the watermark has passed,
and since when it is processing) and the events that are still younger than the
watermark, so late, repeated and out-of-order events give the state and the
time-outs that a batch over all events gives. Two timers in event time stand for
a session: the end of its time for processing, and its expiry, which also drops its
state. Events behind the watermark are late for good and are dropped by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

CHANGES = "session_id string, change string, status string, error_message string, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_text, _long = (lambda name: StructField(name, StringType(), True)), (lambda name: StructField(name, LongType(), True))
_EVENT = StructType([_long("at"), _text("status"), _text("error_message")])
_SETTLED = StructType([_long("at"), _text("status"), _text("error_message"), _long("since")])


def fold(settled: tuple | None, events: list[tuple]) -> tuple | None:
    """(at, status, error_message, since) behind events (at, status, error_message) in order; since: when processing began."""
    for at, status, message in events:
        begun = settled[3] if settled and settled[1] == status == "processing" else at
        settled = (at, status, message, begun)
    return settled


class Lifecycle(StatefulProcessor):
    def __init__(self, limit_ms: int, expiry_ms: int):
        self.limit, self.expiry = limit_ms, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", _SETTLED)
        self.young = handle.getListState("young", _EVENT)

    def _read(self) -> tuple[tuple | None, list[tuple]]:
        settled = tuple(self.settled.get()) if self.settled.exists() else None
        return settled, [tuple(x) for x in self.young.get()] if self.young.exists() else []

    def _timers(self, now: tuple | None, watermark: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now:
            ends = [now[0] // 1000 + self.expiry]
            if now[1] == "processing":
                ends.append(now[3] // 1000 + self.limit)
            for t in ends:
                self.handle.registerTimer(max(t, watermark + 1))

    def _row(self, key: Any, change: str, now: tuple, at: int | None = None) -> Row:
        import datetime

        when = datetime.datetime.fromtimestamp((now[0] if at is None else at) / 1e6, datetime.UTC)
        return Row(session_id=key[0], change=change, status=now[1], error_message=now[2], at=when)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        settled, young = self._read()
        before = fold(settled, young)
        watermark = timerValues.getCurrentWatermarkInMs()
        # A set, so that events that are sent again count once.
        all_young = sorted(set(young) | {(int(r.us), r.status, r.error_message) for r in rows}, key=lambda e: (e[0], e[1] or "", e[2] or ""))
        passed = [e for e in all_young if e[0] // 1000 < watermark]
        settled, young = fold(settled, passed), all_young[len(passed) :]
        if settled:
            self.settled.update(settled)
        if young:
            self.young.put(young)
        else:
            self.young.clear()
        now = fold(settled, young)
        self._timers(now, watermark)
        if now and now[:3] != (before or ())[:3]:
            yield self._row(key, "state", now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        settled, young = self._read()
        now = fold(settled, young)
        if now is None:
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at >= now[0] // 1000 + self.expiry:
            self.settled.clear()
            self.young.clear()
            yield self._row(key, "expired", now, (now[0] // 1000 + self.expiry) * 1000)
            return
        if now[1] == "processing" and at >= now[3] // 1000 + self.limit:
            over = (now[3] // 1000 + self.limit) * 1000
            failed = (max(over, now[0]), "error", "timed out", max(over, now[0]))
            self.settled.update(failed)
            self.young.clear()
            self.handle.registerTimer(max(failed[0] // 1000 + self.expiry, timerValues.getCurrentWatermarkInMs() + 1))
            yield self._row(key, "timeout", failed, over)

    def close(self) -> None:
        pass


def session_lifecycle(events: DataFrame, limit_seconds: int = 1000, expiry_hours: float = 24, delay: str = "10 minutes") -> DataFrame:
    """(session_id, change, status, error_message, at) of a stream of events (session_id, status, error_message, at).

    change: `state` for a new state, `timeout` for processing that took too long,
    `expired` for a session without events for `expiry_hours`, which is forgotten.
    The session's state store becomes RocksDB, which timers need. The processor
    travels by value, as the process that prepares it may not know this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    e = events.selectExpr("session_id", "status", "error_message", "at", "unix_micros(at) AS us").withWatermark("at", delay)
    processor = Lifecycle(limit_seconds * 1000, int(expiry_hours * 3_600_000))
    return e.groupBy("session_id").transformWithState(processor, CHANGES, "Update", "EventTime")
