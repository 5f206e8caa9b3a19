"""The same work over a stream of arriving files and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DOCUMENTS = "doc_id long, filename string, text string"
EVENTS = "session_id string, status string, error_message string, at timestamp"

# Kinds of audit lines.
AUDIT = ("UPLOAD", "PROCESS_START", "PROCESS_COMPLETE", "PROCESS_FAILURE", "MASK_START", "MASK_COMPLETE", "MASK_FAILURE", "DELETE")


def process_files(spark: SparkSession, folder: str, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, schema: str = DOCUMENTS) -> StreamingQuery:
    """Runs the batch function once over each file that arrives and appends its rows; a rerun of a batch replaces what it wrote."""

    def write(df: DataFrame, batch_id: int) -> None:
        result = batch(df).withColumn("batch_id", F.lit(batch_id))
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(files: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Files whose name was not seen within the delay, by arrival time `at`."""
    return files.withWatermark("at", delay).dropDuplicatesWithinWatermark(["filename"])


def _advance(limit_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        status, since = state.get
        state.remove()
        if status == "processing":
            yield pd.DataFrame({"session_id": [key[0]], "status": ["error"], "error_message": ["timed out"], "at": [pd.Timestamp(since + limit_ms, unit="ms")]})
        return
    # One row is held, however many events a busy session has.
    last = None
    for rows in batches:
        top = rows.sort_values(["at", "status"], kind="stable").tail(1)
        if last is None or (top["at"].iloc[0], top["status"].iloc[0]) >= (last["at"].iloc[0], last["status"].iloc[0]):
            last = top
    out, last = last, last.iloc[0]
    at = int(last["at"].value // 1_000_000)
    old, since = state.getOption or ("", at)
    since = since if old == last["status"] == "processing" and at >= since else at
    state.update((last["status"], since))
    if last["status"] == "processing":
        state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))
    yield out[["session_id", "status", "error_message", "at"]]


def session_states(events: DataFrame, limit_seconds: int = 1000, delay: str = "10 minutes") -> DataFrame:
    """Each session's state as events come in; one that stays in processing too long, in event time, becomes an error."""
    limit = limit_seconds * 1000
    return (
        events.withWatermark("at", delay)
        .groupBy("session_id")
        .applyInPandasWithState(lambda k, p, s: _advance(limit, k, p, s), EVENTS, "status string, since long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def audit_counts(events: DataFrame, kind: str = "event", at: str = "at", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Audit lines by kind and hour; works on a batch as on a stream."""
    e = events.withWatermark(at, delay) if events.isStreaming else events
    g = e.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).count()
    return g.select(F.col("w.start").alias("hour"), "kind", F.col("count").alias("n"))
