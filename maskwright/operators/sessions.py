"""Session state as an append-only log of events; the last one speaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of a session.
STATUSES = ("uploaded", "processing", "awaiting_review", "completed", "error")
SHOWING = ("awaiting_review", "completed")


def invalid_status(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def event(sessions: DataFrame, status: str, at: Column, error: Column | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status is one of {STATUSES}, not {status!r}")
    return sessions.select("session_id", F.lit(status).alias("status"), (error if error is not None else F.lit(None)).cast("string").alias("error_message"), at.alias("at"))


def current_state(events: DataFrame, tie: str | None = None) -> DataFrame:
    """The last event of each session; combined before the shuffle, so a busy session is no hot key."""
    order = F.struct("at", *([tie] if tie else []), "status")
    return events.groupBy("session_id").agg(F.max_by(F.struct(*[F.col(c) for c in events.columns if c != "session_id"]), order).alias("e")).select("session_id", "e.*")


def timed_out(events: DataFrame, now: Column, limit_seconds: float = 1000) -> DataFrame:
    """Sessions still processing longer than the limit, from when they entered that state last."""
    w = Window.partitionBy("session_id").orderBy("at", "status")
    runs = events.withColumn("before", F.lag("status").over(w)).where("status = 'processing' and (before is null or before <> 'processing')")
    since = runs.groupBy("session_id").agg(F.max("at").alias("since"))
    late = current_state(events).where("status = 'processing'").join(since, "session_id")
    elapsed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / F.lit(1e6)
    return late.where(elapsed > limit_seconds).select("session_id", "since", elapsed.alias("elapsed_s"), F.lit("error").alias("status"), F.lit("timed out").alias("error_message"))


def session_view(state: DataFrame, entities: DataFrame) -> DataFrame:
    """State with entity count, and the entities only while they are for review or done."""
    e = entities.groupBy("session_id").agg(F.count("*").alias("entity_count"), F.collect_list(F.struct(*[F.col(c) for c in entities.columns if c != "session_id"])).alias("entities"))
    out = state.join(e, "session_id", "left")
    return out.withColumn("entity_count", F.coalesce("entity_count", F.lit(0)).cast("long")).withColumn("entities", F.when(F.col("status").isin(*SHOWING), F.col("entities")))
