"""What is old enough to go, and what storage holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that a session may hold.
ARTEFACTS = ("original.pdf", "metadata.json", "entities.json", "entities_raw.json", "masking_decisions.json", "masked.pdf")


def age_hours(mtime: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp"))) / F.lit(3.6e9)


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 1, "<1h").when(hours < 6, "1-6h").when(hours < 24, "6-24h").otherwise(">24h")


def expired(files: DataFrame, now: Column, max_age_hours: float = 24) -> DataFrame:
    return files.where(age_hours(F.col("mtime"), now) > max_age_hours)


def storage_statistics(files: DataFrame, now: Column) -> DataFrame:
    """Sessions, files and MB by age of the session's newest file."""
    s = files.groupBy("session_id").agg(F.max("mtime").alias("mtime"), F.count("*").alias("files"), F.sum("size").alias("size"))
    s = s.withColumn("age", age_bucket(age_hours(F.col("mtime"), now)))
    return s.groupBy("age").agg(F.count("*").alias("sessions"), F.sum("files").alias("files"), (F.sum("size") / F.lit(1048576)).alias("mb"))


def delete_manifest(files: DataFrame, now: Column, max_age_hours: float = 24) -> DataFrame:
    """Sessions whose newest file is too old, with what deleting them frees; deleting is a separate step."""
    s = files.groupBy("session_id").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"))
    return s.where(age_hours(F.col("mtime"), now) > max_age_hours).select("session_id", "mtime", "size")


def cleanup_totals(files: DataFrame, now: Column, max_age_hours: float = 24, dry_run: bool = True) -> DataFrame:
    s = files.groupBy("session_id").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"))
    old = age_hours(F.col("mtime"), now) > max_age_hours
    return s.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"), (F.coalesce(F.sum(F.when(old, F.col("size"))), F.lit(0)) / F.lit(1048576)).alias("freed_mb")).withColumn("dry_run", F.lit(dry_run))


def artefacts_present(sessions: DataFrame, listing: DataFrame, names=ARTEFACTS) -> DataFrame:
    """Known files that each session to delete really has."""
    expected = sessions.select("session_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return expected.join(listing, ["session_id", "name"], "left_semi")
