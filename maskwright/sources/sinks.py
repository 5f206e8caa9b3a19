"""Tables that jobs write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_key, display_name, masked_name


def write_entities(merged: DataFrame, path: str, run_date: str, saved_at: Column) -> None:
    """Merged entities of one run; a rerun replaces its own partition only."""
    out = merged.withColumn("saved_at", saved_at).withColumn("status", F.lit("awaiting_review")).withColumn("run_date", F.lit(run_date))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def write_intermediates(raw: DataFrame, pre_merge: DataFrame, path: str, enabled: bool = True) -> bool:
    """Debug tables beside the hot one; a failure here is told, not raised."""
    if not enabled:
        return False
    try:
        raw.write.mode("overwrite").parquet(f"{path}/entities_raw")
        pre_merge.write.mode("overwrite").parquet(f"{path}/entities_pre_merge")
    except Exception as e:  # noqa: BLE001
        print(f"intermediates not written: {e}")
        return False
    return True


def write_ocr_pages(pages: DataFrame, path: str, enabled: bool = False) -> None:
    if enabled:
        pages.drop("image_base64").write.mode("overwrite").parquet(path)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """The audit comes before masking; if it fails, this raises and nothing is masked."""
    decisions.write.mode("append").parquet(path)


def write_masked(masked: DataFrame, path: str) -> None:
    masked.withColumn("output_name", masked_name(F.col("filename"))).write.mode("overwrite").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def update_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """sessions (session_id, ...) with the last change of each field laid over them; changes (session_id, field, value, at) of unknown sessions or fields are left out."""
    fields = [c for c in sessions.columns if c != "session_id"]
    last = changes.where(F.col("field").isin(*fields)).groupBy("session_id").pivot("field", fields).agg(F.max_by("value", F.struct("at", "value")))
    new = last.select("session_id", *[F.col(f"`{c}`").alias(f"_new_{c}") for c in fields])
    merged = [F.coalesce(F.col(f"_new_{c}").cast(sessions.schema[c].dataType), F.col(c)).alias(c) for c in fields]
    return sessions.join(new, "session_id", "left").select("session_id", *merged)


def write_batch_results(results: DataFrame, path: str) -> None:
    results.na.fill("").write.mode("overwrite").parquet(path)


def save_configs(fields: DataFrame, path: str, saved_at: Column) -> None:
    """Field definitions with config_name, one partition a key; saving a key again replaces it."""
    out = fields.withColumn("key", config_key(F.col("config_name"))).withColumn("saved_at", saved_at)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def list_configs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key").distinct().withColumn("name", display_name(F.col("key")))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in new, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
