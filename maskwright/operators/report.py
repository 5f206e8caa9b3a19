"""Counts, shares and banners over results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def strategy_counts(entities: DataFrame) -> DataFrame:
    """(doc_id, summary): "Black Out: 2, Unknown: 1", by name."""
    n = entities.groupBy("doc_id", F.coalesce("strategy", F.lit("Unknown")).alias("strategy")).count()
    text = F.concat_ws(": ", "strategy", F.col("count").cast("string"))
    return n.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("summary"))


def by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.countDistinct("doc_id").alias("n_docs"))


def entities_per_session(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return entities.groupBy(key).agg(F.count("*").alias("entity_count"))


def words_per_page(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "page_number").agg(F.count("*").alias("word_count"))


def batch_results(files: DataFrame, extracted: DataFrame, masked: DataFrame, errors: DataFrame) -> DataFrame:
    """One row a file: completed, no_entities or error, with counts."""
    r = files.select("filename", "session_id").join(extracted.select("session_id", "entities_found"), "session_id", "left")
    r = r.join(masked.select("session_id", "entities_masked", "output_path"), "session_id", "left").join(errors.select("session_id", "error"), "session_id", "left")
    found = F.coalesce("entities_found", F.lit(0))
    status = F.when(F.col("error").isNotNull(), "error").when(found == 0, "no_entities").otherwise("completed")
    return r.select("filename", "session_id", status.alias("status"), found.cast("int").alias("entities_found"), F.coalesce("entities_masked", F.lit(0)).cast("int").alias("entities_masked"), "output_path", "error")


def batch_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = results.agg(F.count("*").alias("files"), n("completed").alias("processed"), n("no_entities").alias("no_entities"), n("error").alias("errors"), F.coalesce(F.sum("entities_masked"), F.lit(0)).alias("entities_masked"))
    return out.withColumn("message", F.format_string("Processed %d, no entities %d, errors %d", "processed", "no_entities", "errors"))


def batch_banner(results: DataFrame) -> DataFrame:
    """success if every verdict is Excellent, warning if any file failed, else info; with done / total."""
    bad, good = F.count_if(F.col("status") == "error"), F.count_if(F.col("verdict").isin("Excellent", "No entities found"))
    out = results.agg(F.count("*").alias("total"), bad.alias("failed"), good.alias("good"))
    level = F.when(F.col("failed") > 0, "warning").when(F.col("good") == F.col("total"), "success").otherwise("info")
    return out.select(level.alias("level"), (F.col("total") - F.col("failed")).alias("done"), "total")


def numbered(files: DataFrame, order: str = "filename") -> DataFrame:
    """Position and number of files in the batch: places inside ranges of the order, behind the rows of the ranges before."""
    part = Window.partitionBy("_range").orderBy(order)
    ranges = settled(files.select(order).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "numbered")
    # One row a partition.
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).withColumn("n", F.sum("_size").over(Window.partitionBy()))
    return ranges.withColumn("i", F.row_number().over(part)).join(F.broadcast(before), "_range").select(order, (F.col("i") + F.col("_before")).alias("i"), "n")


def stage_shares(times: DataFrame) -> DataFrame:
    """(stage, seconds, share, per_item): time of each stage and its share of the total, from (stage, seconds)."""
    s = times.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.avg("seconds").alias("per_item"))
    total = times.agg(F.sum("seconds").alias("total"))
    return s.join(F.broadcast(total)).select("stage", "seconds", (F.col("seconds") / F.col("total")).alias("share"), "per_item")
