"""Review: approvals, edits, decisions and how entities are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def approved(entities: DataFrame) -> DataFrame:
    """Entities not refused; a missing flag means approved."""
    return entities.where(F.coalesce("approved", F.lit(True)))


def selected(entities: DataFrame, approvals: DataFrame) -> DataFrame:
    return entities.join(approvals.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")


def without_approval(entities: DataFrame, approvals: DataFrame) -> DataFrame:
    """Documents none of whose entities is approved: an error of the request."""
    docs = entities.select("doc_id").distinct()
    return docs.join(selected(entities, approvals), "doc_id", "left_anti").withColumn("error", F.lit("No approved entities found"))


def with_edits(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewers' replacement texts over the stored ones, also of unapproved entities; the last edit of an entity wins."""
    last = edits.groupBy("doc_id", "entity_id").agg(F.max_by("replacement_text", "pos").alias("_edit"))
    return entities.join(last, ["doc_id", "entity_id"], "left").withColumn("replacement_text", F.coalesce("_edit", "replacement_text")).drop("_edit")


def decisions(entities: DataFrame, approvals: DataFrame, decided_at: Column) -> DataFrame:
    """Every entity with whether it is approved, and when that was decided."""
    yes = approvals.select("doc_id", "entity_id").distinct().withColumn("_yes", F.lit(True))
    return entities.drop("approved").join(yes, ["doc_id", "entity_id"], "left").withColumn("approved", F.col("_yes").isNotNull()).withColumn("decided_at", decided_at).drop("_yes")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def page_list(occurrences: Column) -> Column:
    """Distinct pages in order, as "1, 3"."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(occurrences, lambda o: o["page_number"]))), lambda p: p.cast("string")), ", ")


def first_page(occurrences: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(occurrences, lambda o: o["page_number"])), F.lit(1))


def review_table(entities: DataFrame) -> DataFrame:
    """Entities as they are shown: a document's rows stand together, by first page, type and position."""
    e = entities.select("*", page_list(F.col("occurrences")).alias("pages"), first_page(F.col("occurrences")).alias("first_page"), confidence_band(F.col("confidence")).alias("band"), percent(F.col("confidence")).alias("confidence_text"))
    return e.repartition("doc_id").sortWithinPartitions("doc_id", "first_page", "entity_type", "ent_idx")


def selection_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id").agg(F.count_if(F.coalesce("approved", F.lit(True))).alias("selected"), F.count("*").alias("total"))
