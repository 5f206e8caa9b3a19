"""Checks that split rows in good and bad, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid
from ..functions.text import extension, strip
from .enrich import strategy_of

SCANNABLE = (".pdf", ".png", ".jpg", ".jpeg")
ACCEPTED = (*SCANNABLE, ".docx")
MAX_BYTES = 10 * 1024 * 1024


def check_files(files: DataFrame, accepted=ACCEPTED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (filename, length) with reject_reason, null for good ones."""
    ext = extension(F.col("filename"))
    reason = F.when(~ext.isin(*accepted), F.concat(F.lit("unsupported file type "), ext)).when(F.col("length") > max_bytes, F.lit("file too large"))
    return files.withColumn("reject_reason", reason)


def first_of_name(files: DataFrame) -> DataFrame:
    """Of files of one name, the one listed first."""
    return files.groupBy("filename").agg(F.min_by(F.struct(*[F.col(c) for c in files.columns if c != "filename"]), "pos").alias("f")).select("filename", "f.*")


def clean_fields(fields: DataFrame, drop_blank: bool = True) -> DataFrame:
    """Stripped names and descriptions, Fake Data where no strategy is set; blank ones dropped or kept for field_errors."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    out = fields.withColumns({"name": strip(F.col("name")), "description": strip(F.col("description")), "strategy": F.coalesce("strategy", F.lit("Fake Data"))})
    return out.where(~blank("name") & ~blank("description")) if drop_blank else out


def field_errors(fields: DataFrame) -> DataFrame:
    """(config_key, name, error): blank names or descriptions and names that occur twice."""
    f = clean_fields(fields, drop_blank=False)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    blank = f.where(empty("name") | empty("description")).select("config_key", "name", F.when(empty("name"), "blank name").otherwise("blank description").alias("error"))
    twice = f.where(~empty("name")).groupBy("config_key", "name").count().where("count > 1").select("config_key", "name", F.lit("duplicate name").alias("error"))
    return blank.unionByName(twice)


def valid_occurrences(occurrences: Column) -> Column:
    """Occurrences with their valid boxes; those without any go."""
    kept = F.transform(occurrences, lambda o: o.withField("bounding_boxes", F.filter(o["bounding_boxes"], valid)))
    return F.filter(kept, lambda o: F.size(o["bounding_boxes"]) > 0)


def valid_entities(entities: DataFrame) -> DataFrame:
    """Entities with a type, a text and an occurrence that has a box."""
    e = entities.withColumn("occurrences", valid_occurrences(F.col("occurrences")))
    return e.where((strip(F.col("entity_type")) != "") & (strip(F.col("original_text")) != "") & (F.size("occurrences") > 0))


def normal_strategy(entities: DataFrame) -> DataFrame:
    return entities.withColumn("strategy", strategy_of(F.col("strategy")))


def contract_violations(responses: DataFrame) -> DataFrame:
    """(doc_id, path, message) for entities (doc_id, ent_idx, ...) that break the response contract; extra columns are allowed."""
    c = F.col
    in_unit = lambda v: v.isNotNull() & (v >= 0) & (v <= 1)
    each = lambda test: F.forall(F.coalesce(c("occurrences"), F.array().cast(responses.schema["occurrences"].dataType)), test)
    rules = [
        ("id", c("entity_id").isNotNull() & (c("entity_id") != ""), "required"),
        ("entity_type", c("entity_type").isNotNull() & (c("entity_type") != ""), "required"),
        ("original_text", c("original_text").isNotNull() & (c("original_text") != ""), "required"),
        ("confidence", in_unit(c("confidence")), "not between 0 and 1"),
        ("occurrences", c("occurrences").isNotNull() & (F.size("occurrences") > 0), "empty"),
        ("occurrences[].page_number", each(lambda o: o["page_number"].isNotNull() & (o["page_number"] >= 1)), "less than 1"),
        ("occurrences[].original_text", each(lambda o: o["original_text"].isNotNull()), "required"),
        ("occurrences[].bounding_boxes", each(lambda o: o["bounding_boxes"].isNotNull() & F.forall(o["bounding_boxes"], valid)), "not four numbers"),
    ]
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.concat(F.lit("entities["), c("ent_idx").cast("string"), F.lit(f"].{path}")).alias("path"), F.lit(message).alias("message"))) for path, ok, message in rules])
    return responses.select("doc_id", F.inline(F.filter(checks, lambda x: x.isNotNull())))
