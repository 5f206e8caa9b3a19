"""What extraction adds to entities: ids, defaults, strategies, labels and consistent fake values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permutation import distinct_fake
from ..functions.pseudonyms import fake_value, value_key
from ..functions.text import consistency_key, label_suffix, lookup, type_stem
from ..session import settled

# Names of strategies as configured, and what they mean.
STRATEGIES = {"Black Out": "redact", "redact": "redact", "Fake Data": "fake_name", "fake_name": "fake_name", "Entity Label": "entity_label", "entity_label": "entity_label"}


def strategy_of(name: Column) -> Column:
    """redact, fake_name or entity_label; anything else, and none, is redact."""
    return lookup(STRATEGIES, F.coalesce(name, F.lit("")), "redact")


def with_ids(entities: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "entity_type", "original_text", "ent_idx")]
    return entities.withColumn("entity_id", F.sha2(F.concat_ws("|", *parts), 256))


def with_defaults(entities: DataFrame) -> DataFrame:
    values = {"confidence": F.lit(0.9), "approved": F.lit(True), "replacement_text": F.lit("")}
    have = set(entities.columns)
    return entities.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in values.items()})


def with_strategies(entities: DataFrame, field_defs: DataFrame) -> DataFrame:
    """The strategy of the first definition named like the entity's type; a definition without one means Black Out, no definition null."""
    first = field_defs.groupBy("name").agg(F.min_by(F.coalesce("strategy", F.lit("Black Out")), "pos").alias("strategy"))
    return entities.drop("strategy").join(first, entities["entity_type"] == first["name"], "left").drop("name")


def with_labels(entities: DataFrame) -> DataFrame:
    """{Type}_{A..Z, 27..}: numbered by type in the order of first sight; the same text keeps its first type's label."""
    key = consistency_key(F.col("original_text"))
    order = ("page_number", "ent_idx") if "page_number" in entities.columns else ("ent_idx",)
    e = entities.withColumn("_key", key)
    owner = e.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(*order))).where("_nth = 1")
    owner = owner.withColumn("_number", F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy(*order)))
    owner = owner.select("doc_id", "_key", F.concat(type_stem(F.col("entity_type")), F.lit("_"), label_suffix(F.col("_number"))).alias("label"))
    return e.join(owner, ["doc_id", "_key"]).drop("_key")


def with_fakes(entities: DataFrame, salt: str, *, corpus_wide: bool = False, given: dict[str, str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """A fake value for each entity, or for the wanted ones by their columns; texts that agree without case and outer space share that of the type seen first."""
    order = ("page_number", "ent_idx") if "page_number" in entities.columns else ("ent_idx",)
    w = Window.partitionBy("doc_id", consistency_key(F.col("original_text"))).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scope = F.lit("*") if corpus_wide else F.col("doc_id")
    e = entities.withColumn("_type", F.first("entity_type").over(w)).withColumn("_text", F.first("original_text").over(w))
    if wanted is not None:
        e = e.join(wanted, wanted.columns, "left_semi")
    e = e.withColumn("_value_key", value_key(scope, F.col("_text")))
    return e.withColumn("fake", fake_value(salt, F.col("_value_key"), F.col("_type"), F.col("_text"), given)).drop("_type", "_text", "_value_key")


def with_distinct_fakes(entities: DataFrame, salt: str, *, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A fake value for each entity that no other text of its scope and type has; texts that agree without case and outer space share one.

    A text's number is its rank by first sight inside the scope; the number is drawn
    through a keyed permutation, so that order doesn't show. An empty scope is the
    whole table: its texts are ranked by ranges of the order, not in one task.
    """
    order = [F.col(c) for c in (("page_number", "ent_idx") if "page_number" in entities.columns else ("ent_idx",))]
    e = entities.withColumn("_key", consistency_key(F.col("original_text"))).withColumn("_type", F.lower("entity_type"))
    seen = e.groupBy(*scope, "_type", "_key").agg(F.min(F.struct(*order)).alias("_first"), F.min_by("original_text", F.struct(*order, "original_text")).alias("_text"), F.min("entity_type").alias("_of"))
    if scope:
        seen = seen.withColumn("_n", (F.row_number().over(Window.partitionBy(*scope, "_type").orderBy("_first", "_key")) - 1).cast("long"))
        where = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope])
    else:
        ranged = settled(seen.repartitionByRange("_type", "_key").sortWithinPartitions("_type", "_key").withColumn("_part", F.spark_partition_id()), "distinct")
        sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
        before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy("_type", "_key")) - 1
        seen = ranged.join(F.broadcast(before.drop("_size")), "_part").withColumn("_n", (F.col("_before") + inside).cast("long")).drop("_part", "_before")
        where = F.lit("*")
    made = seen.withColumn("fake", distinct_fake(salt, where, F.col("_of"), F.col("_text"), F.col("_n"))).drop("_first", "_text", "_of", "_n")
    same = F.lit(True)
    left, right = e.alias("e"), made.alias("m")
    for c in (*scope, "_type", "_key"):
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}"))
    return left.join(right, same).select("e.*", "m.fake").drop("_key", "_type")


def with_replacements(entities: DataFrame) -> DataFrame:
    """replacement_text by strategy from `fake` and `label`: a label, a fake value, or nothing to black out."""
    kind = strategy_of(F.col("strategy"))
    return entities.withColumn("replacement_text", F.when(kind == "fake_name", F.col("fake")).when(kind == "entity_label", F.concat(F.lit("["), F.col("label"), F.lit("]"))).otherwise(F.lit("")))
