"""Merging variants of one name or text inside a document and entity type.

The longest text comes first; each next one joins the first root that it matches
or becomes a root. A group is one document's entities of one type. A group above
`MAX_ENTITIES` is merged by joins instead of in one huge array, with the same
result; only with a `max_entities` of the caller's does it go to the errors side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contained_share
from ..functions.text import contains_run, once, tokens
from ..session import settled
from .detect import TITLES

MAX_ENTITIES = 5000
COVERED = 0.8


def is_variant(parent: Column, child: Column) -> Column:
    """Child words are a variant of parent words: equal, a slice, or as many with titles before a shared end."""
    n = F.size(child)
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(place, lambda i: F.get(child, i) != F.get(parent, i))
    # The shared end begins after the last difference.
    head = F.coalesce(F.array_max(differs), F.lit(-1)) + 1
    titled = (n == F.size(parent)) & (head < n) & F.forall(F.slice(child, 1, head), lambda w: F.regexp_replace(w, r"\.", "").isin(*TITLES))
    return (n > 0) & (n <= F.size(parent)) & (contains_run(parent, child) | titled)


def _joined_roots(entities: DataFrame) -> DataFrame:
    """variant_roots by joins of word slices, for groups of any size."""
    keys = ["doc_id", "entity_type"]
    items = settled(entities.select(*keys, F.struct((-F.length("original_text")).alias("size"), F.col("ent_idx").cast("int").alias("ent_idx")).alias("at"), tokens(F.col("original_text")).alias("words")))
    wordy, n = items.where(F.size("words") > 0), F.size("words")
    text = lambda i, k: F.array_join(F.slice("words", i, k), " ")
    end = lambda k: F.concat(F.lit("t"), n.cast("string"), F.lit(" "), text(n - k + 1, k))
    slices = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.concat(F.lit("s"), text(i, k)))))
    ends = F.transform(F.sequence(F.lit(1), n), end)
    parents = wordy.select(*keys, F.col("at").alias("parent"), F.explode(F.array_distinct(F.concat(slices, ends))).alias("key"))
    # A child is a whole slice, or has titles only before an end that it shares with as many words.
    titled = lambda k: (k < n) & F.forall(F.slice("words", 1, n - k), lambda w: F.regexp_replace(w, r"\.", "").isin(*TITLES))
    own = F.concat(F.array(F.concat(F.lit("s"), text(1, n))), F.transform(F.filter(F.sequence(F.lit(1), n), titled), end))
    children = wordy.select(*keys, "at", F.explode(own).alias("key"))
    edges = settled(children.join(parents, [*keys, "key"]).where("parent < at").select(*keys, "at", "parent").distinct())
    is_root = [settled(items.join(edges, [*keys, "at"], "left_anti").select(*keys, "at", F.col("at").alias("root")))]
    while True:
        # Decided is who has no parent left undecided before the first that is a root.
        done = reduce(DataFrame.unionByName, is_root)
        known = done.select(*keys, F.col("at").alias("parent"), (F.col("root") == F.col("at")).alias("top"))
        open_edges = edges.join(done, [*keys, "at"], "left_anti").join(known, [*keys, "parent"], "left")
        first = open_edges.groupBy(*keys, "at").agg(F.min(F.when(F.col("top"), F.col("parent"))).alias("root"), F.min(F.when(F.col("top").isNull(), F.col("parent"))).alias("open"))
        new = settled(first.where(F.col("open").isNull() | (F.col("root") < F.col("open"))).select(*keys, "at", F.coalesce("root", "at").alias("root")))
        if not new.limit(1).count():
            return done.select(*keys, F.col("at.ent_idx").alias("ent_idx"), F.col("root.ent_idx").alias("root_idx"))
        is_root.append(new)


def variant_roots(entities: DataFrame, max_entities: int | None = None, *, fold_up_to: int = MAX_ENTITIES) -> DataFrame:
    """(doc_id, entity_type, ent_idx, root_idx) for all entities, or for those of groups within the caller's limit."""
    if max_entities is not None:
        return _folded_roots(entities, max_entities)
    large = oversized_groups(entities, fold_up_to).select("doc_id", "entity_type")
    folded = _folded_roots(entities, fold_up_to)
    if not large.limit(1).count():
        return folded
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("entity_type").eqNullSafe(F.col("of_type"))
    return folded.unionByName(_joined_roots(entities.join(large.toDF("of_doc", "of_type"), same, "left_semi")))


def _folded_roots(entities: DataFrame, max_entities: int) -> DataFrame:
    item = F.struct((-F.length("original_text")).alias("size"), F.col("ent_idx").alias("ent_idx"), tokens(F.col("original_text")).alias("words"))
    groups = entities.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(item)).alias("all")).where(F.size("all") <= max_entities)
    kind = "array<struct<ent_idx:int,words:array<string>,root:int>>"

    def step(done, e):
        # A variant's last word is one of its root's, which is seen sooner than the rest.
        last = F.get(e["words"], F.size(e["words"]) - 1)
        roots = once(last, lambda w: F.filter(done, lambda r: (r["root"] == r["ent_idx"]) & F.array_contains(r["words"], w) & is_variant(r["words"], e["words"])))
        root = F.coalesce(F.get(roots, 0)["ent_idx"], e["ent_idx"].cast("int"))
        return F.concat(done, F.array(F.struct(e["ent_idx"].cast("int").alias("ent_idx"), e["words"].alias("words"), root.alias("root"))))

    folded = groups.select("doc_id", "entity_type", F.inline(F.aggregate("all", F.array().cast(kind), step)))
    return folded.select("doc_id", "entity_type", "ent_idx", F.col("root").alias("root_idx"))


def oversized_groups(entities: DataFrame, max_entities: int = MAX_ENTITIES) -> DataFrame:
    n = entities.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n_entities"))
    return n.where(F.col("n_entities") > max_entities).withColumn("error", F.lit("too many entities of one type to merge"))


def _covered(occ: Column, held: Column) -> Column:
    """The occurrence's first box is covered by any box of a held occurrence on its page."""
    first = F.get(occ["bounding_boxes"], 0)
    return F.exists(held, lambda h: (h["page_number"] == occ["page_number"]) & F.exists(h["bounding_boxes"], lambda b: contained_share(first, b) >= COVERED))


def merge_variants(entities: DataFrame, max_entities: int | None = None) -> DataFrame:
    """Root entities with their children's occurrences that they don't cover yet."""
    placed = entities.join(variant_roots(entities, max_entities), ["doc_id", "entity_type", "ent_idx"])
    child = F.struct((F.col("ent_idx") != F.col("root_idx")).alias("is_child"), (-F.length("original_text")).alias("size"), "ent_idx", "occurrences")
    groups = placed.groupBy("doc_id", "entity_type", "root_idx").agg(F.array_sort(F.collect_list(child)).alias("all"))
    occs = F.flatten(F.transform(F.filter("all", lambda c: c["is_child"]), lambda c: c["occurrences"]))
    own = F.get("all", 0)["occurrences"]
    merged = F.aggregate(occs, own, lambda held, o: F.when(_covered(o, held), held).otherwise(F.concat(held, F.array(o))))
    roots = groups.select("doc_id", "entity_type", F.col("root_idx").alias("ent_idx"), merged.alias("occurrences"), F.size("all").alias("n_merged"))
    return entities.drop("occurrences").join(roots, ["doc_id", "entity_type", "ent_idx"])


def uncovered(children: DataFrame, parents: DataFrame, share: float = COVERED) -> DataFrame:
    """Child boxes (doc_id, page_number, x, y, w, h) that no parent box covers."""
    c, p = children.alias("c"), parents.alias("p")
    box = lambda a: F.array(*[F.col(f"{a}.{v}") for v in ("x", "y", "w", "h")])
    near = (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.page_number") == F.col("p.page_number"))
    return c.join(p, near & (contained_share(box("c"), box("p")) >= share), "left_anti")


def merge_counts(entities: DataFrame, merged: DataFrame) -> DataFrame:
    a = entities.groupBy("doc_id").agg(F.count("*").alias("before"))
    b = merged.groupBy("doc_id").agg(F.count("*").alias("after"))
    return a.join(b, "doc_id", "left").select("doc_id", "before", F.coalesce("after", F.lit(0)).cast("long").alias("after"))
