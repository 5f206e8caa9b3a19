"""What the operators share: scratch tables, collision-free columns, graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_settled, if_small, settled

__all__ = ["ascii_lower", "components", "crc_bucket", "drop_settled", "free_name", "if_small", "join_by_key", "settle", "with_fields"]

#: Written to the shared folder and read back: cuts lineage, survives lost executors.
settle = settled

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType(schema.fields + T._parse_datatype_string(ddl).fields)


#: A key is hot if it holds one in HOT_KEYS rows; no more keys than that can.
HOT_KEYS = 2000


def join_by_key(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """The `total` rows joined to `keys`, which has a row for each key with n, the rows that hold it.

    The hot keys, HOT_KEYS at most, meet their rows by broadcast; the others by a shuffle without hot tasks.
    """
    hot = keys.where(F.col("n") * HOT_KEYS >= total).drop("n")
    rest = keys.where(F.col("n") * HOT_KEYS < total).drop("n")
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cool.join(rest, key))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the undirected edges (a, b): the smallest id of its component.

    Alternates large-star and small-star steps until nothing changes; each step
    is one grouping by node whose state is a minimum, so hot nodes combine
    before the shuffle. Edges are rewritten, never gathered on the driver.
    """
    e = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc")
    before = None
    for _ in range(rounds):
        old = e
        # Large star: each node's larger neighbours go to the smallest node around it.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: each node's smaller neighbours, and itself, go to the smallest of them.
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        e = e.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        e = settle(e, "cc")
        drop_settled(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = e.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    return member.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
