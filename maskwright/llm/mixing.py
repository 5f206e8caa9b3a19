"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a target number of words: its weight's share of the budget, but
at most `cap` times what it has; the excess goes to the other sources by weight.
A document of a source is due rate = target / source size copies. Documents of a
source stand in one order; the running sum of expected copies, plus one random
offset of the source, crosses an integer boundary once for each copy emitted.

The order is by size, so that a systematic sample takes small and large
documents alike and a source's taken words come near its target. Positions come
from block totals: a block holds one source, one band of sizes (two leading
digits) and one of `SPLIT` hash classes, so neither a hot source nor a common
size lands in one task, and the running sum over blocks has at most a few ten
thousand rows a source whatever the number of documents.

Defined results: null text has size 0; null source is a source of its own,
ordered last; a source without words has target 0 and takes nothing; repeated
rows are separate documents; an empty table gives no rows; other columns are not
read. Sizes tie by a seeded hash of the id, then the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle

WEIGHTS = (1, 2, 3)
SEED = "mix-1"
SPLIT = 64


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = 3.0, seed: str = SEED) -> DataFrame:
    """(source, source_size, target, offset) from (source, size); a row for each source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source: these windows see the sources, not the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", pick)
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("full_at", F.col("most") / F.col("weight"))
    # Sources fill up in the order of full_at; at each, what is left and the weights that share it.
    up = Window.orderBy("full_at", "rank")
    s = s.withColumn("before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("budget", F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share))
    s = s.withColumn("level", (F.col("budget") - F.col("before")) / F.col("weights"))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("line", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank"))).over(whole))
    target = F.coalesce(F.least(F.col("weight") * F.col("line"), F.col("most")), F.col("most"))
    offset = _hash32(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("\u0000"))) / F.lit(4294967296.0)
    return s.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, cap: float = 3.0, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken."""
    sized = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix")
    per_source = source_targets(sized, weights, share, cap, seed)
    digits = F.col("size").cast("string")
    rows = sized.withColumn("band", F.length(digits) * 100 + F.substring(F.rpad(digits, 2, "0"), 1, 2).cast("int"))
    rows = rows.withColumn("h", _hash32(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.pmod("h", F.lit(SPLIT)))
    block = ["source", "band", "part"]
    start = rows.groupBy(*block).count().withColumn("start", F.sum("count").over(Window.partitionBy("source").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count"))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy(*block).orderBy("size", "h", "doc_id")))
    b, t = start.alias("b"), per_source.alias("t")
    placed = placed.alias("r").join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.band") == F.col("b.band")) & (F.col("r.part") == F.col("b.part")))
    placed = placed.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda k: F.floor(F.col("offset") + F.col("rate") * k)
    placed = placed.select("r.doc_id", "r.source", "size", "source_size", "target", "offset", rate.alias("rate"), (F.col("start") + F.col("i")).alias("at"))
    placed = placed.withColumn("copies", upto(F.col("at")) - upto(F.col("at") - 1))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every document of `docs`, with all its columns, as often as the plan takes it."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    keyed = docs.select("*", F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), word_count(F.col(text_col)).alias("z")).alias(k := free_name(docs, "_mix_key")))
    n, c = free_name(docs, "_mix_row"), free_name(docs, "_mix_copies")
    # Rows that agree in id, source and size are told apart by a number, on either side.
    keyed = keyed.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(text_col)))
    plan = plan.select(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z")).alias("pk"), F.col("copies").alias(c))
    plan = plan.withColumn("pn", F.row_number().over(Window.partitionBy("pk").orderBy(F.desc(c)))).where(F.col(c) > 0)
    out = keyed.join(plan, keyed[k].eqNullSafe(plan["pk"]) & (keyed[n] == plan["pn"]))
    return out.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_digest(docs)


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_sql(documents: str = "documents", seed: str = SEED) -> str:
    """DuckDB SQL for mix_digest over a table or subquery."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {documents}
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), w AS (
  SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0 AS most, source_size * 3.0 / (rank % 3 + 1) AS full_at FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(weight * (SELECT arg_min(level, (full_at, rank)) FROM l WHERE level <= full_at), most) AS target,
    CAST(('0x' || substr(md5('{seed}|' || coalesce(source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l
), r AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(rpad(CAST(size AS VARCHAR), 2, '0'), 1, 2) AS INT) AS band,
    CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM sized
), p AS (
  SELECT r.doc_id, r.source, r.size, row_number() OVER (PARTITION BY r.source ORDER BY band, h % {SPLIT}, r.size, h, r.doc_id) AS pos FROM r
), q AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, t.u, pos, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(u + rate * pos) AS BIGINT) - CAST(floor(u + rate * (pos - 1)) AS BIGINT) AS copies FROM q
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM c"""
