"""Permutations are one to one and can be undone; replacements never collide."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import permutation as P
from maskwright.operators import enrich


@pytest.mark.parametrize("a, b", [(1, 10), (7, 5), (48, 20), (100, 10)])
def test_one_to_one(spark, a, b):
    rows = spark.range(a * b).select("id", P.permute("s", F.lit("x"), F.col("id"), a, b).alias("p"), P.permute("s", F.lit("y"), F.col("id"), a, b).alias("o")).withColumn("back", P.unpermute("s", F.lit("x"), F.col("p"), a, b)).collect()
    assert sorted(r.p for r in rows) == list(range(a * b)) and all(r.back == r.id for r in rows)
    assert [r.p for r in rows] != [r.o for r in rows] or a == 1


def test_digits_keep_their_place(spark):
    texts = ["+1 (499) 555-6503", "7", "x", "", None, "1" * 40, "a1b22c"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.permuted_digits("s", F.lit("d"), F.col("t")).alias("f")).collect()]
    for t, f in zip(texts, got):
        assert (t is None and f is None) or [c.isdigit() or c for c in t] == [c.isdigit() or c for c in f]
    all_three = spark.range(1000).select(P.permuted_digits("s", F.lit("d"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("f"))
    assert all_three.distinct().count() == 1000


def test_pools_run_over_without_collisions(spark):
    n = spark.range(40_000)
    for f in (P.nth_name, P.nth_address, P.nth_email):
        assert n.select(f("s", F.lit("d"), F.col("id")).alias("v")).distinct().count() == 40_000


def entities(spark):
    rows = [(d, f"Person {i}", i, "Full Name") for d in (1, 2) for i in range(1500)] + [(1, " person 7 ", 1501, "Full Name"), (1, "a@b.c", 1502, "Email"), (1, "12-34", 1503, "Phone"), (None, "x", 0, "Other"), (None, "y", 1, "Other")]
    return spark.createDataFrame(rows, "doc_id long, original_text string, ent_idx int, entity_type string")


@pytest.mark.parametrize("scope", [("doc_id",), ()])
def test_distinct_originals_have_distinct_replacements(spark, scope):
    e = entities(spark)
    got = enrich.with_distinct_fakes(e, "salt", scope=scope)
    assert got.count() == e.count() and got.where("fake is null").count() == 0
    key = F.lower(F.trim("original_text"))
    n = got.groupBy(*scope, "entity_type", "fake").agg(F.count_distinct(key).alias("n")).agg(F.max("n")).first()[0]
    m = got.groupBy(*scope, "entity_type", key).agg(F.count_distinct("fake").alias("n")).agg(F.max("n")).first()[0]
    assert n == m == 1
    again = enrich.with_distinct_fakes(e.repartition(7), "salt", scope=scope)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert enrich.with_distinct_fakes(e.limit(0), "salt", scope=scope).collect() == []
