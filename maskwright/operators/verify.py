"""Verification: is an approved original still readable in the masked text?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_class


def classify_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("source", page_class(F.col("text")))


def pages_needed(pages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Only pages that hold an occurrence."""
    return pages.join(occurrences.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi")


def check_occurrences(occurrences: DataFrame, masked_pages: DataFrame, *, text_col: str = "masked_text", whole_words: bool = False) -> DataFrame:
    """occurrences with `masked` (the text is gone from its page) and `unverifiable` (there is no such page; counts as masked)."""
    pages = masked_pages.select("doc_id", "page_number", F.lower(F.col(text_col)).alias("_page"), F.lit(True).alias("_there"))
    o = occurrences.join(pages, ["doc_id", "page_number"], "left")
    text, page = F.lower("original_text"), F.coalesce("_page", F.lit(""))
    found = F.regexp(page, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(text, F.lit(r"\e"), F.lit(r"\E\\e\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))) if whole_words else F.contains(page, text)
    return o.withColumn("masked", ~found).withColumn("unverifiable", F.col("_there").isNull()).drop("_page", "_there")


def score(documents: DataFrame, checked: DataFrame) -> DataFrame:
    """(doc_id, occurrences_total, occurrences_masked, occurrences_unverifiable, score, remaining, verdict) for each document."""
    left = F.when(~F.col("masked"), F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit(":'"), F.col("original_text"), F.lit("'")))
    n = checked.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("masked").alias("ok"), F.count_if("unverifiable").alias("unseen"), F.array_join(F.array_sort(F.collect_list(left)), ", ").alias("remaining"))
    out = documents.select("doc_id").join(n, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    share = F.when(zero("total") > 0, F.bround(F.col("ok") / F.col("total") * 100, 1)).otherwise(F.lit(100.0))
    out = out.select("doc_id", zero("total").alias("occurrences_total"), zero("ok").alias("occurrences_masked"), zero("unseen").alias("occurrences_unverifiable"), share.alias("score"), F.coalesce("remaining", F.lit("")).alias("remaining"))
    return out.withColumn("verdict", verdict(F.col("score"), F.col("occurrences_total")))


def score_in_place(masked: DataFrame) -> DataFrame:
    """The columns of `score` for texts that carry their spans (mask.masked_in_place); each text is one page."""
    low = F.lower(F.coalesce("masked_text", F.lit("")))
    left = F.filter("spans", lambda s: F.contains(low, F.lower(s["original_text"])))
    m = masked.select("doc_id", F.size("spans").cast("long").alias("total"), left.alias("left"))
    ok = F.col("total") - F.size("left")
    listed = F.array_sort(F.transform("left", lambda s: F.concat(F.lit("p1:'"), s["original_text"], F.lit("'"))))
    share = F.when(F.col("total") > 0, F.bround(ok / F.col("total") * 100, 1)).otherwise(F.lit(100.0))
    out = m.select("doc_id", F.col("total").alias("occurrences_total"), ok.cast("long").alias("occurrences_masked"), F.lit(0).cast("long").alias("occurrences_unverifiable"), share.alias("score"), F.array_join(listed, ", ").alias("remaining"))
    return out.withColumn("verdict", verdict(F.col("score"), F.col("occurrences_total")))


def verdict(score: Column, total: Column | None = None) -> Column:
    base = F.when(score.isNull(), "Verify unavailable")
    if total is not None:
        base = base.when(total == 0, "No entities found")
    return base.when(score >= 90, "Excellent").when(score >= 70, "Review recommended").otherwise("Masking incomplete")


def scanned_minus(needed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Pages needed that are digital."""
    return needed.join(scanned.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")
