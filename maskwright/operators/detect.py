"""Finding sensitive text: patterns over documents or pages, and rules on what counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup, match_form, once, strip

# Entity types and their patterns, which match the same text in Java and RE2.
PATTERNS = {
    "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "Phone": r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "Credit Card": r"\b[0-9]{16}\b",
    "IP": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "Secret": r'token = "[0-9a-f]{40}"',
    "SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "Date": r"\b(?:[0-9]{1,2}[/-][0-9]{1,2}[/-](?:[0-9]{4}|[0-9]{2})|[0-9]{4}-[0-9]{2}-[0-9]{2})\b",
    "Medicare": r"\b[0-9]{4} [0-9]{5} [0-9A-Z](?: [0-9])?\b",
}

# Titles that join name variants but are no name by themselves.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "rev", "det", "sgt", "capt", "lt", "col", "cpl")


def matches_at(text: Column, pattern: str) -> Column:
    """(original_text, start) of all matches, left to right; starts count characters from 0."""
    all_found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<original_text:string,start:int>>").alias("out"))

    def step(acc, m):
        start = acc["at"] + F.length(m["before"])
        return F.struct((start + F.length(m["value"])).alias("at"), F.concat(acc["out"], F.array(F.struct(m["value"].alias("original_text"), start.alias("start")))).alias("out"))

    def placed(found):
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda b, v: F.struct(b.alias("before"), v.alias("value")))
        return F.aggregate(F.slice(pairs, 1, F.size(found)), none, step, lambda a: a["out"])

    return once(all_found, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast("array<struct<original_text:string,start:int>>")))


def detect(texts: DataFrame, *, keys=("doc_id",), text_col: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """A row for each match: keys, entity_type, original_text, start, length. Texts without any give none."""
    # The outer form: before the other one Spark puts a filter that looks through all texts again.
    return texts.select(*keys, F.inline_outer(spans_in(F.col(text_col), patterns))).where("entity_type is not null")


def spans_in(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """All matches of all patterns as an array beside the text: entity_type, original_text, start, length."""
    return F.flatten(F.array(*[_tag(text, p, t) for t, p in patterns.items()]))


def _tag(text: Column, pattern: str, entity_type: str) -> Column:
    return F.transform(matches_at(text, pattern), lambda m: F.struct(F.lit(entity_type).alias("entity_type"), m["original_text"].alias("original_text"), m["start"].alias("start"), F.length(m["original_text"]).alias("length")))


def credible(spans: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Drops titles as names, place parts as addresses, and names inside a longer name's span."""
    t, text = F.lower("entity_type"), match_form(F.col("original_text"))
    title = F.contains(t, F.lit("name")) & F.regexp_replace(text, r"\.", "").isin(*TITLES)
    place = F.contains(t, F.lit("address")) & ~text.rlike(r"[0-9]+\S* +\S")
    kept = spans.where(~title & ~place)
    a, b = kept.alias("a"), kept.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "entity_type")]
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("b.start") + F.col("b.length") >= F.col("a.start") + F.col("a.length")) & (F.col("b.length") > F.col("a.length"))
    condition = inside & F.contains(F.lower("a.entity_type"), F.lit("name"))
    for s in same:
        condition = condition & s
    return a.join(b, condition, "left_anti")


def entities_from_spans(spans: DataFrame, strategies: dict[str, str] | None = None) -> DataFrame:
    """One entity per document, type and lower-cased text, numbered by first position: doc_id, ent_idx, entity_type, original_text, strategy, n_spans."""
    e = spans.groupBy("doc_id", "entity_type", F.lower("original_text").alias("key")).agg(F.min_by("original_text", "start").alias("original_text"), F.min("start").alias("first_start"), F.count("*").alias("n_spans"))
    e = e.withColumn("ent_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_start", "entity_type")) - 1)
    return e.withColumn("strategy", lookup(strategies, F.col("entity_type"), "Black Out") if strategies else F.lit("Black Out"))


def nonblank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""
