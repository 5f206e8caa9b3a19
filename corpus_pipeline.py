"""A training corpus from `documents`: five operators in a row, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
to the shared folder and read again before the next one starts, so a lost
executor costs at most one stage. All but the last return the columns of
documents, others with them; the last returns the mixing plan (doc_id, size,
source_size, target, taken, copies).

Defined results: a null text has no language and goes first; a null id takes part
in everything (it counts as an empty text where folds are dealt); repeated rows
are separate in all stages but the third, which keeps one row of each group, and
tells rows apart by id and text; texts without words pass the third and the fourth
stage; a null source is a source of its own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import settle
from maskwright.llm.decontaminate import decontaminate
from maskwright.llm.jaccard_join import deduplicate
from maskwright.llm.language_id import keep_languages
from maskwright.llm.lines import drop_boilerplate
from maskwright.llm.mixing import mix_digest
from maskwright.session import ship_package


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter, or whose most likely language has a posterior below 0.5."""
    ship_package(spark)
    return keep_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than 6.5 % of a source's documents go; n_chars follows the text."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles, one document stays: the lowest id, then the lowest text hash."""
    ship_package(spark)
    return deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    ship_package(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes."""
    return mix_digest(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("mix_sources", mixture),
]

#: Language ID has no SQL; tests/llm/test_pipeline.py compares all stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
