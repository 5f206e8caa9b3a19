"""The automaton against plain search, and whole texts against the join and the masking of words."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskwright.operators import automaton as A
from maskwright.operators import detect, mask, match, verify
from maskwright.sources.documents import words


def test_equals_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        entries = [[rng.choice("abc") for _ in range(rng.randrange(5))] for _ in range(rng.randrange(9))]
        a = A.Automaton(entries)
        pages = [[rng.choice("abcd") for _ in range(rng.randrange(1, 15))] for _ in range(5)]
        steps = np.full((5, 16), -1)
        for i, p in enumerate(pages):
            steps[i, : len(p)] = a.numbered(p)
        got = sorted(zip(*(x.tolist() for x in a.run(steps))))
        assert got == sorted((i, j + len(e) - 1, k) for i, p in enumerate(pages) for k, e in enumerate(entries) if e for j in range(len(p)) if p[j : j + len(e)] == e)


def tables(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(("Ab", "ab", "b", "C ", " c", "d\x0be", "f\x1cg", "É", "é."))
    texts = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 7, 99, 100, 101, 350))))) for i in range(40)] + [(77, None), (78, " \n ")]
    entries = [(" ".join(word() for _ in range(rng.randrange(1, 5))), i) for i in range(25)] + [("ab", 90), ("AB", 91), (None, 92), (" ", 93)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(entries, "entity_text string, word_idx_ int")


def test_texts_equal_the_join(spark, monkeypatch):
    docs, entries = tables(spark)
    columns = ["doc_id", "page_number", "word_idx", "n", "gram", "word_idx_"]
    want = sorted(map(tuple, match.match_dictionary(words(docs), entries).select(*columns).collect()))
    assert sorted(map(tuple, A.match_texts(docs, entries).select(*columns).collect())) == want and want
    monkeypatch.setattr(A, "ENTRIES", 3)
    assert sorted(map(tuple, A.match_texts(docs, entries).select(*columns).collect())) == want
    assert A.match_texts(docs.limit(0), entries).collect() == []


def test_nothing_is_shuffled(spark):
    docs, entries = tables(spark)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/automaton")
    plan = A.match_texts(spark.read.parquet(path), entries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_masked_texts_equal_masked_words(spark):
    docs, entries = tables(spark)
    docs = docs.dropDuplicates(["doc_id"])
    entries = entries.withColumn("replacement", F.concat(F.lit("["), F.col("word_idx_").cast("string"), F.lit("]")))
    hits = match.match_dictionary(words(docs), entries)
    want = {(r.doc_id, r.page_number): r.masked_text for r in mask.mask_words(words(docs), hits).collect()}
    got = A.mask_texts(docs, entries).collect()
    assert {(r.doc_id, r.page_number): r.masked_text for r in got} == want
    assert sum(r.occurrences for r in got) == hits.count() and sum(r.remaining for r in got) == 0
    again = A.mask_texts(docs, entries.withColumn("replacement", F.lit("ab"))).agg(F.sum("remaining")).first()[0]
    assert again > 0


def test_masking_in_place_equals_masking_by_joins(spark):
    docs = spark.createDataFrame([(1, "a@b.org and 1.2.3.4 and A@B.ORG"), (2, None), (3, ""), (4, "none"), (5, "x@y.io")], "doc_id long, text string")
    keep = lambda s: F.when(s["original_text"] == "x@y.io", s["original_text"]).otherwise(F.concat(F.lit("["), s["entity_type"], F.lit("]")))
    got = mask.masked_in_place(docs, detect.spans_in(F.col("text")), keep)
    assert {r.doc_id: r.masked_text for r in got.collect()} == {1: "[Email] and [IP] and [Email]", 2: None, 3: "", 4: "none", 5: "x@y.io"}
    spans = detect.detect(docs)
    joined = mask.masked_documents(docs, spans.withColumn("replacement", keep(F.struct("original_text", "entity_type"))))
    pages = joined.select("doc_id", F.lit(1).alias("page_number"), "masked_text")
    by_join = verify.score(docs, verify.check_occurrences(spans.select("doc_id", F.lit(1).alias("page_number"), "original_text"), pages))
    score = verify.score_in_place(got)
    assert sorted(map(tuple, score.select(*by_join.columns).collect())) == sorted(map(tuple, by_join.collect()))
    assert {r.doc_id: r.verdict for r in score.collect()}[5] == "Masking incomplete"
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
