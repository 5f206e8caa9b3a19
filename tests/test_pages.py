"""Pages as arrays beside the texts: the same rows as by single words, and nothing moved."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.batches import lots
from maskwright.functions.geometry import merge_lines
from maskwright.operators import detect, mask, match, replace
from maskwright.sources import documents


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Ann Lee met\u00a0Ann lee " + "word " * 205), (2, None), (3, " \n"), (4, "Lee Ann, Lee"), (5, " ".join(f"W{i % 7}x Lee" for i in range(120)))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_paged_words_equal_words(docs):
    paged = documents.paged_words(docs, boxes=True)
    assert "Exchange" not in plan(paged.select("doc_id", "page_number", F.size("page_words"))).replace("Exchange RoundRobin", "")
    single = documents.words(docs).drop("confidence")
    assert got(paged.select("doc_id", "page_number", F.inline("page_words"))) == got(single)
    assert got(documents.pages(paged)) == got(documents.pages(documents.words(docs)))


def test_matches_and_masks_of_pages_equal_those_of_words(spark, docs):
    d = spark.createDataFrame([("Ann Lee",), ("lee",), ("word word word",)], "entity_text string")
    one, page = match.match_dictionary(documents.words(docs), d), match.match_dictionary(documents.paged_words(docs), d)
    assert got(one) == got(page) and one.count() > 100
    assert "hashpartitioning" not in plan(page)
    hits = lambda m: m.select("doc_id", "page_number", "word_idx", "n", F.lit("X").alias("replacement"))
    assert got(mask.mask_words(documents.words(docs), hits(one))) == got(mask.mask_words(documents.paged_words(docs), hits(page)))


def test_fields_in_place_equal_fields_for_boxes(spark):
    box = [(1, 1, 1, "Ann", 0.0, 0.0, 1.0, 1.0), (1, 1, 2, "an", 5.0, 5.0, 5.0, 6.0), (1, 1, 2, "Ann Lee", 8.0, 8.0, 9.0, 9.0), (1, 1, 3, "AN", None, 0.0, 1.0, 1.0), (1, 1, 4, " ", 9.0, 9.0, 9.0, 9.0)]
    field = [(1, 1, "a", "Anna", 0.5, 0.5, 2.0, 2.0), (1, 1, "b", "an", 3.0, 3.0, 2.0, 4.0), (1, 1, "c", "", 8.5, 8.5, 8.7, 9.5), (1, 1, "d", None, 0.9, 0.9, 1.5, 1.5), (1, 1, "e", "Lee", 20.0, 20.0, 21.0, 21.0)]
    sides = "x0 double, y0 double, x1 double, y1 double"
    b = spark.createDataFrame(box, f"doc_id long, page_number int, occ_id int, original string, {sides}")
    f = spark.createDataFrame(field, f"doc_id long, page_number int, field_name string, field_value string, {sides}")
    page = lambda df, name: df.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct(*df.columns[2:])).alias(name))
    own = page(b, "boxes").join(page(f, "fields"), ["doc_id", "page_number"]).select("doc_id", "page_number", F.inline(replace.fields_in_place(F.col("boxes"), F.col("fields"))))
    assert got(own) == got(replace.fields_for_boxes(b, f)) and own.count() > 3


def test_lines_keep_sides_only(spark):
    rows = [([[0.5, 0.2, 0.1, 0.1], [0.1, 0.208, 0.1, 0.3], None, [0.1, 0.214, 0.2, 0.1], [0.1, None, 0.2, 0.1]],), ([],)]
    d = spark.createDataFrame(rows, "b array<array<double>>").select(merge_lines(F.col("b")).alias("m"))
    (first,), (none,) = sorted(d.collect(), reverse=True)
    assert [[round(v, 6) for v in x] for x in first] == [[0.1, 0.2, 0.5, 0.308], [0.1, 0.214, 0.2, 0.1]] and none == []


def test_detection_looks_through_a_text_once(spark):
    d = spark.range(3).selectExpr("id AS doc_id", "concat('a@b.org x', id) AS text")
    assert detect.detect(d)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == len(detect.PATTERNS)


def test_lots_keep_all_rows_in_bounded_slices():
    b = pa.RecordBatch.from_pydict({"i": list(range(5)), "t": ["x" * (3 << 20), None, "a", "b" * (2 << 20), "c"]})
    cut = list(lots([b, b.slice(0, 0)], 1))
    assert [x.num_rows for x in cut] == [1, 2, 1, 1] and [i for x in cut for i in x.column(0).to_pylist()] == list(range(5))


def test_words_of_results_do_not_carry_their_pages(spark):
    from maskwright.sources import files

    page = '{"pageNumber": 3, "width": 10.0, "height": 20.0, "words": [{"content": "a", "confidence": 0.5, "polygon": [1, 2, 3, 2, 3, 6, 1, 6]}, {"content": "b", "polygon": [1, 2, 3, 2, 3, 6, 1, 6, 5, 8]}, {"content": "c", "polygon": [1, 2]}]}'
    blank = '{"words": [{"content": "d", "polygon": [1, 2, 3, 2, 3, 6, 1, 6]}]}'
    results = spark.createDataFrame([(1, f'{{"analyzeResult": {{"pages": [{page}, {blank}, {{"words": []}}]}}}}'), (2, '{"analyzeResult": {}}')], "doc_id long, value string")
    words = files.ocr_words(results.selectExpr("doc_id", f"from_json(value, '{files.OCR}').analyzeResult AS analyzeResult"))
    assert sorted(map(tuple, words.collect())) == [
        (1, 2, 0, "d", 0.0, [None] * 4),
        (1, 3, 0, "a", 0.5, [0.1, 0.1, 0.2, 0.2]),
        (1, 3, 1, "b", 0.0, [0.1, 0.1, 0.4, 0.3]),
        (1, 3, 2, "c", 0.0, [0.0] * 4),
    ]
    # What goes through the explosion of the words is copied for each of them.
    generates = [line for line in words._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert len(generates) == 2 and sum("posexplode(words#" in line for line in generates) == 1
