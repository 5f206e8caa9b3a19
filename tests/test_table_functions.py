"""Table functions in SQL: results of the DataFrame operators, errors that stay with their text, and edges."""

import pytest

from maskwright.operators import detect
from maskwright.plans import table_functions as T


@pytest.fixture(scope="module")
def sql(spark):
    T.register(spark)
    return spark.sql


def test_extraction_equals_detection(spark, sql):
    docs = spark.createDataFrame([(1, "a@b.org, 1.2.3.4 é5.6.7.8"), (2, None), (3, ""), (1, "a@b.org"), (None, "+1 (499) 555-6503")], "doc_id long, text string")
    got = sql("SELECT doc_id, entity_type, original_text, start, length FROM extract_entities(TABLE({d})) WHERE error IS NULL", d=docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, detect.detect(docs).collect()))
    assert sql("SELECT * FROM extract_entities(TABLE({d}))", d=docs.limit(0)).collect() == []


def test_an_error_costs_its_text_only(spark, sql):
    spans = spark.createDataFrame([(1, "abcdef", 0, 3, "X"), (1, "abcdef", 2, 2, "Y"), (2, "abc", 1, 9, "X"), (3, "none", None, None, None), (4, None, None, None, None), (5, "aé𝄞b", 2, 1, None)], "doc_id long, text string, start int, length int, replacement string")
    got = {r.doc_id: (r.masked_text, r.error) for r in sql("SELECT * FROM mask_spans(TABLE({s}) PARTITION BY doc_id)", s=spans).collect()}
    assert got.pop(2)[1].startswith("span 1+9")
    assert got == {1: ("Xef", None), 3: ("none", None), 4: (None, None), 5: ("aéb", None)}


def test_a_text_stands_beside_one_of_its_spans(spark, sql):
    spans = spark.createDataFrame([(1, None, 0, 3, "X"), (1, "abcdef", None, None, None), (1, None, 4, 1, "Y"), (2, "none", None, None, None), (3, None, None, None, None)], "doc_id long, text string, start int, length int, replacement string")
    got = {r.doc_id: (r.masked_text, r.n_spans) for r in sql("SELECT * FROM mask_spans(TABLE({s}) PARTITION BY doc_id)", s=spans).collect()}
    assert got == {1: ("XdYf", 2), 2: ("none", 0), 3: (None, 0)}


def test_a_failing_text_is_a_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "find_entities", lambda text: 1 / 0 if text == "bad" else [("Kind", text, 0, len(text))])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["bad", "good"]})
    handler = getattr(T.ExtractEntities, "func", T.ExtractEntities)
    rows = next(handler().eval(batch)).to_pylist()
    assert rows[0]["error"] == "division by zero" and rows[1]["original_text"] == "good" and rows[1]["error"] is None
