"""Folders and files in, tables out, and the small functions that no query needs."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from maskwright.functions import geometry, pseudonyms
from maskwright.operators import detect, report, validate, verify
from maskwright.plans import jobs
from maskwright.sources import documents, files, sinks
from maskwright.streaming import jobs as streams

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_folder_lists_supported_files(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "c.jpeg"):
        (tmp_path / name).write_bytes(b"12345")
    assert sorted((r.filename, r.length) for r in files.list_folder(spark, str(tmp_path)).collect()) == [("a.PDF", 5), ("c.jpeg", 5)]


def test_configs_from_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"field_definitions": [{"name": "A", "description": "a"}]}))
    (tmp_path / "two.json").write_text("{}")
    got = {(r.config_key, r.name, r.error) for r in files.read_configs(spark, str(tmp_path)).collect()}
    assert got == {("one", "A", None), ("two", None, "no field definitions")}


def test_templates(spark):
    rows = files.template_summary(files.templates(spark)).collect()
    assert [(r.key, r.template_name, r.field_count) for r in rows] == [("common_pii", "Common PII", 4)]


def test_ocr_from_files(spark, tmp_path):
    page = {"pageNumber": 2, "width": 10, "height": 20, "words": [{"content": "x", "confidence": 0.5, "polygon": [1, 2, 3, 2, 3, 4, 1, 4]}]}
    (tmp_path / "d1.json").write_text(json.dumps({"analyzeResult": {"pages": [page]}}))
    r = files.read_ocr(spark, str(tmp_path)).first()
    assert (r.doc_id, r.page_number, r.text) == ("d1", 2, "x") and [round(v, 3) for v in r.box] == [0.1, 0.1, 0.2, 0.1]


def entity_rows(spark):
    return spark.createDataFrame([(1, 0, "Email", "a@b.cc"), (2, 0, "IP", "1.2.3.4")], "doc_id long, ent_idx int, entity_type string, original_text string")


def test_entities_replace_their_run_only(spark, tmp_path):
    path = str(tmp_path / "e")
    e = entity_rows(spark)
    sinks.write_entities(e, path, "2024-01-01", now())
    sinks.write_entities(e.where("doc_id = 1"), path, "2024-01-02", now())
    sinks.write_entities(e.where("doc_id = 2"), path, "2024-01-01", now())
    out = spark.read.parquet(path).collect()
    assert sorted((str(r.run_date), r.doc_id, r.status) for r in out) == [("2024-01-01", 2, "awaiting_review"), ("2024-01-02", 1, "awaiting_review")]


def test_intermediates_fail_softly(spark, tmp_path, capsys):
    e = entity_rows(spark)
    assert sinks.write_intermediates(e, e, str(tmp_path / "x")) and spark.read.parquet(str(tmp_path / "x/entities_raw")).count() == 2
    (tmp_path / "file").write_text("")
    assert not sinks.write_intermediates(e, e, str(tmp_path / "file")) and "not written" in capsys.readouterr().out
    assert not sinks.write_intermediates(e, e, str(tmp_path / "y"), enabled=False)


def test_ocr_pages_lose_their_images(spark, tmp_path):
    p = spark.createDataFrame([(1, "img")], "doc_id long, image_base64 string")
    sinks.write_ocr_pages(p, str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()
    sinks.write_ocr_pages(p, str(tmp_path / "o"), enabled=True)
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["doc_id"]


def test_results_events_and_masked_files(spark, tmp_path):
    sinks.write_batch_results(spark.createDataFrame([("a", None)], "filename string, error string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().error == ""
    event = spark.createDataFrame([("s", "uploaded")], "session_id string, status string")
    for _ in range(2):
        sinks.append_events(event, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    sinks.write_masked(spark.createDataFrame([("a.b.docx", "x")], "filename string, masked_text string"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().output_name == "a.b_masked.pdf"


def test_configs_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "c")
    f = lambda name, d: spark.createDataFrame([(name, d)], "config_name string, description string")
    for name, d in (("My Config", "1"), ("other", "2"), ("my config", "3")):
        sinks.save_configs(f(name, d), path, now())
    assert sorted(r.description for r in spark.read.parquet(path).collect()) == ["2", "3"]
    assert sorted((r.key, r.name) for r in sinks.list_configs(spark, path).collect()) == [("my_config", "My Config"), ("other", "Other")]


def test_decisions_come_before_masking(spark, tmp_path):
    d = spark.createDataFrame([(1, "mail a@b.cc"), (2, "ip 1.2.3.4")], "doc_id long, text string")
    spans = detect.detect(d)
    e = spark.createDataFrame([(1, "e1", "Email", "a@b.cc", "Entity Label", "", 0), (2, "e2", "IP", "1.2.3.4", "Black Out", "", 0)], "doc_id long, entity_id string, entity_type string, original_text string, strategy string, replacement_text string, ent_idx int")
    yes = spark.createDataFrame([(1, "e1")], "doc_id long, entity_id string")
    edits = spark.createDataFrame([(1, "e1", 0, "first"), (1, "e1", 1, "last")], "doc_id long, entity_id string, pos int, replacement_text string")
    decided, masked, verified, errors = jobs.approve_and_mask(d, spans, e, yes, edits, decided_at=now(), decisions_path=str(tmp_path / "audit"))
    assert sorted((r.entity_id, r.approved) for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [("e1", True), ("e2", False)]
    assert {r.doc_id: r.masked_text for r in masked.collect()} == {1: "mail last", 2: "ip 1.2.3.4"}
    assert {r.doc_id: (r.score, r.verdict) for r in verified.collect()} == {1: (100.0, "Excellent"), 2: (100.0, "No entities found")}
    assert [r.doc_id for r in errors.collect()] == [2] and decided.count() == 2
    (tmp_path / "blocked").write_text("")
    with pytest.raises(Exception):
        jobs.approve_and_mask(d, spans, e, yes, edits, decided_at=now(), decisions_path=str(tmp_path / "blocked"))


def test_job_merges_variants_and_takes_other_extractors(spark):
    d = spark.createDataFrame([(1, "John Smith met Smith, not Mr.")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "Full Name", "John Smith", 0, 10), (1, "Full Name", "Smith", 15, 5), (1, "Full Name", "Mr.", 26, 3)], "doc_id long, entity_type string, original_text string, start int, length int")
    entities, masked, verified = jobs.deidentify(d, salt="s", strategies={"Full Name": "Fake Data"}, found=found)
    fake = {r.original_text: r.replacement for r in entities.collect()}
    assert set(fake) == {"John Smith", "Smith"} and fake["John Smith"].split()[1] == fake["Smith"]
    assert masked.first().masked_text == f"{fake['John Smith']} met {fake['Smith']}, not Mr."
    assert verified.first().score == 100.0


def test_extractors_by_name(spark):
    d = spark.createDataFrame([(1, "the quick brown fox")], "doc_id long, text string")
    words = spark.createDataFrame([("Animal", "Brown Fox")], "entity_type string, entity_text string")
    assert [(r.original_text, r.start, r.length) for r in jobs.extract_entities(d, "dictionary", dictionary=words).collect()] == [("brown fox", 2, 2)]
    with pytest.raises(ValueError, match="extractor is one of"):
        jobs.extract_entities(d, "oracle")
    assert jobs.extract_entities(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("original", "form"), [("05 Jan 2025", r"\d\d [A-Z][a-z]{2} 2025"), ("5 Jan 25", r"[1-9]\d? [A-Z][a-z]{2} 25"), ("Jan 5 2025", r"[A-Z][a-z]{2} \d{1,2} 2025"), ("January 05, 1987", r"[A-Z][a-z]{2,8} \d\d, 1987"), ("5 Jan 87", r"\d{1,2} [A-Z][a-z]{2} 87"), ("2001/02/03", r"2001/\d\d/\d\d"), ("3/4/99", r"\d{1,2}/\d{1,2}/99")])
def test_dates_keep_form_and_year(spark, original, form):
    row = spark.createDataFrame([(original,)], "o string").select(pseudonyms.like_date(pseudonyms.date_in_year("s", F.lit("k"), F.col("o")), F.col("o")).alias("d"))
    import re

    assert re.fullmatch(form, row.first().d)


@pytest.mark.parametrize(("kind", "original", "form"), [("Home Address", "Unit 4 12 Long Street, Oldtown NSW 2000", r"Unit \d+ \d+ [A-Z][a-z]+ Street, [A-Z][a-z]+ [A-Z]{2,3} \d{4}"), ("Company", "X Ltd", r"[A-Z][a-z]+ [A-Z][a-z]+"), ("Bank Account", "12", r"\d{12}"), ("Website", "x", r"https://[a-z]+\.example\.com/"), ("User Id", "u", r"[a-z]+\d{3}"), ("Other", "a@b.c", r"[a-z]+\.[a-z]+\d{3}@example\.com"), ("Other", "Ab-12", r"[A-Z][a-z]-\d\d"), ("Social Security", "1", r"\d{3}-\d\d-\d{4}"), ("Driver Licence", "1", r"[A-Z]\d{7}"), ("Postcode Address", "1", r"\d{4}"), ("Job Title", "x", r"[A-Z][a-z]+")])
def test_fake_values_by_kind(spark, kind, original, form):
    import re

    v = spark.createDataFrame([(kind, original)], "t string, o string").select(pseudonyms.fake_value("s", F.lit("k"), F.col("t"), F.col("o")).alias("v")).first().v
    assert re.fullmatch(form, v), v


def test_given_names_keep_their_gender(spark):
    row = spark.createDataFrame([("Dr. Anne-Marie JONES Jr",)], "o string").select(pseudonyms.fake_value("s", F.lit("k"), F.lit("Full Name"), F.col("o"), {"anne": "female"}).alias("v")).first().v.split()
    assert row[0] == "Dr." and row[3] == "Jr" and row[1].split("-")[0] in pseudonyms.GIVEN["female"] and row[2].isupper()


def test_whole_words_only(spark):
    o = spark.createDataFrame([(1, 1, "ann"), (1, 1, r"a\e")], "doc_id long, page_number int, original_text string")
    p = spark.createDataFrame([(1, 1, r"Joanna saw A\E")], "doc_id long, page_number int, masked_text string")
    assert {r.original_text: r.masked for r in verify.check_occurrences(o, p, whole_words=True).collect()} == {"ann": True, r"a\e": False}
    assert {r.original_text: r.masked for r in verify.check_occurrences(o, p).collect()} == {"ann": False, r"a\e": False}


def test_banners(spark):
    b = lambda *v: report.batch_banner(spark.createDataFrame([(("error" if x is None else "completed"), x) for x in v], "status string, verdict string")).first()
    assert b("Excellent", "No entities found").level == "success" and b("Excellent", "Review recommended").level == "info"
    r = b("Excellent", None)
    assert (r.level, r.done, r.total) == ("warning", 1, 2)


def test_positions_in_a_batch(spark):
    names = [f"f{i * 7919 % 1009:04d}" for i in range(1009)]
    got = {r.filename: (r.i, r.n) for r in report.numbered(spark.createDataFrame([(n,) for n in names], "filename string").repartition(7)).collect()}
    assert got == {n: (i + 1, 1009) for i, n in enumerate(sorted(names))}


def test_box_of_boxes(spark):
    df = spark.createDataFrame([([[0.1, 0.2, 0.3, 0.1], [0.5, 0.1, 0.2, 0.05], None, [1.0]],), ([],)], "b array<array<double>>")
    out = [r.u for r in df.select(geometry.union(F.col("b")).alias("u")).collect()]
    assert [round(v, 6) for v in out[0]] == [0.1, 0.1, 0.6, 0.2] and out[1] is None


def test_digital_and_scanned_pages(spark):
    p = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, page_number int, text string")
    out = documents.all_pages(p((1, 1, "a"), (1, 2, "b")), p((1, 2, "ocr"), (1, 3, "c")))
    assert sorted((r.page_number, r.text, r.source) for r in out.collect()) == [(1, "a", "digital_pdf"), (2, "ocr", "scanned_pdf"), (3, "c", "scanned_pdf")]


def test_blank_and_fitting(spark):
    df = spark.createDataFrame([(" \t",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(detect.nonblank(F.col("t"))).collect()] == [False, True, False]
    assert validate.first_of_name(spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "filename string, pos int, v string")).first().v == "early"


def test_first_arrivals_of_a_stream(spark, tmp_path):
    schema = "filename string, at timestamp"
    for i, rows in enumerate(([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00")], [("a", "2024-01-01 00:02:00"), ("c", "2024-01-01 00:03:00")])):
        spark.createDataFrame([(n, datetime.fromisoformat(t)) for n, t in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = streams.first_arrivals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.filename for r in spark.table("arrivals").collect()) == ["a", "b", "c"]


def test_shuffles_of_a_step_go_with_it(spark):
    from maskwright.session import settled

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    assert len(settled(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().repartition(3)).collect()) == 7
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
