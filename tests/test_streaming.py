"""A stream gives what the batch gives."""

import json

from pyspark.sql import functions as F

from maskwright.operators import detect
from maskwright.streaming import jobs


def test_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    docs = [(i, f"f{i}.txt", f"mail a{i}@b.com") for i in range(4)]
    put = lambda name, part: (folder / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "filename", "text"), d))) for d in part))
    run = lambda: jobs.process_files(spark, str(folder), detect.detect, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put("a.json", docs[:2])
    run()
    put("b.json", docs[2:])
    run()
    run()
    got = {(r.doc_id, r.original_text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.doc_id, r.original_text) for r in detect.detect(spark.createDataFrame(docs, jobs.DOCUMENTS)).collect()}
    assert got == want and len(got) == 4


def test_session_timeout(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    line = lambda s, st, t: json.dumps({"session_id": s, "status": st, "error_message": None, "at": t})
    (folder / "1.json").write_text("\n".join([line("a", "processing", "2024-01-01T00:00:00Z"), line("b", "processing", "2024-01-01T00:00:00Z")]))
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    q = jobs.session_states(stream, limit_seconds=60, delay="1 second").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (folder / "2.json").write_text(line("b", "completed", "2024-01-01T00:10:00Z"))
        q.processAllAvailable()
        (folder / "3.json").write_text(line("c", "uploaded", "2024-01-01T00:20:00Z"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.session_id, r.status) for r in spark.table("states").collect()}
    assert ("a", "error") in got and ("b", "completed") in got and ("b", "error") not in got


def test_hourly_counts(spark):
    e = spark.createDataFrame([("UPLOAD", 0), ("UPLOAD", 10), ("DELETE", 4000)], "event string, t long").withColumn("at", F.timestamp_seconds("t"))
    assert sorted((r.kind, r.n) for r in jobs.audit_counts(e).collect()) == [("DELETE", 1), ("UPLOAD", 2)]
