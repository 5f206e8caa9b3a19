"""Queries over what jobs write, read back from where it was written; over streams; and over branches that the supplied tables reach only with a turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pseudonyms
from ..operators import detect, enrich, mask, report
from ..session import scratch, settled, table
from ..sources import documents as docs_source
from ..sources import files, sinks
from ..streaming import jobs as streams
from ..streaming import lifecycle
from . import jobs
from .planted import with_people
from .queries import _DICT, _ENTITIES, _MASKED, _SPANS, _WORDS, NOW, SALT, STRATEGY, _approvals, _dictionary, _documents, _edits, _entities, _events, _identified, _masked_in_place, _now, _paged, _spans, _words, query

# Sinks.


@query(f"WITH {_ENTITIES} SELECT doc_id, ent_idx, entity_type, 'awaiting_review' AS status, d AS run_date FROM entities, (SELECT unnest(['2024-06-01', '2024-06-02']) AS d)")
def written_entities(spark, sf_dir):
    """Two runs, one of them written twice."""
    # Found once, written three times.
    e, path = settled(_entities(spark, sf_dir), "found"), scratch(spark, "entities")
    for day in ("2024-06-01", "2024-06-02", "2024-06-01"):
        sinks.write_entities(e, path, day, _now())
    return spark.read.parquet(path).select("doc_id", "ent_idx", "entity_type", "status", F.col("run_date").cast("string").alias("run_date"))


@query(f"""WITH {_ENTITIES}, {_WORDS} SELECT 'entities_raw' AS written, count(*) AS n, 'doc_id,entity_type,length,original_text,start' AS columns FROM spans
UNION ALL SELECT 'entities_pre_merge', count(*), 'doc_id,ent_idx,entity_type,first_start,key,n_spans,original_text,strategy' FROM entities
UNION ALL SELECT 'ocr_pages', count(*), 'doc_id,page_number,text' FROM (SELECT DISTINCT doc_id, page_number FROM words)""")
def written_intermediates(spark, sf_dir):
    """Tables for debugging; pages go without their images."""
    path = scratch(spark, "debug")
    spans = settled(_spans(spark, sf_dir), "found")
    sinks.write_intermediates(spans, detect.entities_from_spans(spans, STRATEGY), path)
    sinks.write_ocr_pages(docs_source.pages(_paged(spark, sf_dir)).withColumn("image_base64", F.lit("x")), f"{path}/ocr_pages", enabled=True)
    out = None
    for name in ("entities_raw", "entities_pre_merge", "ocr_pages"):
        t = spark.read.parquet(f"{path}/{name}")
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("written"), "n", F.lit(",".join(sorted(t.columns))).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_ENTITIES} SELECT doc_id, entity_id, doc_id % 4 <> 0 AS approved, TIMESTAMP '{NOW}' AS decided_at FROM ids")
def written_decisions(spark, sf_dir):
    """The audit that approve_and_mask writes before it masks."""
    e, path = _identified(spark, sf_dir), scratch(spark, "decisions")
    jobs.approve_and_mask(_documents(spark, sf_dir), _spans(spark, sf_dir), e, _approvals(e), _edits(e), decided_at=_now().cast("timestamp_ntz"), decisions_path=path)
    return spark.read.parquet(path)


@query(f"WITH {_MASKED} SELECT doc_id, 'doc' || doc_id || '_masked.pdf' AS output_name, md5(masked_text) AS masked_md5 FROM documents_text")
def written_masked(spark, sf_dir):
    path = scratch(spark, "masked")
    sinks.write_masked(_masked_in_place(spark, sf_dir).select("doc_id", "masked_text", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename")), path)
    return spark.read.parquet(path).select("doc_id", "output_name", F.md5(F.col("masked_text").cast("binary")).alias("masked_md5"))


@query(f"""WITH {_SPANS}, n AS (SELECT doc_id, count(entity_type) AS n FROM documents LEFT JOIN spans USING (doc_id) GROUP BY 1)
SELECT 'doc' || doc_id || '.txt' AS filename, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN n = 0 THEN 'no_entities' ELSE 'completed' END AS status, CAST(n AS INT) AS entities_found, '' AS output_path, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' ELSE '' END AS error FROM n""")
def written_results(spark, sf_dir):
    """The result table of a batch, put together file by file; nulls are empty texts."""
    d, path = _documents(spark, sf_dir), scratch(spark, "results")
    batch = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("doc_id").alias("session_id"))
    found = _spans(spark, sf_dir).groupBy(F.col("doc_id").alias("session_id")).agg(F.count("*").alias("entities_found"))
    masked = found.select("session_id", F.col("entities_found").alias("entities_masked"), F.lit(None).cast("string").alias("output_path"))
    errors = d.where("doc_id % 11 = 0").select(F.col("doc_id").alias("session_id"), F.lit("unreadable").alias("error"))
    sinks.write_batch_results(report.batch_results(batch, found, masked, errors), path)
    return spark.read.parquet(path).select("filename", "status", "entities_found", "output_path", "error")


@query("SELECT source AS key, upper(substr(source, 1, 1)) || substr(source, 2) AS name, count(*) AS fields FROM documents GROUP BY source")
def saved_configs(spark, sf_dir):
    """A configuration for each source with a field for each document, saved twice; the second time replaces the first."""
    path = scratch(spark, "configs")
    fields = table(spark, sf_dir, "documents").select(F.col("source").alias("config_name"), F.concat(F.lit("Field "), F.col("doc_id").cast("string")).alias("field"))
    for turn in (0, 1):
        sinks.save_configs(fields.withColumn("turn", F.lit(turn)), path, _now())
    n = spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("fields"))
    return sinks.list_configs(spark, path).join(n, "key").select("key", "name", "fields")


# Templates, kinds of replacements and extractors by name.


@query("""SELECT 'common_pii' AS key, 'Common PII' AS template_name, CAST(4 AS BIGINT) AS field_count, k AS entity_type, 'Fake Data' AS strategy, count(*) AS entities
FROM documents, (SELECT unnest(['Full Name', 'Physical Address', 'Date of Birth']) AS k) GROUP BY k""")
def template_coverage(spark, sf_dir):
    """Strategies of the built-in template for the people planted in all documents."""
    t = files.templates(spark)
    # Every document has planted people; the outer form asks for no filter that would plant them again.
    people = with_people(_documents(spark, sf_dir)).select("doc_id", F.inline_outer("planted"))
    n = enrich.with_strategies(people, t).groupBy("entity_type", "strategy").agg(F.count("*").alias("entities"))
    return n.crossJoin(F.broadcast(files.template_summary(t))).select("key", "template_name", "field_count", "entity_type", "strategy", "entities")


# Kinds of entities, a text of each, and the form of its replacement.
_FORMS = {
    "Email": ("jo@mail.org", r"[a-z]+\.[a-z]+[0-9]{3}@example\.com"),
    "Phone": ("+61 2 5550 1234", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    "SSN": ("123-45-6789", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "Credit Card": ("4111111111111111", r"4[0-9]{15}"),
    "Bank Account": ("123456", r"[0-9]{12}"),
    "Driver License": ("X123", r"[A-Z][0-9]{7}"),
    "IP": ("10.1.2.3", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    "Website": ("http://a.b", r"https://[a-z]+\.example\.com/"),
    "Postcode of Address": ("2000", r"[0-9]{4}"),
    "User Id": ("jo77", r"[a-z]+[0-9]{3}"),
    "Reference": ("who@where.org", r"[a-z]+\.[a-z]+[0-9]{3}@example\.com"),
    "Code": ("Ab-12", r"[A-Z][a-z]-[0-9]{2}"),
    "First Name": ("MARY-ANN", r"[A-Z]+-[A-Z]+"),
    "Full Name": ("Dr Alan Smith Jr", r"Dr [A-Z][a-z]+ [A-Z][a-z]+ Jr"),
    "Address": ("Unit 3, 12 Elm Street, Perth WA 6000", r"Unit [0-9]+ [0-9]+ [A-Z][a-z]+ Street, [A-Z][a-z]+ [A-Z]{2,3} [0-9]{4}"),
}
_KINDS = ", ".join(f"'{k}'" for k in _FORMS)


@query(f"SELECT doc_id, k AS entity_type, true AS fits FROM documents, (SELECT unnest([{_KINDS}]) AS k)")
def replacement_forms(spark, sf_dir):
    """A replacement of each kind for each document has the form of its kind."""
    kinds = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.lit(t).alias("text"), F.lit(f"^{form}$").alias("form")) for k, (t, form) in _FORMS.items()])
    d = _documents(spark, sf_dir).select("doc_id", F.inline(kinds)).withColumn("key", pseudonyms.value_key(F.col("doc_id"), F.col("text")))
    fake = pseudonyms.fake_value(SALT, F.col("key"), F.col("entity_type"), F.col("text"))
    return d.select("doc_id", "entity_type", F.regexp(fake, F.col("form")).alias("fits"))


_SEX = {"clara": "female", "dora": "female", "adam": "male", "hugo": "male"}


@query("""SELECT doc_id, name, CASE n WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS gender FROM (SELECT doc_id, CAST(doc_id % 4 AS INT) AS n,
 CASE doc_id % 4 WHEN 0 THEN 'Mrs. Clara ' WHEN 1 THEN 'HUGO ' WHEN 2 THEN 'Dora-Lee ' ELSE 'Prof Zed ' END || source AS name FROM documents)""")
def genders_of_names(spark, sf_dir):
    """Gender of the first given name that is no title, its first hyphen part, from a table."""
    first = F.element_at(F.array(*[F.lit(x) for x in ("Mrs. Clara ", "HUGO ", "Dora-Lee ", "Prof Zed ")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(first, "source").alias("name"))
    return d.withColumn("gender", pseudonyms.gender(F.col("name"), _SEX))


@query(f"WITH {_WORDS}, {_SPANS}, {_DICT} SELECT 'pattern' AS extractor, count(*) AS found FROM spans UNION ALL SELECT 'dictionary', count(*) FROM hit UNION ALL SELECT 'other', CAST(0 AS BIGINT)")
def named_extractors(spark, sf_dir):
    """Extractors by their names; a name that is none is an error, told as nothing found."""
    d, how = _documents(spark, sf_dir), {"dictionary": _dictionary(spark, sf_dir).withColumn("entity_type", F.lit("Sentence"))}
    out = None
    for name in ("pattern", "dictionary", "other"):
        try:
            found = jobs.extract_entities(d, name, **how)
        except ValueError:
            found = d.limit(0)
        one = found.agg(F.count("*").alias("found")).select(F.lit(name).alias("extractor"), "found")
        out = one if out is None else out.unionByName(one)
    return out


# Branches.


@query("""WITH b AS (SELECT * FROM (SELECT unnest(['clean', 'failed', 'weak']) AS batch), documents)
SELECT batch, CASE batch WHEN 'clean' THEN 'success' WHEN 'failed' THEN 'warning' ELSE 'info' END AS level, count(*) - count(*) FILTER (WHERE batch = 'failed' AND source = (SELECT min(source) FROM documents)) AS done, count(*) AS total FROM b GROUP BY 1""")
def banner_levels(spark, sf_dir):
    """Three batches of all documents: all masked, one source failed, one source masked in part."""
    d = table(spark, sf_dir, "documents")
    first = d.agg(F.min("source").alias("first"))
    d = d.join(F.broadcast(first), F.lit(True), "left").withColumn("own", F.col("source") == F.col("first"))
    out = None
    for batch, status, verdict in (("clean", "completed", "Excellent"), ("failed", "error", None), ("weak", "completed", "Review recommended")):
        r = d.select(F.when(F.col("own"), status).otherwise("completed").alias("status"), F.when(F.col("own"), F.lit(verdict).cast("string")).otherwise("No entities found").alias("verdict"))
        one = report.batch_banner(r).select(F.lit(batch).alias("batch"), "level", "done", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_WORDS}, g AS (SELECT doc_id, page_number, word_idx, CAST(word_idx % 10 AS DOUBLE) / 10 AS x, CAST(floor(word_idx / 10) AS DOUBLE) / 10 AS y, CASE WHEN length(text) > 9 THEN 0.09::DOUBLE ELSE -0.09::DOUBLE END AS w, 90 * (page_number % 4) AS rotation FROM words),
p AS (SELECT *, greatest(0, CAST(trunc(x * 600) AS INT) - 2) AS x0, greatest(0, CAST(trunc(y * 800) AS INT) - 2) AS y0, least(600, CAST(trunc((x + w) * 600) AS INT) + 2) AS x1, least(800, CAST(trunc((y + 0.05::DOUBLE) * 800) AS INT) + 2) AS y1 FROM g WHERE page_number % 5 <> 0)
SELECT doc_id, page_number, word_idx, x0, y0, x1, y1, round(CASE WHEN rotation = 180 THEN (x + w) * 600 - 2 ELSE x * 600 + 2 END, 4) AS origin_x, round(CASE WHEN rotation = 270 THEN y * 800 + 2 ELSE (y + 0.05::DOUBLE) * 800 - 2 END, 4) AS origin_y FROM p WHERE x1 > x0 AND y1 > y0""")
def turned_redaction_plan(spark, sf_dir):
    """Boxes of all words on turned pages; each fifth page isn't in its document, and boxes of short words reach back to nothing."""
    w = _words(spark, sf_dir).withColumn("w", F.when(F.length("text") > 9, 0.09).otherwise(-0.09))
    o = w.select("doc_id", "page_number", F.col("word_idx").alias("entity_id"), F.lit("").alias("replacement"), F.lit("Fake Data").alias("strategy"), F.array(F.array(F.col("bbox.x"), F.col("bbox.y"), F.col("w"), F.lit(0.05))).alias("bounding_boxes"))
    pages = w.where("page_number % 5 <> 0").select("doc_id", "page_number").distinct().select("*", F.lit(600).alias("width"), F.lit(800).alias("height"), (90 * (F.col("page_number") % 4)).alias("rotation"))
    plan = mask.redaction_plan(o, pages)
    return plan.select("doc_id", "page_number", F.col("entity_id").alias("word_idx"), "pixels.*", F.round("origin.x", 4).alias("origin_x"), F.round("origin.y", 4).alias("origin_y"))


# Streams over stored tables.


def _as_files(df, spark, name: str, parts: int = 4) -> str:
    folder = scratch(spark, name)
    df.repartition(parts).write.json(folder, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return folder


@query(f"WITH {_SPANS} SELECT * FROM spans")
def streamed_entities(spark, sf_dir):
    """Documents that arrive as files, each looked through once."""
    d = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), "text")
    out = scratch(spark, "streamed")
    q = streams.process_files(spark, _as_files(d, spark, "arrivals", max(4, d.rdd.getNumPartitions())), detect.detect, out, scratch(spark, "offsets"))
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("SELECT DISTINCT source AS filename FROM documents")
def streamed_first_names(spark, sf_dir):
    """File names on a stream, each the first time only; sources stand for names."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.timestamp_seconds(F.col("doc_id") % 3600).alias("at"))
    folder, out = _as_files(d, spark, "names"), scratch(spark, "first")
    s = spark.readStream.schema("filename string, at timestamp").json(folder)
    streams.first_arrivals(s).select("filename").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("filename string").parquet(out)


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS status, CAST(ts AS TIMESTAMP) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events)
SELECT session_id, status, seen FROM s WHERE n = 1""")
def streamed_states(spark, sf_dir):
    """The last state of each session after its events went through the stream, out of order in four files."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("ts").cast("timestamp").alias("at"))
    folder, out = _as_files(e, spark, "events"), scratch(spark, "states")
    s = spark.readStream.schema(streams.EVENTS).option("maxFilesPerTrigger", 1).json(folder)

    def keep(df, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = lifecycle.session_lifecycle(s, limit_seconds=10**9, expiry_hours=10**5, delay="3650 days").writeStream.foreachBatch(keep).outputMode("update")
    q.option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(f"{lifecycle.CHANGES}, batch int").parquet(out).where("change = 'state'")
    last = changes.groupBy("session_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "status")).alias("e"))
    return last.select("session_id", "e.status", F.col("e.at").cast("timestamp_ntz").alias("seen"))
