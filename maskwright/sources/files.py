"""Reading folders, configurations, OCR results and stored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import from_polygon
from ..functions.text import extension
from ..operators.validate import SCANNABLE

FIELD = "struct<name:string,description:string,strategy:string>"
OCR = "analyzeResult struct<pages:array<struct<pageNumber:int,width:double,height:double,words:array<struct<content:string,confidence:double,polygon:array<double>>>>>>"
OCCURRENCE = "struct<page_number:int,original_text:string,bounding_boxes:array<array<double>>>"
ENTITY = f"struct<id:string,entity_type:string,original_text:string,replacement_text:string,confidence:double,approved:boolean,strategy:string,occurrences:array<{OCCURRENCE}>>"

# The built-in template.
TEMPLATES = [
    ("common_pii", "Common PII", 0, "Full Name", "Patient or person's full name, including first and last name and any middle names", "Fake Data"),
    ("common_pii", "Common PII", 1, "Date of Birth", "Date of birth in any format (e.g., 01/01/1980, 1 January 1980, DOB: 01-01-1980)", "Fake Data"),
    ("common_pii", "Common PII", 2, "Medicare Number", "Australian Medicare card number, typically 10-11 digits, sometimes with a reference number suffix", "Black Out"),
    ("common_pii", "Common PII", 3, "Physical Address", "Full residential or mailing address including street number, street name, suburb, state, and postcode", "Fake Data"),
]


def list_folder(spark: SparkSession, path: str, extensions=SCANNABLE) -> DataFrame:
    """(path, filename, length, mtime) of the files of a folder with a supported extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    files = files.select("path", F.substring_index("path", "/", -1).alias("filename"), "length", F.col("modificationTime").alias("mtime"))
    return files.where(extension(F.col("filename")).isin(*extensions))


def original_files(listing: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first original.* of each session (session_id, name, ...), and the sessions that have none."""
    own = listing.where(F.col("name").startswith("original."))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("name"))).where("_n = 1").drop("_n")
    missing = sessions.select("session_id").join(first, "session_id", "left_anti").withColumn("error", F.lit("original file not found"))
    return first, missing


def parse_configs(texts: DataFrame) -> DataFrame:
    """Field definitions from (config_key, value): an object with field_definitions or a bare list; none at all gives one row with an error."""
    c = texts.select("config_key", F.coalesce(F.from_json("value", f"field_definitions array<{FIELD}>")["field_definitions"], F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{FIELD}>"))).alias("f"))
    c = c.select("config_key", F.posexplode_outer("f").alias("pos", "d"))
    return c.select("config_key", "pos", "d.name", "d.description", "d.strategy", F.when(F.col("pos").isNull(), "no field definitions").alias("error"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("config_key"), "value")
    return parse_configs(texts)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "key string, template_name string, pos int, name string, description string, strategy string")


def template_summary(templates: DataFrame) -> DataFrame:
    return templates.groupBy("key", "template_name").agg(F.count("*").alias("field_count"))


def ocr_words(results: DataFrame) -> DataFrame:
    """Words (doc_id, page_number, word_idx, text, confidence, box) of OCR results (doc_id, analyzeResult), boxes relative to the page."""
    # The outer forms: before the others Spark puts filters that read all results again.
    p = results.select("doc_id", F.posexplode_outer("analyzeResult.pages").alias("i", "p")).where("i is not null")
    # Fields one by one: a page struct would be copied whole beside each of its words.
    p = p.select("doc_id", F.coalesce("p.pageNumber", F.col("i") + 1).alias("page_number"), "p.width", "p.height", "p.words")
    w = p.select("doc_id", "page_number", "width", "height", F.posexplode_outer("words").alias("word_idx", "w")).where("word_idx is not null")
    w = w.select("doc_id", "page_number", "word_idx", F.col("w.content").alias("text"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), "width", "height", from_polygon(F.col("w.polygon")).alias("b"))
    box = F.array(*[F.get("b", i) / F.nullif(F.col(c), F.lit(0.0)) for i, c in enumerate(("width", "height", "width", "height"))])
    return w.select("doc_id", "page_number", "word_idx", "text", "confidence", box.alias("box"))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return ocr_words(spark.read.schema(OCR).option("multiLine", "true").json(path).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))


def stored_entities(texts: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of stored files (session_id, value), and errors: a missing file and malformed JSON are told apart."""
    parsed = texts.select("session_id", F.from_json("value", f"entities array<{ENTITY}>")["entities"].alias("e"))
    good = parsed.where("e is not null").select("session_id", F.posexplode("e").alias("ent_idx", "e")).select("session_id", "ent_idx", "e.*")
    bad = parsed.where("e is null").select("session_id", F.lit("malformed entities").alias("error"))
    none = sessions.select("session_id").join(texts, "session_id", "left_anti").select("session_id", F.lit("entities not found").alias("error"))
    return good, bad.unionByName(none)


def session_metadata(texts: DataFrame) -> DataFrame:
    m = F.from_json("value", "original_filename string, created_at string, status string, file_size long, page_count int")
    t = texts.select("session_id", m.alias("m"))
    return t.select("session_id", "m.original_filename", F.try_to_timestamp("m.created_at").alias("created_at"), F.coalesce("m.status", F.lit("uploaded")).alias("status"), F.coalesce("m.file_size", F.lit(0)).cast("long").alias("file_size"), F.coalesce("m.page_count", F.lit(1)).alias("page_count"))
