"""A model's responses in and its prompts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import merge_lines, rounded, valid
from ..functions.text import once, strip, without_fence

PAGE_CHARACTERS = 3000
ANY_BOX = "struct<x:double,y:double,width:double,height:double>"
#: A box is an array or an object: both are read as text first.
RAW_ENTITY = "array<struct<entity_type:string,original_text:string,confidence:double,occurrences:array<struct<page_number:int,original_text:string,bounding_boxes:array<string>>>>>"
ENVELOPE_ENTITY = "struct<id:string,entity_type:string,original_text:string,replacement_text:string,confidence:double,approved:boolean,strategy:string,occurrences:array<struct<page_number:int,original_text:string,bounding_boxes:array<array<double>>>>>"
BODY = f"session_id:string,status:string,error_message:string,entities:array<{ENVELOPE_ENTITY}>,pages:array<struct<page_number:int,entities:array<{ENVELOPE_ENTITY}>>>"
ENVELOPE = f"struct<predictions:array<struct<{BODY}>>,dataframe_records:array<struct<{BODY}>>,{BODY}>"


def _box(text: Column) -> Column:
    as_object = F.from_json(text, ANY_BOX)
    listed = F.from_json(text, "array<double>")
    return F.coalesce(listed, F.when(F.startswith(F.ltrim(text), F.lit("{")), F.array(as_object["x"], as_object["y"], as_object["width"], as_object["height"])))


def parse_responses(responses: DataFrame, mode: str = "failfast") -> tuple[DataFrame, DataFrame]:
    """Entities and errors of (doc_id, page_number, response_text).

    The text may stand in a code fence. Entities need a type, a text and an
    occurrence with a valid box; boxes of one line are joined; an occurrence
    without its own text has the entity's; confidence is 0.9 if not given. With
    mode "failfast" a page that can't be read is an error of its document and
    none of the document's entities are returned; with "skip_page" only the page
    is left out.
    """
    if mode not in ("failfast", "skip_page"):
        raise ValueError(f"mode is 'failfast' or 'skip_page', not {mode!r}")
    r = responses.withColumn("e", F.from_json(without_fence(F.col("response_text")), RAW_ENTITY, {"mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | ~F.startswith(without_fence(F.col("response_text")), F.lit("["))
    errors = r.where(bad).select("doc_id", "page_number", F.lit("response is no JSON list").alias("error"))
    good = r.where(~bad)
    if mode == "failfast":
        good = good.join(errors.select("doc_id").distinct(), "doc_id", "left_anti")
    x = good.select("doc_id", "page_number", F.posexplode("e").alias("pos", "e"))
    text = F.coalesce(strip(F.col("e.original_text")), F.lit(""))

    def occurrence(o):
        boxes = F.filter(F.transform(o["bounding_boxes"], _box), valid)
        return F.struct(F.coalesce(o["page_number"], F.col("page_number")).alias("page_number"), F.coalesce(F.nullif(o["original_text"], F.lit("")), F.col("e.original_text")).alias("original_text"), merge_lines(boxes).alias("bounding_boxes"))

    occs = F.filter(F.transform("e.occurrences", occurrence), lambda o: F.size(o["bounding_boxes"]) > 0)
    x = x.select("doc_id", "page_number", "pos", F.col("e.entity_type").alias("entity_type"), F.col("e.original_text").alias("original_text"), F.coalesce("e.confidence", F.lit(0.9)).alias("confidence"), occs.alias("occurrences"), text.alias("_text"))
    x = x.where((F.coalesce(strip(F.col("entity_type")), F.lit("")) != "") & (F.col("_text") != "") & (F.size("occurrences") > 0)).drop("_text")
    return x, errors


def parse_envelopes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and errors of serving responses (doc_id, response): predictions, records or a bare body; entities, else those of the pages."""
    body = F.from_json("response", ENVELOPE)
    # Text that is no object reads as an object without values.
    r = raw.select("doc_id", F.when(F.startswith(F.ltrim("response"), F.lit("{")), body).alias("b"))
    names = ("session_id", "status", "error_message", "entities", "pages")
    bare = F.struct(*[F.col(f"b.{c}").alias(c) for c in names])
    r = r.select("doc_id", F.coalesce(F.get("b.predictions", 0), F.get("b.dataframe_records", 0), F.when(F.col("b").isNotNull(), bare)).alias("b"))
    failed = F.col("b").isNull() | (F.coalesce("b.status", F.lit("")) == "error")
    errors = r.where(failed).select("doc_id", F.coalesce("b.error_message", F.lit("Unknown error")).alias("error"))
    every = F.coalesce("b.entities", F.flatten(F.transform("b.pages", lambda p: p["entities"])))
    good = r.where(~failed).select("doc_id", F.posexplode(every).alias("ent_idx", "e")).select("doc_id", "ent_idx", "e.*")
    return good, errors


def page_contexts(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_number, context): compact JSON of a page for a prompt: text, word count and words with rounded boxes."""
    w = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "bbox"))).alias("page_words"))
    return pages.join(w, ["doc_id", "page_number"], "left").select("doc_id", "page_number", page_context(F.col("text"), F.col("page_words")).alias("context"))


def page_context(text: Column, page_words: Column) -> Column:
    """The context of a page of documents.paged_words and its text."""
    usable = F.filter(page_words, lambda x: (F.coalesce(strip(x["text"]), F.lit("")) != "") & x["bbox"].isNotNull())
    box = lambda b: rounded(F.array(b["x"], b["y"], b["width"], b["height"]))
    listed = F.transform(usable, lambda x: F.struct(x["text"].alias("t"), box(x["bbox"]).alias("b")))
    listed = F.coalesce(listed, F.array().cast("array<struct<t:string,b:array<double>>>"))
    return once(listed, lambda w: F.to_json(F.struct(F.substring(text, 1, PAGE_CHARACTERS).alias("text"), F.size(w).alias("word_count"), w.alias("words"))))


def field_list(field_defs: DataFrame) -> DataFrame:
    """(config_key, fields): one line of name and description for each definition, in order."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("description"))
    return field_defs.groupBy("config_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("fields"))
