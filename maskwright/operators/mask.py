"""Masked text, by spans or by words, and the plan of rectangles to paint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import font_size, text_origin, to_pixels
from ..functions.text import once
from .enrich import strategy_of


def mask_spans(text: Column, spans: Column) -> Column:
    """Text with each span (start, length, replacement) replaced; inserted text is not looked at again.

    Spans go by start, longer first. A span inside an earlier one is dropped; one
    that begins inside and ends behind it stretches the masked range.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["length"]).cast("int").alias("size"), s["replacement"].alias("replacement"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        end = s["start"] - s["size"]
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.coalesce(s["replacement"], F.lit("")))
        return F.struct(F.greatest(end, acc["at"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, none, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1, F.length(text)))).otherwise(text)


def masked_documents(texts: DataFrame, spans: DataFrame, *, keys=("doc_id",), text_col: str = "text") -> DataFrame:
    """texts with masked_text, from spans (keys, start, length, replacement); texts without spans stay as they are."""
    by = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "length", "replacement")).alias("_spans"))
    out = texts.join(by, list(keys), "left")
    empty = F.array().cast(by.schema["_spans"].dataType)
    return out.withColumn("masked_text", mask_spans(F.col(text_col), F.coalesce("_spans", empty))).drop("_spans")


def masked_in_place(texts: DataFrame, spans: Column, replacement: Callable[[Column], Column], *, text_col: str = "text") -> DataFrame:
    """texts with `spans` (an array beside the text, as detect.spans_in gives) and masked_text, in one projection: no row moves.

    `replacement` makes the new text of a span; rows that repeat a document are masked each by itself.
    """
    found = texts.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<entity_type:string,original_text:string,start:int,length:int>>")))
    new = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), replacement(s).alias("replacement")))
    return found.withColumn("masked_text", mask_spans(F.col(text_col), new))


def mask_words(words: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, page_number, masked_text): words that hits (doc_id, page_number, word_idx, n, replacement) cover become the replacement.

    `words` are single words or pages of documents.paged_words. Of overlapping hits the one that starts first, then the longest, speaks; covered words never survive.
    """
    covered = hits.select("doc_id", "page_number", F.col("word_idx").alias("from"), "n", "replacement", F.explode(F.sequence(F.col("word_idx"), F.col("word_idx") + F.col("n") - 1)).alias("word_idx"))
    first = covered.groupBy("doc_id", "page_number", "word_idx").agg(F.min(F.struct(F.col("from"), (-F.col("n")).alias("size"), "replacement")).alias("hit"))
    if "page_words" in words.columns:
        # A page's hits come to it in one row; of its words only those covered are not its own.
        by = first.groupBy("doc_id", "page_number").agg(F.map_from_entries(F.collect_list(F.struct("word_idx", "hit"))).alias("_hits"))
        piece = lambda x: once(F.try_element_at("_hits", x["word_idx"]), lambda h: F.when(h.isNull(), x["text"]).when(h["from"] == x["word_idx"], h["replacement"]))
        page = words.join(by, ["doc_id", "page_number"], "left")
        pieces = F.when(F.col("_hits").isNull(), F.transform("page_words", lambda x: x["text"])).otherwise(F.transform("page_words", piece))
        kept = F.filter(pieces, lambda x: x.isNotNull() & (x != ""))
        return page.select("doc_id", "page_number", F.array_join(kept, " ").alias("masked_text"))
    w = words.join(first, ["doc_id", "page_number", "word_idx"], "left")
    piece = F.when(F.col("hit").isNull(), F.col("text")).when(F.col("hit.from") == F.col("word_idx"), F.col("hit.replacement"))
    page = w.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("word_idx", piece.alias("piece")))).alias("p"))
    kept = F.filter(F.transform("p", lambda x: x["piece"]), lambda x: x.isNotNull() & (x != ""))
    return page.select("doc_id", "page_number", F.array_join(kept, " ").alias("masked_text"))


def redaction_plan(occurrences: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each rectangle to paint: occurrences with boxes on pages (doc_id, page_number, width, height, rotation).

    Pages outside the document and rectangles without area are left out. A
    document's rows stand together, in the order of its pages.
    """
    # The outer form asks for no filter that makes the boxes again.
    o = occurrences.select("*", F.explode_outer("bounding_boxes").alias("box")).where("box is not null").join(pages, ["doc_id", "page_number"])
    o = o.withColumn("pixels", to_pixels(F.col("box"), F.col("width"), F.col("height")))
    o = o.where((F.col("pixels.x1") > F.col("pixels.x0")) & (F.col("pixels.y1") > F.col("pixels.y0")))
    fill = F.when(strategy_of(F.col("strategy")) == "redact", "black").otherwise("white")
    x0, y0, x1, y1 = (F.col("box")[0] * F.col("width"), F.col("box")[1] * F.col("height"), (F.col("box")[0] + F.col("box")[2]) * F.col("width"), (F.col("box")[1] + F.col("box")[3]) * F.col("height"))
    plan = o.withColumns({"fill": fill, "font_size": font_size(F.col("box")[3] * F.col("height")), "origin": text_origin(F.coalesce("rotation", F.lit(0)), x0, y0, x1, y1)})
    return plan.select("doc_id", "page_number", "entity_id", "replacement", "fill", "font_size", "pixels", "origin").repartition("doc_id").sortWithinPartitions("doc_id", "page_number")
