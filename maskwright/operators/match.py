"""Locating entity texts in word sequences, by equality of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import merge_lines
from ..functions.text import SPACE, match_form, once, tokens
from ..session import is_small


def match_dictionary(words: DataFrame, dictionary: DataFrame, *, text_col: str = "entity_text", keys=("doc_id", "page_number"), by: tuple[str, ...] = (), bbox: str | None = None) -> DataFrame:
    """Every place where a dictionary text stands: keys, word_idx, n, gram, the dictionary's columns and boxes.

    `by` names columns (as doc_id) that bind an entry to a document or page. A
    page is one array of words. Its places meet the entries by their first word and
    the one behind it, and what is left is compared with the page's slice, so
    entries may be of any length and no windows are made. The dictionary is
    broadcast while it is small. `words` are single words, or pages of
    documents.paged_words, which stay where they are while it is.
    """
    own = [c for c in dictionary.columns if c not in by]
    d = dictionary.select(*own, *[F.col(c).alias(f"_by_{c}") for c in by], tokens(F.col(text_col)).alias("_w"))
    d = d.select("*", F.size("_w").alias("n"), F.array_join("_w", " ").alias("gram"), F.get("_w", 0).alias("_first"), F.get("_w", 1).alias("_second")).where("n > 0")
    pages = words
    if "page_words" not in words.columns:
        pages = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", *([F.col(bbox).alias("bbox")] if bbox else [])))).alias("page_words"))
    word = lambda form: lambda x: F.struct(x["word_idx"].alias("word_idx"), form(x["text"]).alias("t"), *([x["bbox"].alias("b")] if bbox else []))
    # Words without white space inside, most pages have no others, are their match form in lower case.
    odd = F.array_join(F.transform("page_words", lambda x: x["text"]), "").rlike(SPACE)
    pages = pages.select(*keys, F.when(odd, F.transform("page_words", word(match_form))).otherwise(F.transform("page_words", word(F.lower))).alias("_p"))
    place = lambda p: F.transform(p, lambda x, i: F.struct(x["word_idx"].alias("word_idx"), x["t"].alias("t"), F.get(p, i + 1)["t"].alias("next")))
    small = is_small(d)
    # Where the entries come to the pages, a page goes along with its places, which costs no move; else it waits for those that are left.
    along = ["_p"] if small else []
    # Places are a column before they are rows: the generator then runs in generated code, which copies no page for each place.
    placed = pages.select(*keys, *along, once(F.col("_p"), place).alias("_places"))
    places = placed.select(*keys, *along, F.posexplode_outer("_places").alias("_i", "_x")).where("_i is not null")
    meets = (F.col("_x.t") == F.col("_first")) & ((F.col("n") == 1) | (F.col("_x.next") == F.col("_second")))
    for c in by:
        meets = meets & (F.col(c) == F.col(f"_by_{c}"))
    found = places.join(F.broadcast(d), meets) if small else places.join(d, meets).join(pages, list(keys))
    part = F.slice("_p", F.col("_i") + 1, F.col("n"))
    # Without a lambda, as this becomes part of the join's condition, which is to stay in generated code.
    found = found.where(part["t"] == F.col("_w"))
    boxes = [F.transform(part, lambda x: x["b"]).alias("boxes")] if bbox else []
    return found.select(*keys, F.col("_x.word_idx").alias("word_idx"), "n", "gram", *[F.col(f"`{c}`") for c in own if c not in keys], *boxes)


def entity_boxes(words: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the line boxes of all their matches in their own document; [] without a match."""
    hits = match_dictionary(words, entities.select("doc_id", "entity_id", "original_text"), text_col="original_text", by=("doc_id",), bbox="bbox")
    boxes = hits.select("doc_id", "entity_id", F.struct("page_number", "word_idx", merge_lines(F.transform("boxes", lambda b: F.array(b["x"], b["y"], b["width"], b["height"]))).alias("bounding_boxes")).alias("m"))
    grouped = boxes.groupBy("doc_id", "entity_id").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    out = entities.join(grouped, ["doc_id", "entity_id"], "left")
    return out.withColumn("matches", F.coalesce("matches", F.array().cast(grouped.schema["matches"].dataType)))


def matched_share(with_matches: DataFrame) -> DataFrame:
    return with_matches.agg(F.count_if(F.size("matches") > 0).alias("matched"), F.count("*").alias("total"))
