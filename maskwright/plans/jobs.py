"""The whole job: documents to entities, entities to masked text, masked text to scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import lots
from ..operators import automaton, detect, enrich, mask, merge, replace, review, tagger, verify
from ..session import settled
from ..sources import responses, sinks

#: What a plug-in extractor returns for each document.
EXTRACTED = "doc_id long, entity_type string, original_text string, start int, length int, error string"


def by_pattern(documents: DataFrame, **_) -> DataFrame:
    return detect.detect(documents)


def by_dictionary(documents: DataFrame, *, dictionary: DataFrame, **_) -> DataFrame:
    """Dictionary texts (entity_type, entity_text) as spans of words: start and length count words."""
    hits = automaton.match_texts(documents, dictionary)
    return hits.select("doc_id", "page_number", "entity_type", F.col("gram").alias("original_text"), F.col("word_idx").alias("start"), F.col("n").alias("length"))


def by_response(documents: DataFrame, *, model_responses: DataFrame, mode: str = "failfast", **_) -> DataFrame:
    return responses.parse_responses(model_responses, mode)[0]


def by_tagger(documents: DataFrame, *, model: tagger.Tagger, **_) -> DataFrame:
    """Names, addresses and birth dates by context; what is no name or address by itself goes."""
    return detect.credible(tagger.tag_documents(documents, model))


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"pattern": by_pattern, "dictionary": by_dictionary, "llm_response": by_response, "tagger": by_tagger}


def extract_entities(documents: DataFrame, extractor: str = "pattern", **how) -> DataFrame:
    """Entities or spans of documents (doc_id, text), by the extractor of that name."""
    if extractor not in EXTRACTORS:
        raise ValueError(f"extractor is one of {sorted(EXTRACTORS)}, not {extractor!r}")
    return EXTRACTORS[extractor](documents, **how)


def extract_with(documents: DataFrame, find: Callable[[str], list[tuple[str, str, int, int]]]) -> DataFrame:
    """Spans by a user's Python function of one text; a text on which it fails becomes a row with the error."""

    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = ["doc_id", "entity_type", "original_text", "start", "length", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, 1):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(doc_id, *x, None) for x in find(text or "")]
                except Exception as e:  # noqa: BLE001
                    rows.append((doc_id, None, None, None, None, str(e)[:500]))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, EXTRACTED)


def mask_documents(documents: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """documents with masked_text: each span takes the replacement of its entity (doc_id, entity_type, original_text, replacement)."""
    e = entities.select("doc_id", "entity_type", F.lower("original_text").alias("_key"), "replacement")
    s = spans.withColumn("_key", F.lower("original_text")).join(e, ["doc_id", "entity_type", "_key"])
    return mask.masked_documents(documents, s)


def verify_documents(documents: DataFrame, spans: DataFrame, masked: DataFrame) -> DataFrame:
    """Scores and verdicts of documents, from their spans and masked texts."""
    occurrences = spans.select("doc_id", F.lit(1).alias("page_number"), "original_text")
    pages = masked.select("doc_id", F.lit(1).alias("page_number"), "masked_text")
    return verify.score(documents, verify.check_occurrences(occurrences, pages))


def merged_replacements(entities: DataFrame, salt: str) -> DataFrame:
    """entities with root_idx and replacement: variants of one text take the part of their root's replacement that they are a part of."""
    placed = entities.join(merge.variant_roots(entities), ["doc_id", "entity_type", "ent_idx"])
    roots = enrich.with_replacements(enrich.with_labels(enrich.with_fakes(placed.where("ent_idx = root_idx"), salt)))
    roots = roots.select("doc_id", "entity_type", "root_idx", F.col("original_text").alias("_root"), F.col("replacement_text").alias("_whole"))
    out = placed.join(roots, ["doc_id", "entity_type", "root_idx"])
    part = replace.occurrence_replacement(F.col("_root"), F.col("_whole"), F.col("original_text"))
    kind = enrich.strategy_of(F.col("strategy"))
    return out.withColumn("replacement", F.when((kind == "fake_name") & (F.col("ent_idx") != F.col("root_idx")), part).otherwise(F.col("_whole"))).drop("_root", "_whole")


def deidentify(documents: DataFrame, *, salt: str, strategies: dict[str, str] | None = None, patterns=detect.PATTERNS, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, masked documents, verification) of documents (doc_id, text).

    `found` adds spans (doc_id, entity_type, original_text, start, length) of other
    extractors, as names and addresses; what is no name or address by itself goes.
    """
    spans = detect.detect(documents, patterns=patterns)
    if found is not None:
        spans = spans.unionByName(detect.credible(found.select(*spans.columns)))
    # Entities, masking and verification each read them.
    spans = settled(spans, "spans")
    entities = settled(merged_replacements(settled(detect.entities_from_spans(spans, strategies), "entities"), salt), "replacements")
    masked = mask_documents(documents, spans, entities)
    return entities, masked, verify_documents(documents, spans, masked)


def approve_and_mask(documents: DataFrame, spans: DataFrame, entities: DataFrame, approvals: DataFrame, edits: DataFrame, *, decided_at: Column, decisions_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(decisions, masked documents, verification, errors) of reviewed entities (doc_id, entity_id, entity_type, original_text, strategy, replacement_text, ent_idx).

    The decisions are written before anything is masked; if that fails, nothing
    is. Edits speak over stored replacements; only approved entities are masked and
    looked for afterwards; documents without any are errors and stay as they are.
    """
    edited = review.with_edits(entities, edits)
    decided = review.decisions(edited, approvals, decided_at)
    if decisions_path:
        sinks.write_decisions(decided.select("doc_id", "entity_id", "approved", "decided_at"), decisions_path)
    chosen = replace.entity_replacement(review.selected(edited, approvals))
    key = chosen.select("doc_id", "entity_type", F.lower("original_text").alias("_key"))
    approved = spans.withColumn("_key", F.lower("original_text")).join(key, ["doc_id", "entity_type", "_key"], "left_semi").drop("_key")
    masked = mask_documents(documents, approved, chosen)
    return decided, masked, verify_documents(documents, approved, masked), review.without_approval(entities, approvals)
