"""Extraction and masking as table functions that SQL can call, over Arrow batches.

    SELECT * FROM extract_entities(TABLE(documents))
    SELECT * FROM mask_spans(TABLE(spans) PARTITION BY doc_id ORDER BY start)

The first takes whole batches of texts (doc_id, text); the second gets one document's
rows (doc_id, text, start, length, replacement) together, its text on one of them at
least: a text beside each of its spans would be sent as often as it has spans. A text
on which the work fails is a row with the error and costs no other text.

Defined results: a null text has no spans and stays null; spans are masked from left
to right, longer ones first, and one that begins inside an earlier one stretches it;
spans outside the text are an error of their document; repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.detect import PATTERNS

FOUND = "doc_id long, entity_type string, original_text string, start int, length int, error string"
MASKED = "doc_id long, masked_text string, n_spans int, error string"


def _table(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.table({name: pa.array(c, t) for c, (name, t) in zip(columns, types)})


def find_entities(text: str | None) -> list[tuple[str, str, int, int]]:
    """(entity_type, original_text, start, length) of all patterns, as in the expressions of `detect`: letters of any script end no word."""
    found = []
    for kind, pattern in PATTERNS.items():
        found += [(kind, m[0], m.start(), m.end() - m.start()) for m in re.finditer(pattern, text or "")]
    return found


def masked(text: str | None, spans: list[tuple[int, int, str | None]]) -> str | None:
    """text with spans (start, length, replacement) replaced."""
    if text is None:
        return None
    out, at = [], 0
    for start, length, new in sorted(spans, key=lambda s: (s[0], -s[1], s[2] or "")):
        if start < 0 or length < 0 or start + length > len(text):
            raise ValueError(f"span {start}+{length} is outside the text")
        if start >= at:
            out += [text[at:start], new or ""]
        at = max(at, start + length)
    return "".join(out) + text[at:]


@arrow_udtf(returnType=FOUND)
class ExtractEntities:
    def eval(self, documents: pa.RecordBatch) -> Iterator[pa.Table]:
        rows: list[tuple] = []
        for doc_id, text in zip(documents.column("doc_id").to_pylist(), documents.column("text").to_pylist()):
            try:
                rows += [(doc_id, *found, None) for found in find_entities(text)]
            except Exception as e:  # noqa: BLE001
                rows.append((doc_id, None, None, None, None, str(e)[:500]))
        yield _table(rows, [("doc_id", pa.int64()), ("entity_type", pa.string()), ("original_text", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("error", pa.string())])


@arrow_udtf(returnType=MASKED)
class MaskSpans:
    """The rows of one document, which may come in several batches."""

    def __init__(self) -> None:
        self.key, self.text, self.spans = None, None, []

    def eval(self, spans: pa.RecordBatch) -> Iterator[pa.Table]:
        if spans.num_rows:
            self.key = spans.column("doc_id")[0].as_py()
            texts = spans.column("text").drop_null() if self.text is None else ()
            if len(texts):
                self.text = texts[0].as_py()
            self.spans += [s for s in zip(*(spans.column(c).to_pylist() for c in ("start", "length", "replacement"))) if s[0] is not None]
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        try:
            row = (self.key, masked(self.text, self.spans), len(self.spans), None)
        except Exception as e:  # noqa: BLE001
            row = (self.key, None, len(self.spans), str(e)[:500])
        yield _table([row], [("doc_id", pa.int64()), ("masked_text", pa.string()), ("n_spans", pa.int32()), ("error", pa.string())])


def register(spark: SparkSession) -> None:
    """Makes extract_entities and mask_spans known to SQL in this session."""
    spark.udtf.register("extract_entities", ExtractEntities)
    spark.udtf.register("mask_spans", MaskSpans)
