"""Benchmark decontamination by exact word windows.

Benchmark items are cut into windows of `n` consecutive normalised words; an
item with fewer words, but not none, is one window. The hashes of all windows
go to the tasks as a broadcast set; every document's windows are looked up in
it, and each hit is verified word by word. Hit words are those inside any
occurrence of a window; documents or only the hit spans can then be removed.

The benchmark is measured first. Up to `broadcast_bytes` of text its windows are
broadcast, as arrays that a worker unpacks once. A larger one isn't: a filter of
bounded size tells which windows of a text may be in it, and these alone, with
their words, meet the benchmark's in a join; hits come back to their documents by
the hash of the text. Either way the texts are scanned once for windows.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
Defined results: null or wordless text has no words and no hits; benchmark rows
with a null id or no word are ignored, repeated ones count once by id; repeated
document rows are separate; empty tables on either side give no hits; other
columns pass through, and result columns step aside for columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import UPPER, free_name, if_small, join_by_key, settle, with_fields
from .shared import Shared, shared_values, sum_of_sizes

WINDOW = 10
BROADCAST_BYTES = 16 << 20
_BITS = 22


def _item_windows(t: K.Tokens, rows: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window size that items have: the windows' hashes, and the tokens that they begin with."""
    size = np.minimum(K.per_row(t.row, rows), n)
    for s in np.unique(size[size > 0]).tolist():
        h, at = K.windows(t.hash, t.row, s)
        own = size[t.row[at]] == s
        yield s, h[own], at[own]


class _Windows:
    """Windows of benchmark items: by size, sorted hashes with the first token and the item of each; and all tokens' bytes."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.items = [i for i, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        data, start, end, tokens = [], [], [], 0
        shift = 0
        for b in K.blocks(pa.array([t for _, t in items], pa.string())):
            t = K.tokens(b, K.ALNUM)
            for s, h, at in _item_windows(t, b.rows, n):
                found.setdefault(s, []).append((h, at + tokens, t.row[at] + b.first))
            data.append(K.LOWER[b.data])
            start.append(t.start + shift)
            end.append(t.end + shift)
            tokens, shift = tokens + len(t.start), shift + len(b.data)
        self.text = np.concatenate(data).tobytes() if data else b""
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, end))
        self.tables, self.maps = {}, {}
        for s, parts in found.items():
            h, at, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.tables[s] = (h[order], at[order].astype(np.int32), item[order].astype(np.int32))
            self.maps[s] = bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True

    def hits(self, t: K.Tokens, low: bytes) -> Iterator[tuple[int, int, list[str]]]:
        """(first token, size, items) of the windows of a block that stand in items, word by word."""
        for size, (hashes, first, item) in self.tables.items():
            h, at = K.windows(t.hash, t.row, size)
            may = np.flatnonzero(self.maps[size][h >> np.uint64(64 - _BITS)])
            i, k = np.searchsorted(hashes, h[may]), np.searchsorted(hashes, h[may], "right")
            for j, i, k in zip(may[i < k].tolist(), i[i < k].tolist(), k[i < k].tolist()):
                words = [low[s:e] for s, e in zip(t.start[at[j] : at[j] + size], t.end[at[j] : at[j] + size])]
                same = [w for w in range(i, k) if words == [self.text[s:e] for s, e in zip(self.start[first[w] : first[w] + size], self.end[first[w] : first[w] + size])]]
                if same:
                    yield int(at[j]), size, sorted({self.items[item[w]] for w in same})


def _scan(windows: _Windows | None, text_at: int, prior: bool, cut: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        words = np.zeros(n, np.int64)
        ranges: list[list[int]] = [[]] * n
        items: list[list[str]] = [[]] * n
        cleaned: dict[int, str] = {}
        had = {}
        if prior:
            had = {i: (r, x) for i, (r, x) in enumerate(zip(batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist())) if r}
        for b in K.blocks(batch.column(text_at)):
            t = K.tokens(b, K.ALNUM)
            words[b.first : b.first + b.rows] = K.per_row(t.row, b.rows)
            first = np.searchsorted(t.row, np.arange(b.rows + 1))
            hits: dict[int, list] = {}
            for i, size, ids in windows.hits(t, K.LOWER[b.data].tobytes()) if windows else ():
                hits.setdefault(int(t.row[i]), []).append((i, i + size, ids))
            for r in {*hits, *(i - b.first for i in had if b.first <= i < b.first + b.rows)}:
                old, old_items = had.get(b.first + r, ([], []))
                base = int(first[r])
                spans = [(i - base, j - base) for i, j, _ in hits.get(r, [])] + list(zip(old[::2], old[1::2]))
                merged: list[list[int]] = []
                for i, j in sorted(spans):
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(j, merged[-1][1])
                    else:
                        merged.append([i, j])
                ranges[b.first + r] = [x for m in merged for x in m]
                items[b.first + r] = sorted({*old_items, *(x for _, _, ids in hits.get(r, []) for x in ids)})
                if cut:
                    raw, parts, at_byte = b.data.tobytes(), [], int(b.offs[r])
                    for i, j in merged:
                        parts.append(raw[at_byte : t.start[base + i]])
                        at_byte = int(t.end[base + j - 1])
                    cleaned[b.first + r] = (b"".join(parts) + raw[at_byte : int(b.offs[r + 1])]).decode()
        kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("_words", "_ranges", "_items")}
        arrays = list(kept.values())
        if cut and cleaned:
            texts = batch.column(text_at).to_pylist()
            for i, s in cleaned.items():
                texts[i] = s
            arrays[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        arrays += [pa.array(words), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "_words", "_ranges", "_items"])


def _grams(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, hash, gram): the windows of items, with their words."""
    for batch in batches:
        for b in K.blocks(batch.column(1)):
            t, low = K.tokens(b, K.ALNUM), K.LOWER[b.data].tobytes()
            for s, h, at in _item_windows(t, b.rows, n):
                gram = [b" ".join(low[x:y] for x, y in zip(t.start[i : i + s], t.end[i : i + s])).decode() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t.row[at] + b.first)), pa.array(K.signed(h)), pa.array(gram, pa.string())], names=["item", "hash", "gram"])


def _asked(held, sizes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copy, at, size, gram): the windows of texts that the filter lets pass."""
    shared: Shared = held.value
    for batch in batches:
        for b in K.blocks(batch.column(1)):
            t, low = K.tokens(b, K.ALNUM), K.LOWER[b.data].tobytes()
            first = np.searchsorted(t.row, np.arange(b.rows))
            for s in sizes:
                h, at = K.windows(t.hash, t.row, s)
                at = at[shared.keeps(h)]
                gram = [b" ".join(low[x:y] for x, y in zip(t.start[i : i + s], t.end[i : i + s])).decode() for i in at.tolist()]
                row = t.row[at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + b.first)), pa.array(at - first[row]), pa.array(np.full(len(at), s)), pa.array(gram, pa.string())], names=["copy", "at", "size", "gram"])


def _joined(docs: DataFrame, items: DataFrame, text_col: str, n: int) -> DataFrame:
    """docs with _ranges and _items, for a benchmark of any size."""
    windows = settle(items.mapInArrow(lambda it: _grams(n, it), "item string, hash long, gram string"), "windows")
    sizes = sorted(r[0] for r in windows.select(F.size(F.split("gram", " "))).distinct().collect())
    # All values pass that stand in the benchmark: each is given two nodes.
    both = windows.select(F.array("hash").alias("hash"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("node"))
    held = docs.sparkSession.sparkContext.broadcast(shared_values(both, "node", "hash", sum_of_sizes(both, "hash")))
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("text"))
    asked = settle(texts.mapInArrow(lambda it: _asked(held, sizes, it), "copy long, at long, size long, gram string").distinct(), "asked")
    grams = windows.groupBy("gram").agg(F.collect_set("item").alias("items")).join(asked.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    found = join_by_key(asked, settle(grams, "grams"), "gram", asked.count())
    span = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))))
    hits = found.groupBy("copy").agg(F.flatten(F.transform(span, lambda x: F.array(x["at"], x["end"]))).alias("_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    hits = if_small(settle(hits.withColumnRenamed("copy", "_copy_of"), "hits"))
    out = docs.join(hits, F.xxhash64(docs[text_col]) == hits["_copy_of"], "left")
    return out.select(*[docs[f"`{c}`"] for c in docs.columns], F.lit(0).cast("long").alias("_words"), "_ranges", "_items")


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, cut: bool = False) -> DataFrame:
    """docs with _words (count), _ranges (hit words as start, end, ...) and _items; with `cut`, hit spans leave the text."""
    for c in docs.columns:
        if c.lower() in ("_words", "_ranges", "_items"):
            docs = docs.withColumnRenamed(c, free_name(docs, f"{c}_doc"))
    b = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0))).first()[0]
    schema = with_fields(docs.schema, "_words long, _ranges array<long>, _items array<string>")
    text_at = docs.columns.index(text_col)
    if size > broadcast_bytes:
        return _joined(docs, b, text_col, n).mapInArrow(lambda it: _scan(None, text_at, True, cut, it), schema)
    held = docs.sparkSession.sparkContext.broadcast(_Windows([(r.i, r.t) for r in b.orderBy("i", "t").collect()], n))
    return docs.mapInArrow(lambda it: _scan(held.value, text_at, False, cut, it), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **how) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the contaminated spans."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    out = scan(docs, benchmark, cut=remove == "spans", **how)
    if remove == "documents":
        out = out.where(F.size("_ranges") == 0)
    names = [c for c in out.columns if c not in ("_words", "_ranges", "_items")]
    return out.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(names, docs.columns)])


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    out = scan(docs.select("doc_id", "text"), benchmark, **how)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("_ranges") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, F.get("_ranges", i)).otherwise(-F.get("_ranges", i)))
    n_hit = F.when(F.size("_ranges") > 0, hit).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contamination_sql(documents: str = "documents", benchmark: str = "benchmark", n: int = WINDOW) -> str:
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM {documents}),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM {benchmark} WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT item, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, least(len(w), {n}) AS size, array_to_string(list_slice(w, i, i + least(len(w), {n}) - 1), ' ') AS gram FROM bw),
sizes AS (SELECT DISTINCT size FROM g),
dw AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
dg AS (SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram FROM dw),
h AS (SELECT DISTINCT r, dg.size, i, item FROM dg JOIN g ON dg.size = g.size AND dg.gram = g.gram),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""
