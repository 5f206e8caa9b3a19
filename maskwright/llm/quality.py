"""Quality rules: gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (word, symbol, line and repetition
counts and ratios), computed in numpy over Arrow buffers. Trees are boosted on
the logistic loss with histogram splits, on a bounded sample of labelled rows
(`SAMPLE` rows at most, lowest hash of the id first); they are flattened into
node arrays that all documents of a batch walk together. Chosen features are
monotonic: a split of one must order its two sides, and the bounds of a node
hold for everything below it, so more repetition or more symbols never raise a
document's score.

kept = not base_failed and probability >= `THRESHOLD`; without labels of both
kinds the verdict is that of the base rules alone.

Defined results: null, empty and wordless texts have zero counts and fail the
base rule; labels with a null id or quality are not used, several labels of an
id are averaged and rounded; documents that repeat an id are separate; empty
tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE = 20_000
THRESHOLD = 0.5
TREES, DEPTH, RATE, CELLS, LEAST, L2 = 60, 3, 0.15, 32, 8, 1.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_per_line", "bar_share")
#: Direction in which the score may move as the feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bar_share": -1}

_table = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
_SYMBOL = _table("#*$%&|<>")
_UPPER, _DIGIT, _BAR, _MARK = (_table(s) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!?.,;:"))


def _sums(b: K.Block, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(table[b.data], out=total[1:])
    return total[b.offs[1:]] - total[b.offs[:-1]]


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys by row: which occur in their row before, and which occur there twice or more."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return again, twice


def statistics(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of each row of a block."""
    t = K.tokens(b, K.NON_SPACE, lower=False)
    rows = b.rows
    n = K.per_row(t.row, rows)
    lead = K.LEADING & K.NON_SPACE
    chars = _sums(b, lead)
    symbols = _sums(b, _SYMBOL)
    w, at = K.windows(t.hash, t.row, 5)
    _, twice = _repeated(w, t.row[at])
    cover = np.zeros(len(t.start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeat = K.per_row(t.row[np.cumsum(cover[:-1]) > 0], rows)
    lines = K.tokens(b, K.NOT_NEWLINE, lower=False)
    # A line counts if a word starts in it.
    worded = np.searchsorted(t.start, lines.end) > np.searchsorted(t.start, lines.start)
    again, _ = _repeated(lines.hash[worded], lines.row[worded])
    dup = K.per_row(lines.row[worded][again], rows)
    n_lines = K.per_row(lines.row[worded], rows)
    first, _ = _repeated(t.hash, t.row)
    counts = np.stack([n, chars, symbols, dup, repeat], 1)
    size, words, line = np.maximum(chars, 1), np.maximum(n, 1), np.maximum(n_lines, 1)
    shares = [np.log1p(n), chars / words, symbols / size, dup / line, repeat / words, _sums(b, _UPPER) / size, _sums(b, _DIGIT) / size, _sums(b, _MARK) / size, 1 - K.per_row(t.row[first], rows) / words, n / line, _sums(b, _BAR) / size]
    return counts, np.stack(shares, 1)


class Trees:
    """Boosted trees as flat node arrays: feature (-1 in a leaf), threshold, first child, value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.feature, self.threshold, self.child, self.value = [], [], [], []
        self.roots: list[int] = []
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CELLS + 1)[1:-1])) for f in range(x.shape[1])]
        cells = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            step = np.zeros(len(y))
            self.roots.append(self._grow(cells, prob - y, prob * (1 - prob), np.arange(len(y)), DEPTH, -np.inf, np.inf, step))
            score += step
        self.feature, self.threshold = np.array(self.feature), np.array(self.threshold)
        self.value = np.array(self.value)

    def _grow(self, cells, g, h, rows, depth, low, high, step) -> int:
        node = len(self.feature)
        weight = lambda a, b: np.clip(-a / (b + L2), low, high)
        own = weight(g[rows].sum(), h[rows].sum())
        for part, v in ((self.feature, -1), (self.threshold, 0.0), (self.child, 0), (self.value, RATE * own)):
            part.append(v)
        best = (1e-6, None)
        loss = lambda a, b, w: -(a * w + 0.5 * (b + L2) * w * w)
        if depth and len(rows) >= 2 * LEAST:
            whole = loss(g[rows].sum(), h[rows].sum(), own)
            for f, cut in enumerate(self.cuts):
                k = len(cut) + 1
                gl, hl, nl = (np.cumsum(np.bincount(cells[rows, f], v, k))[:-1] for v in (g[rows], h[rows], None))
                wl, wr = weight(gl, hl), weight(g[rows].sum() - gl, h[rows].sum() - hl)
                gain = loss(gl, hl, wl) + loss(g[rows].sum() - gl, h[rows].sum() - hl, wr) - whole
                sign = MONOTONE.get(FEATURES[f], 0)
                ok = (nl >= LEAST) & (len(rows) - nl >= LEAST) & ((wr - wl) * sign >= 0)
                gain = np.where(ok, gain, -1)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (f, i, wl[i], wr[i], sign))
        if best[1] is None:
            step[rows] = RATE * own
            return node
        f, i, wl, wr, sign = best[1]
        mid = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign]
        left = cells[rows, f] <= i
        self.feature[node], self.threshold[node] = f, self.cuts[f][i]
        a = self._grow(cells, g, h, rows[left], depth - 1, *bounds[0], step)
        c = self._grow(cells, g, h, rows[~left], depth - 1, *bounds[1], step)
        self.child[node] = (a, c)
        return node

    def flatten(self) -> Trees:
        self.child = np.array([c if isinstance(c, tuple) else (0, 0) for c in self.child], np.int64).reshape(-1, 2)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.child[at, right.astype(np.int64)])
            score += self.value[at]
        return 1 / (1 + np.exp(-score))


def _measure(model: Trees | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, feats = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)))]
        for b in K.blocks(batch.column(1)):
            c, f = statistics(b)
            counts.append(c)
            feats.append(f)
        c, f = np.concatenate(counts), np.concatenate(feats)
        out = [batch.column(0), *(pa.array(c[:, i]) for i in range(len(COUNTS)))]
        if model is None:
            out.append(pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=["id", *COUNTS, "features"])
        else:
            out.append(pa.array(model.probability(f)))
            yield pa.RecordBatch.from_arrays(out, names=["id", *COUNTS, "probability"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Trees from at most `sample` labelled ids, one document each (of several the one with the lowest statistics); None unless both labels occur."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y.select("id")), "id", "left_semi")
    id_type = rows.schema["id"].dataType.simpleString()
    ddl = f"id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, features array<double>"
    got = rows.mapInArrow(lambda it: _measure(None, it), ddl).groupBy("id").agg(F.min("features").alias("features")).join(F.broadcast(y), "id").collect()
    got = sorted(got, key=lambda r: (str(r.id), r.features))
    if len({r.y for r in got}) < 2:
        return None
    return Trees(np.array([r.features for r in got]), np.array([r.y for r in got])).flatten()


def judge(docs: DataFrame, model: Trees | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, base_failed, kept, probability) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    head = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, "
    if model is None:
        out = rows.mapInArrow(lambda it: _measure(None, it), head + "features array<double>").drop("features").withColumn("probability", F.lit(1.0))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)
        out = rows.mapInArrow(lambda it: _measure(held.value, it), head + "probability double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(F.col("id").alias("doc_id"), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("probability") >= threshold)).alias("kept"), "probability")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
