"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts character n-grams (orders 1 to 3, ASCII and Latin-1 capitals
lower-cased), hashed into `BINS` bins, for each language over every training
text: each task sums its own texts, Spark adds the tasks up. The matrix of log
probabilities has BINS rows and a column for each of at most `MAX_LANGS`
languages, so what is broadcast has a fixed bound. Scoring gathers matrix rows
for all n-grams of a block of whole texts and sums them by document in numpy.

A document is not cut: its n-grams stream through in blocks of about `BLOCK`
bytes of texts, a longer text being its own block.

Defined results: null text, or text without a letter, is `und` with score 0, as
is every text when no training row has a language; rows without a language are
not learned from; ties go to the language first by code point; repeated rows are
separate; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import crc_bucket, free_name, settle

BINS = 1 << 15
ORDERS = (1, 2, 3)
TILE = 128
ALPHA = 0.1
FOLDS, HELD_OUT = 4, 2

_MUL = np.uint32(0x9E3779B1)
#: Lower case for the first 256 code points.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7


def _code_points(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's code points, lower-cased, and each row's offset in them."""
    cp = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.r_[0, np.cumsum(K.LEADING[b.data])][b.offs]
    low = cp < 256
    return np.where(low, _FOLD[np.where(low, cp, 0)], cp), at


def _grams(cp: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bin of every n-gram inside a row, and its row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.int32)
    h = np.zeros(len(cp), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        m = len(cp) - order + 1
        if m <= 0:
            return
        h = (h[:m] + cp[order - 1 :]) * _MUL
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            inside = row[:m] == row[order - 1 :]
            yield (h[inside] * _MUL) >> np.uint32(17), row[:m][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n): counts of the n-grams of each language, summed while there is room."""
    codes: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed():
        key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

    def out(key, n):
        names = pa.array(list(codes), pa.string()).take(pa.array(key // BINS))
        return pa.RecordBatch.from_arrays([names, pa.array((key % BINS).astype(np.int32)), pa.array(n)], names=["lang", "bin", "n"])

    for batch in batches:
        code = np.array([codes.setdefault(x, len(codes)) for x in batch.column(1).to_pylist()], np.int64)
        for b in K.blocks(batch.column(0)):
            names, own = np.unique(code[b.first : b.first + b.rows], return_inverse=True)
            for bins, row in _grams(*_code_points(b)):
                at = own[row] * BINS + bins
                # A dense sum is the faster one where few languages stand in a block.
                if len(names) <= 8:
                    total = np.bincount(at, minlength=len(names) * BINS)
                    key = np.flatnonzero(total)
                    n = total[key]
                else:
                    key, n = np.unique(at, return_counts=True)
                held.append((names[key // BINS] * BINS + key % BINS, n))
                size += len(key)
            if size > 2_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*summed())


class Tile:
    """Some languages, by code point, with log priors and log probabilities by bin."""

    def __init__(self, langs: list[str], log_prior: np.ndarray, counts: np.ndarray):
        self.langs, self.log_prior = langs, log_prior
        p = counts + ALPHA
        self.log_p = np.ascontiguousarray(np.log(p / p.sum(0)).T, np.float64)


class Model:
    """Texts and n-gram counts of each language; the counts stay in Spark and come in tiles."""

    def __init__(self, texts: dict[str, int], counts: DataFrame):
        self.texts, self.counts = texts, counts

    def tiles(self, size: int = TILE) -> Iterator[Tile]:
        langs, total = sorted(self.texts), sum(self.texts.values())
        for i in range(0, max(1, len(langs)), size):
            part = langs[i : i + size]
            table = np.zeros((BINS, len(part)))
            if part:
                # At most BINS * size rows.
                got = self.counts.where(F.col("lang").isin(part)).toArrow()
                at = {x: i for i, x in enumerate(part)}
                table[got.column("bin").to_numpy(), np.array([at[x] for x in got.column("lang").to_pylist()], np.int64)] = got.column("n").to_numpy()
            yield Tile(part, np.log(np.array([self.texts[x] for x in part]) / max(1, total)), table)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Naive Bayes from all rows of docs that have a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    texts = {r.lang: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    return Model(texts, settle(counts, "ngrams"))


def _predict(tile: Tile, text_at: int, prior: bool, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the best language so far, its log score, and the sum of all shares relative to it; no language for a text without letters."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    n_langs = len(tile.langs)
    for batch in batches:
        best, log, share = np.full(batch.num_rows, None, object), np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows)
        columns = batch.columns
        if prior:
            *columns, old_best, old_log, old_share = batch.columns
            best, log, share = np.array(old_best.to_pylist(), object), old_log.to_numpy().copy(), old_share.to_numpy().copy()
        for b in K.blocks(batch.column(text_at), max(1 << 14, (1 << 20) // max(4, n_langs))):
            lettered = np.r_[0, np.cumsum(ascii_letter[b.data])]
            has = lettered[b.offs[1:]] > lettered[b.offs[:-1]]
            for r in np.flatnonzero(~has & (b.offs[1:] > b.offs[:-1])).tolist():
                has[r] = any(ch.isalpha() for ch in b.data[b.offs[r] : b.offs[r + 1]].tobytes().decode("utf-8", "replace"))
            if not n_langs or not has.any():
                continue
            cp, at = _code_points(b)
            total = np.tile(tile.log_prior, (b.rows, 1))
            for bins, row in _grams(cp, at):
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    for i in range(n_langs):
                        total[row[first], i] += np.add.reduceat(tile.log_p[i][bins], first, dtype=np.float64)
            top = total.argmax(1)
            for r in np.flatnonzero(has).tolist():
                at, new = b.first + r, total[r, top[r]]
                high = max(new, log[at])
                share[at] = share[at] * np.exp(log[at] - high) + np.exp(total[r] - high).sum()
                if new > log[at]:
                    best[at], log[at] = tile.langs[top[r]], new
        yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(log), pa.array(share)], names=names)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", tile: int = TILE) -> DataFrame:
    """docs with the predicted language and its posterior (0 to 1); the text alone is looked at."""
    pred_col, score_col = free_name(docs, pred_col), free_name(docs, score_col)
    best, log, share = (free_name(docs, f"_lang_{x}") for x in ("best", "log", "share"))
    schema = T.StructType([*docs.schema.fields, T.StructField(best, T.StringType()), T.StructField(log, T.DoubleType()), T.StructField(share, T.DoubleType())])
    text_at, names, out = docs.columns.index(text_col), schema.names, docs
    for i, t in enumerate(model.tiles(tile)):
        held = docs.sparkSession.sparkContext.broadcast(t)
        out = (settle(out, "languages") if i else out).mapInArrow(lambda it, held=held, i=i: _predict(held.value, text_at, i > 0, names, it), schema)
    score = F.when(F.col(best).isNull(), F.lit(0.0)).otherwise(1 / F.col(share))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(best), F.lit("und")).alias(pred_col), score.alias(score_col))


def language_digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", (crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    model = train(rows.where("not held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_languages(docs: DataFrame, *, min_score: float = 0.5) -> DataFrame:
    """The documents whose text has a recognised language, with every column as it was."""
    model = train(docs.where(crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT))
    pred, score = free_name(docs, "_pred"), free_name(docs, "_score")
    out = identify(docs, model, pred_col=pred, score_col=score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return language_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
