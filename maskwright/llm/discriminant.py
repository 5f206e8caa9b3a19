"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every whole text becomes a row of statistics, once; what follows reads these rows
only. Shares are moved to logits, lengths to logarithms. Each class has a mean and
a covariance over all labelled rows, shrunk first towards the pooled one (`pool`),
then towards a multiple of the identity (`ridge`); the pair is the one of GRID with
the least log loss where each fold of the labelled rows is scored by the others.
A score is the posterior of label 1: the difference of the classes' log densities,
from Mahalanobis distances by inverse Cholesky factors that are computed once.

Nothing is sampled: tasks add up counts, sums and products of the statistics in
fixed point (2^-SCALE), so that moments, and with them the scores, are the same
however rows are dealt to tasks; the driver sees a few thousand sums.

Defined results: null, empty and wordless texts have the statistics of an empty text
and a score of their own like others; labels with a null id or value are not used,
several labels of an id are averaged and rounded (a tie is 1), and of documents that
repeat a labelled id the one with the least statistics teaches; documents that
repeat an id are scored separately; without labels every score is 0.5, with one kind
of label that kind; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_bucket, drop_settled, if_small, settle
from .quality import FEATURES, statistics

THRESHOLD = 0.3
#: A share s is moved to the logit of EDGE + (1 - 2 * EDGE) * s.
EDGE = 0.01
GRID = [(pool, ridge) for pool in (0.05, 0.1, 0.2, 0.4) for ridge in (0.003, 0.01, 0.03)]
FOLDS, HELD_OUT = 5, 0
SCALE = 16
D = len(FEATURES)
_LOGS = ("words", "word_length", "words_per_line")


def transform(x: np.ndarray) -> np.ndarray:
    """FEATURES with shares as logits and lengths as logarithms, rounded to 2^-SCALE."""
    z = np.empty_like(x, float)
    for i, name in enumerate(FEATURES):
        if name == "words":  # a logarithm already
            z[:, i] = x[:, i]
        elif name in _LOGS:
            z[:, i] = np.log1p(x[:, i])
        else:
            p = EDGE + (1 - 2 * EDGE) * np.clip(x[:, i], 0, 1)
            z[:, i] = np.log(p / (1 - p))
    return np.round(z * (1 << SCALE)) / (1 << SCALE)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = np.concatenate([np.zeros((0, D)), *(transform(statistics(b)[1]) for b in K.blocks(batch.column(1)))])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), D).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "z"])


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, z): the transformed statistics of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measure, f"id {rows.schema['id'].dataType.simpleString()}, z array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products in fixed point, by fold and class: one row a slot and batch."""
    for batch in batches:
        z = np.round(_matrix(batch.column(0)) * (1 << SCALE)).astype(np.int64)
        group = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy()
        for g in np.unique(group):
            # Rows in lots, so that products of numbers below 2^25 can't leave 63 bits.
            own = z[group == g]
            for lot in np.split(own, range(4096, len(own), 4096)):
                values = np.r_[len(lot), lot.sum(0), (lot.T @ lot).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), g, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["g", "slot", "value"])


class Moments:
    """Count, mean and covariance of each class."""

    def __init__(self, sums: np.ndarray):
        """sums: by class, the slots of `_sums` as Python integers or floats."""
        one = float(1 << SCALE)
        self.n = [float(s[0]) for s in sums]
        self.mean = [np.array([float(x) for x in s[1 : D + 1]]) / one / max(n, 1.0) for s, n in zip(sums, self.n)]
        second = [np.array([float(x) for x in s[D + 1 :]]).reshape(D, D) / one**2 / max(n, 1.0) for s, n in zip(sums, self.n)]
        self.cov = [b - np.outer(m, m) for b, m in zip(second, self.mean)]


class Discriminant:
    """Means, inverse Cholesky factors and constants of both classes."""

    def __init__(self, m: Moments, pool: float, ridge: float):
        total = sum(m.n)
        pooled = (m.n[0] * m.cov[0] + m.n[1] * m.cov[1]) / total
        middle = (m.n[0] * m.mean[0] + m.n[1] * m.mean[1]) / total
        spread = np.diag(pooled) + sum(n * (mean - middle) ** 2 for n, mean in zip(m.n, m.mean)) / total
        self.unit = 1 / np.sqrt(np.where(spread > 1e-12, spread, 1.0))
        self.mean, self.inverse, self.constant = m.mean, [], []
        for k in (0, 1):
            c = ((1 - pool) * m.cov[k] + pool * pooled) * np.outer(self.unit, self.unit)
            c = (1 - ridge) * c + ridge * max(np.trace(c) / D, 1e-3) * np.eye(D)
            factor = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(factor))
            self.constant.append(np.log(m.n[k] / total) - np.log(np.diag(factor)).sum())

    def difference(self, z: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        g = [c - 0.5 * np.square(((z - mean) * self.unit) @ w.T).sum(1) for mean, w, c in zip(self.mean, self.inverse, self.constant)]
        return g[1] - g[0]

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(z), -500, 500)))


class Constant:
    """Where labels of two kinds are missing."""

    def __init__(self, value: float):
        self.value = value

    def score(self, z: np.ndarray) -> np.ndarray:
        return np.full(len(z), self.value)


def train(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", held_out: int = HELD_OUT) -> Discriminant | Constant:
    """The discriminant of labelled rows of stats whose fold isn't held out (-1: none is)."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    y = settle(y.withColumn("fold", crc_bucket(F.col("id"), FOLDS).cast("int")).where(F.col("fold") != held_out), "labels")
    rows = settle(stats.join(if_small(y), "id").groupBy("id").agg(F.min("z").alias("z"), F.first("fold").alias("fold"), F.first("y").alias("y")).select("z", "fold", "y"), "labelled")
    got = rows.mapInArrow(_sums, "g int, slot int, value long").groupBy("g", "slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    sums = np.zeros((2 * FOLDS, 1 + D + D * D), object)
    for r in got:
        sums[r.g, r.slot] = int(r.v)
    kinds = [sums[k::2].sum(0)[0] for k in (0, 1)]
    if not all(kinds):
        drop_settled(y, rows)
        return Constant(0.5 if not any(kinds) else float(kinds[1] > 0))
    whole = Moments(np.stack([sums[k::2].sum(0) for k in (0, 1)]))
    models = []
    for fold in range(FOLDS):
        rest = np.stack([sums[k::2].sum(0) - sums[2 * fold + k] for k in (0, 1)])
        # A fold that holds all rows of a class can't be judged by the others.
        models.append([Discriminant(Moments(rest), *pair) for pair in GRID] if rest[0, 0] and rest[1, 0] else None)
    held = stats.sparkSession.sparkContext.broadcast(models)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold, sign = _matrix(batch.column(0)), batch.column(1).to_numpy(), 1 - 2 * batch.column(2).to_numpy()
            total = np.zeros(len(GRID), np.int64)
            for f in np.unique(fold):
                here = fold == f
                for i, model in enumerate(held.value[f] or ()):
                    # In millionths and row by row, so that the sum doesn't depend on the order of rows.
                    total[i] += np.round(1e6 * np.logaddexp(0, np.minimum(sign[here] * model.difference(z[here]), 50))).astype(np.int64).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(GRID), dtype=np.int32)), pa.array(total)], names=["pair", "loss"])

    loss = {r.pair: r.loss for r in rows.mapInArrow(losses, "pair int, loss long").groupBy("pair").agg(F.sum(F.col("loss").cast("decimal(38,0)")).alias("loss")).collect()}
    drop_settled(y, rows)
    return Discriminant(whole, *GRID[min(loss, key=lambda i: (loss[i], i))])


def classify(stats: DataFrame, model: Discriminant | Constant, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of stats."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(_matrix(batch.column(1))))], names=["id", "score"])

    out = stats.select("id", "z").mapInArrow(scored, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias("doc_id"), (crc_bucket(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    stats = settle(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    return classify(stats, train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
