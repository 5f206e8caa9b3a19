"""The discriminant against plain formulas, and on labels that it never saw."""

import zlib

import numpy as np
import pyarrow as pa

from maskwright.llm import discriminant as G
from maskwright.llm import kernels as K

SF = "/root/testdata/sf0.1"


def rank_quality(score, y):
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n / 2 + 0.5)[at]
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_held_out_labels(spark):
    out = G.op13_quality_discriminant(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    seen = out[out.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(seen) > 500 and rank_quality(seen.score.to_numpy(), seen.quality.to_numpy()) > 0.99
    assert (seen.predicted == seen.quality)[seen.quality == 1].mean() > 0.98 and (seen.predicted == seen.quality)[seen.quality == 0].mean() > 0.95


def test_equals_plain_formulas(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = G.settle(G.measured(docs))
    model = G.train(stats, labels)
    y = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    z = np.concatenate([G.transform(G.statistics(b)[1]) for b in K.blocks(pa.array([r.text for r in rows]))])
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows])
    label = np.array([y.get(r.doc_id, -1) for r in rows])

    def log_odds(learn, pool, ridge, at):
        xs = [z[learn & (label == k)] for k in (0, 1)]
        total = sum(map(len, xs))
        pooled = sum(len(x) * np.cov(x.T, bias=True) for x in xs) / total
        unit = 1 / z[learn].std(0)
        found = []
        for x in xs:
            c = ((1 - pool) * np.cov(x.T, bias=True) + pool * pooled) * unit[:, None] * unit
            c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c))
            d = (z[at] - x.mean(0)) * unit
            found.append(np.log(len(x) / total) - np.linalg.slogdet(c)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) / 2)
        return found[1] - found[0]

    known = (label >= 0) & (fold != 0)
    loss = {}
    for pair in G.GRID:
        loss[pair] = sum(np.round(1e6 * np.logaddexp(0, np.minimum((1 - 2 * label[known & (fold == f)]) * log_odds(known & (fold != f), *pair, known & (fold == f)), 50))).sum() for f in range(1, 5))
    best = min(loss, key=lambda p: loss[p])
    np.testing.assert_allclose(model.difference(z), log_odds(known, *best, slice(None)), rtol=1e-4, atol=1e-4)


def test_same_scores_however_rows_are_dealt(spark):
    stats = G.settle(G.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = G.train(stats, labels), G.train(stats.repartition(23), labels.repartition(4))
    assert a.constant == b.constant and all((x == y).all() for x, y in zip(a.inverse + a.mean, b.inverse + b.mean))


def test_missing_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    stats = G.measured(docs)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert [r.score for r in G.classify(stats, G.train(stats, none)).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert [r.predicted for r in G.classify(stats, G.train(stats, ones)).collect()] == [1] * 3
    zeros = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, quality int")
    assert [r.score for r in G.classify(stats, G.train(stats, zeros)).collect()] == [0.0] * 3


def test_one_row_of_a_class(spark):
    docs = spark.createDataFrame([(i, "one two three. " * (i % 4 + 1)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 7)) for i in range(30)], "doc_id long, quality int")
    stats = G.measured(docs)
    assert all(0 <= r.score <= 1 for r in G.classify(stats, G.train(stats, labels, held_out=-1)).collect())
