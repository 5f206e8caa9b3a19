"""Nulls, empty and long texts, repeats, clashing columns and empty tables, for every operator and stage."""

import pytest

import corpus_pipeline
from maskwright.llm import decontaminate, discriminant, jaccard_join, language_id, language_model, licenses, lines, mixing, pii, quality, substrings

from .fixtures import ROWS, documents, empty


def bench(spark, *items):
    return spark.createDataFrame(list(items) or [(0, None)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (3, None)], "doc_id long, quality int")


OPERATORS = {
    "mix": lambda s, d: mixing.mix_digest(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "decontaminate": lambda s, d: decontaminate.contamination_digest(d, bench(s, (1, "word1 word2 word3"), (None, "x"), (2, None), (3, ""))),
    "lm": lambda s, d: language_model.train_and_score(d),
    "lines": lambda s, d: lines.line_digest(d),
    "substrings": lambda s, d: substrings.repeated_passages(d),
    "language": lambda s, d: language_id.language_digest(d),
    "quality": lambda s, d: quality.judge(d, quality.train(d, labels(s))),
    "discriminant": lambda s, d: discriminant.classify(m := discriminant.measured(d), discriminant.train(m, labels(s))),
    "pii": lambda s, d: pii.pii_digest(d),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_stages(spark, tmp_path):
    bench(spark, (1, "word1 word2 word3")).write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (documents(spark), empty(spark)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs.withColumn("n_chars", docs["n"].cast("long")) if "n_chars" not in docs.columns else docs, str(tmp_path))
            assert set(before.columns) <= set(docs.columns) and docs.count() <= before.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep A b c d e f g h i j end"), (2, "clean")], "doc_id long, text string")
    b = bench(spark, (1, "a B c d e f g h i j"))
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, b, remove="spans").collect()} == {1: "keep  end", 2: "clean"}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, b).collect()] == [2]


def test_benchmark_in_blocks(spark):
    docs = documents(spark)
    b = bench(spark, *[(i, f"word{i} word{i + 1} word{i + 2}") for i in range(50)])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontaminate.contamination_digest(docs, b)) == key(decontaminate.contamination_digest(docs, b, broadcast_bytes=300))
    cut = lambda **how: key(decontaminate.decontaminate(docs, b, remove="spans", **how))
    assert cut() == cut(broadcast_bytes=0)


def test_large_benchmark_gives_the_same(spark):
    docs, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontaminate.contamination_digest(docs, b)) == key(decontaminate.contamination_digest(docs, b, broadcast_bytes=0))


def test_empty_benchmark(spark):
    docs, none = documents(spark), bench(spark).limit(0)
    for limit in (0, -1):
        assert {r.n_hit for r in decontaminate.contamination_digest(docs, none, broadcast_bytes=limit).collect()} == {0}
    clash = spark.createDataFrame([(1, "word1 word2 word3", 5, "z")], "item_id long, text string, i int, t string")
    assert decontaminate.decontaminate(docs, clash).count() == 8


def test_frequent_lines_go_everywhere(spark):
    rows = [(i, f"{'tenth of all pages' if i % 10 < 1 else 'body'}\nline {i}", f"s{i % 3}", 1, 2) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_dropped int")
    out = lines.drop_boilerplate(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert not any("tenth" in r.text for r in out.collect())


def test_mix_takes_whole_documents(spark):
    docs = documents(spark)
    plan = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix_plan(docs).where("doc_id is not null and doc_id <> 2").collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(got.get(k[0], 0) == n for k, n in plan.items())


def test_lines_without_broadcast(spark):
    docs = spark.createDataFrame([(i, f"head\nbody {i}\n\nhead", "s") for i in range(5)], "doc_id long, text string, source string")
    for limit in (0, 100):
        assert {r.text for r in lines.drop_boilerplate(docs, broadcast_lines=limit).collect()} == {f"body {i}\n" for i in range(5)}


def test_duplicates_go_by_id_and_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (7, None), (7, None), (8, ""), (9, b), (9, b), (None, a), (10, a + " x"), (11, "one two"), (11, "one two"), (None, "alone it stands")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, copy int, _id string")
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (5, b), (7, None), (7, None), (8, ""), (11, "one two"), (None, "alone it stands")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_tree_gives_what_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 300):
        points = rng.poisson(1.5, (n, 32))
        sizes = points.sum(1)
        tree = jaccard_join.RTree(points, sizes)
        for q in range(0, n, 7):
            near = np.minimum(points, points[q]).sum(1) * 180 >= 80 * (sizes + sizes[q])
            near &= (sizes * 100 >= 80 * sizes[q]) & (sizes * 80 <= 100 * sizes[q])
            assert sorted(tree.search(points[q], int(sizes[q]), 80, 100).tolist()) == np.flatnonzero(near).tolist()


def test_links_come_from_trees(spark):
    base = [[f"w{i}x{j}" for j in range(60)] for i in range(20)]
    rows = [(i * 100 + k, " ".join([*w, f"t{i}x{k}"])) for i, w in enumerate(base) for k in range(6)]
    figures = {}
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100, figures=figures).collect()
    assert {r.component_id for r in out} == {i * 100 for i in range(20)}
    assert figures["links"] + figures["open_links"] >= 100


def test_shared_values(spark):
    import random

    from maskwright.llm import shared

    rng = random.Random(3)
    lists = [(n, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)]) for n in range(40)]
    both = [v for n, vs in lists[:10] for v in vs[:5]]
    lists += [(100 + i, [v, v]) for i, v in enumerate(both)] + [(200, None), (201, [])]
    found = shared.shared_values(spark.createDataFrame(lists, "node long, v array<long>").repartition(5), "node", "v", 2100)
    import numpy as np

    keeps = lambda vs: len(found.keeps(np.array(vs, np.int64).view(np.uint64)))
    assert keeps(both) == len(both)
    assert keeps([v for _, vs in lists[10:40] for v in vs]) < 300
