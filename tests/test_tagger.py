"""Viterbi against all sequences, spans through words and back, a tagger taught and measured, and its edges."""

import itertools
import types

import numpy as np
import pyarrow as pa
import pytest

from maskwright.operators import tagger as T
from maskwright.plans import jobs
from maskwright.plans.planted import held_out, with_people


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(2)
    for kinds in (("A",), ("A", "B")):
        n = 2 * len(kinds) + 1
        sizes = np.array([0, 1, 4, 2, 0, 5, 3])
        scores = rng.integers(-4, 5, (sizes.sum(), n)).astype(float)
        moves = rng.integers(-3, 4, (n + 1, n)) + T.allowed(kinds)
        got = T.viterbi(scores, sizes, moves)
        at = 0
        for size in sizes:
            value = lambda path, at=at: sum(scores[at + i, t] + moves[path[i - 1] if i else n, t] for i, t in enumerate(path))
            if size:
                assert value(tuple(got[at : at + size])) == max(map(value, itertools.product(range(n), repeat=size)))
            at += size


@pytest.mark.parametrize("together", [1, 7, 10_000])
def test_viterbi_is_the_same_in_any_lots(monkeypatch, together):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 30, 40)
    scores = rng.normal(size=(sizes.sum(), 5))
    moves = rng.normal(size=(6, 5)) + T.allowed(("A", "B"))
    want = T.viterbi(scores, sizes, moves)
    monkeypatch.setattr(T, "TOGETHER", together)
    assert (T.viterbi(scores, sizes, moves) == want).all()


def test_spans_to_tags():
    line = "Dr Ann-Marie O'Neil, 12 Elm St"
    places = T.words_of(line)
    assert [line[s:e] for s, e in places] == ["Dr", "Ann-Marie", "O'Neil", ",", "12", "Elm", "St"]
    # A span that cuts a word takes all of it; of overlapping ones the first speaks.
    assert T.gold(places, [(5, 19, "Full Name"), (13, 19, "Full Name"), (21, 30, "Physical Address"), (0, 2, "Other")], T.KINDS) == [0, 1, 2, 0, 3, 4, 4]


def test_pieces_are_cut_once_and_texts_stay(spark):
    rows = [(i, f"Name: Ann{i % 7} Lee\nplain words of line {i % 90}\nsame line", [("Full Name", f"Ann{i % 7} Lee", 6, 8)] if i % 3 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, planted array<struct<entity_type:string,original_text:string,start:int,length:int>>")
    batches = docs.select("text", "planted").toArrow().to_batches()
    got = [r for b in T._least(T.KINDS, 20, iter(batches)) for r in b.to_pylist()]
    # Of each kind the least only leave a task: 7 lines with a span; 20 of the 98 without.
    assert len(got) == 27
    every = sorted({p for _, text, s in rows for p in T._pieces(T.KINDS, text, [(6, 14, "Full Name")] if s else [])})
    want = [p for p in every if any(p[2])] + [p for p in every if not any(p[2])][:20]
    assert sorted((r["place"], r["line"], tuple(r["tags"])) for r in got) == sorted(want)
    beside, joined = T.train(docs, "planted"), T.train(docs, docs.selectExpr("doc_id", "inline(planted)"))
    assert (beside.weights == joined.weights).all() and (beside.moves == joined.moves).all()


def test_every_piece_teaches(spark):
    # One in ten lines has a span, each behind a word of its own; the first pieces hold few of these words.
    cues = [f"cue{chr(97 + i)}{chr(98 + i)}" for i in range(12)]
    rows = [(i, f"{cues[i // 10 % 12]} Ann Lee said {i}" if i % 10 == 0 else f"other words Ann Lee said {i}", [("Full Name", 6, 7)] if i % 10 == 0 else None) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, planted array<struct<entity_type:string,start:int,length:int>>")
    model = T.train(docs, "planted", first=4)
    want = [[("Full Name", "Ann Lee", s[0][1], 7)] if s else [] for _, _, s in rows]
    assert model.spans_of([text for _, text, _ in rows]) == want
    begun = T.Tagger(T.KINDS, *T._begun(docs.limit(0).selectExpr("text AS line", "array(0) AS tags", "doc_id AS place"), T.KINDS, 4, 1))
    assert begun.spans_of([rows[0][1]]) == [[]]


@pytest.mark.parametrize("batch", [1, 5])
def test_changes_of_shards_in_any_batches(batch):
    table = pa.table({"line": [f"Name: Ann{i}".replace(" ", "\x00") for i in range(90)], "tags": pa.array([[0, 1]] * 90, pa.list_(pa.int32())), "shard": pa.array([i // 40 for i in range(90)], pa.int32())})
    held = types.SimpleNamespace(value=(np.zeros((T.ROWS, 7), np.float32), np.zeros((8, 7), np.float32)))
    got = list(T._changes(T.KINDS, held, iter(table.to_batches(batch))))
    assert len(got) == 3
    alone = [list(T._changes(T.KINDS, held, iter(table.slice(at, 40).to_batches()))) for at in (0, 40, 80)]
    assert got == [b for x in alone for b in x]


def test_equal_lines_are_tagged_once(monkeypatch):
    model = T.Tagger(T.KINDS, np.zeros((T.ROWS, 7), np.float32), np.eye(8, 7).astype(np.float32))
    seen = []
    monkeypatch.setattr(T.Tagger, "tag", lambda self, lines: seen.extend(lines) or np.ones(sum(map(len, lines)), np.int64))
    assert model.spans_of(["a b\n\na b", None, "", "a b\nc"]) == [[("Full Name", "a", 0, 1), ("Full Name", "b", 2, 1), ("Full Name", "a", 5, 1), ("Full Name", "b", 7, 1)], [], [], [("Full Name", "a", 0, 1), ("Full Name", "b", 2, 1), ("Full Name", "c", 4, 1)]]
    assert seen == [["a", "b"], ["c"]]


def test_taught_on_planted_people(spark):
    docs = with_people(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).cache()
    taught = docs.where(~held_out())
    spans = taught.selectExpr("doc_id", "inline(planted)")
    model = T.train(taught, spans)
    few, some = taught.where("doc_id < 60"), spans.where("doc_id < 60")
    once, again = T.train(few, some), T.train(few.repartition(7), some.repartition(3))
    assert (once.weights == again.weights).all() and (once.moves == again.moves).all()
    rest = docs.where(held_out())
    want = {tuple(r) for r in rest.selectExpr("doc_id", "inline(planted)").collect()}
    got = {tuple(r) for r in T.tag_documents(rest, model).collect()}
    for kind in T.KINDS:
        w, g = ({x for x in s if x[1] == kind} for s in (want, got))
        assert 2 * len(w & g) / (len(w) + len(g)) > 0.93
    found = {tuple(r) for r in jobs.extract_entities(rest, "tagger", model=model).select("doc_id", "entity_type", "original_text", "start", "length").collect()}
    assert found <= got
    texts = {r.doc_id: r.text for r in rest.collect()}
    assert all(texts[d][s : s + n] == t for d, _, t, s, n in got)
    docs.unpersist()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Name: Ada Byron\n\nName: Ada Byron", "x"), (3, "a " * 30_000, "x")], "doc_id long, text string, start string")
    none = T.train(df, spark.createDataFrame([], "doc_id long, entity_type string, start int, length int"))
    assert T.tag_documents(df, none).collect() == []
    spans = spark.createDataFrame([(3, "Full Name", 6, 9), (3, "Full Name", 23, 9), (3, "Else", 0, 4), (3, "Full Name", None, 2), (9, "Full Name", 0, 4), (3, "Full Name", 900_000, 4)], "doc_id long, entity_type string, start int, length int")
    model = T.train(df.where("length(text) < 99"), spans)
    assert {tuple(r) for r in T.tag_documents(df, model).collect()} >= {(3, "Full Name", "Ada Byron", 6, 9), (3, "Full Name", "Ada Byron", 23, 9)}
    assert T.tag_documents(df.limit(0), model).collect() == []
    empty = T.train(df.limit(0), spans)
    assert empty.spans("Name: Ada Byron") == []


def test_planting_cuts_each_text_once(spark):
    docs = spark.range(4).selectExpr("id AS doc_id", "if(id = 0, null, concat('One line\\nand Another ', id)) AS text")
    made = with_people(docs)
    for df in (made, made.select("doc_id", "planted"), made.selectExpr("doc_id", "inline_outer(planted)")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z]+") == 1
    for r in made.collect():
        assert [p.entity_type for p in r.planted] == list(T.KINDS)
        assert all(r.text[p.start : p.start + p.length] == p.original_text for p in r.planted)
