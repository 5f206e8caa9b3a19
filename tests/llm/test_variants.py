"""Spelling variants against plain counting and comparing."""

import random
import re
import zlib

import numpy as np

from maskwright.llm import variants as V

from .fixtures import documents, empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows):
    counts = {}
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    near = {w: [o for o in counts if o != w and one_apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o.encode()))
            if counts[best] >= 5 * counts[w]:
                form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def got(df):
    return {r.word: tuple(r)[1:] for r in V.group_variants(V.vocabulary(df)).collect()}


def corpus(seed=3, n=90):
    rng = random.Random(seed)
    stems = ["garden", "gardens", "gärten", "gardén", "window", "winodw", "elephant", "façade", "÷×ßàéîõü", "a" * 70, "é" * 55, "Straße", "strasse", "Mississippi", "misissippi"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.choice((3, 8, len(stems)))])
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("xyÉ") + w[at + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((None if i == 5 else i % 40, None if i == 7 else rng.choice((" ", "-", "1", "Ā")).join(words)))
    return rows


def test_equals_plain_comparison(spark):
    rows = corpus()
    want = expected(words_of(rows))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert sum(f is not None for f, *_ in want.values()) > 20


def test_forms_are_followed_to_the_last(spark):
    # Each word is an edit away from the next, which is five times as frequent; the last two tie at the front.
    chain = {"banana": 5, "bananas": 25, "bonanas": 125, "bonanza": 3, "bonanasx": 625, "bonanasy": 625, "bonanasxy": 3125, "orange": 9}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    found = {r.word: tuple(r)[1:] for r in V.group_variants(df).collect()}
    assert found == expected(chain) and found["banana"][1] == "bonanasxy" and found["bonanas"][0] == "bonanasx"


def test_every_choice_of_parts_finds_all_pairs(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10))) for _ in range(400)} | {"a" * n for n in range(6, 12)} | {"b" * 300, "b" * 301}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and one_apart(a, b)}
    for n1, n2 in ((1, 4), (1, 7), (2, 3), (3, 2)):
        assert {tuple(sorted((r.a, r.b))) for r in V.near_pairs(df, n1, n2).collect()} == want


def test_crc_of_runs():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = np.sort(rng.integers(0, 2800, 60))
    end = start + rng.integers(1, 130, 60)
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(60)], np.uint32)
    assert V.run_crc(data, start, end, begun).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(start, end, begun)]


def test_edges(spark):
    assert got(empty(spark)) == {}
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert got(documents(spark)) == expected(words_of(rows))
