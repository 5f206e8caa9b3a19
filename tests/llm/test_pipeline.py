"""The stages of the pipeline against plain Python and SQL, each on what the one before kept."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd

import corpus_pipeline
from maskwright.llm.mixing import mix_sql

from .test_against_brute_force import LOWER, SF, _plain_bayes, words


def plain_lines(rows):
    pages, held = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        held.update((r["source"], x) for x in set(r["text"].split("\n")) if words(x))
    frequent = {k for k, n in held.items() if n >= 3 and n / pages[k[0]] > 0.065}
    return [r | {"text": "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in frequent)} for r in rows]


def plain_duplicates(rows):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    best = {}
    for i, r in enumerate(rows):
        key = find(i) if sets[i] else ("alone", i)
        best[key] = min(best.get(key, r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or best[find(i)] == r["doc_id"]]


def plain_clean(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = {tuple(w[j : j + min(10, len(w))]) for w in map(cut, items) for j in range(max(len(w) - 9, 1)) if w}
    sizes = {len(g) for g in grams}
    return [r for r in rows if not any(tuple(w[j : j + n]) in grams for w in [cut(r["text"])] for n in sizes for j in range(len(w) - n + 1))]


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    found = _plain_bayes([(r["doc_id"], r["text"], r["lang"], zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2) for r in rows])
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted((r["doc_id"], r["text"]) for r in rs)

    def run(name):
        nonlocal docs
        docs = stages[name](spark, docs, SF).cache()
        return key(r.asDict() for r in docs.collect())

    rows = [r for r in rows if found[r["doc_id"]][0] != "und" and found[r["doc_id"]][1] >= 0.5]
    assert run("language_id") == key(rows)
    rows = plain_lines(rows)
    assert run("line_dedup") == key(rows) and {r.n_chars for r in docs.collect()} == {len(r["text"]) for r in rows}
    rows = plain_duplicates(rows)
    assert run("jaccard_join") == key(rows)
    rows = plain_clean(rows, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert run("decontaminate") == key(rows)
    kept = pd.DataFrame([{k: r[k] for k in ("doc_id", "text", "source")} for r in rows])  # noqa: F841
    want = duckdb.sql(mix_sql("kept")).df()
    got = stages["mix_sources"](spark, docs, SF).toPandas()
    order = lambda d: sorted(map(repr, d[["doc_id", "size", "source_size", "target", "taken", "copies"]].values.tolist()))
    assert order(got) == order(want)
