"""Operators that SQL can't express, against plain Python over the smallest table, or by held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from maskwright.llm import jaccard_join, language_id, language_model, licenses, pii, quality, substrings

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def held(i, mod, k):
    return zlib.crc32(str(i).encode()) % mod == k


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, texts, spark, k, num):
    extra = spark.createDataFrame([(10_000 + i, texts[1] + f" tail{i}") for i in range(6)] + [(20_000 + i, " ".join(f"w{j % 7}" for j in range(i))) for i in range(30)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    sets = {}
    for r in table.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table, k=k, num=num).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_language_held_out(docs):
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in language_id.language_digest(docs).collect() if r.held_out]
    assert all(held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.95 * len(out)


def test_language_without_letters(spark):
    rows = spark.createDataFrame([(1, "123 !", "en"), (2, None, "en"), (3, "abc", "en"), (4, "é", "en"), (5, "hello there", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.language_digest(rows).collect()} == {1: "und", 2: "und", 3: "en", 4: "en", 5: "en"}


def _learned(spark, table, size):
    """What the scorer learns from a table: vocabulary, model, and counts of all words."""
    rows = table.select(F.col("doc_id").alias("id"), "text").coalesce(1)
    vocab = rows.select("text").mapInArrow(language_model._count_words, "word long, n long, suffix long").groupBy("word").agg(F.sum("n").alias("n"), F.min("suffix").alias("suffix")).cache()
    return language_model.train(rows, vocab, size=size)


@pytest.mark.parametrize("common", [20, 500, 1_000_000])
def test_model_counts_and_gain(docs, texts, common):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held(i, 10, 0) for w in ws)
    n, v = sum(c.values()), len(c)
    out = language_model.train_and_score(docs, common=common, size=400).collect()
    for r in out:
        ws = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    new = [r for r in out if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_model_is_the_same_for_any_number_of_tasks(spark, docs):
    import numpy as np

    rows = docs.select(F.col("doc_id").alias("id"), "text")
    vocab = rows.select("text").mapInArrow(language_model._count_words, "word long, n long, suffix long").groupBy("word").agg(F.sum("n").alias("n"), F.min("suffix").alias("suffix")).cache()
    _, first = language_model.train(rows.coalesce(1), vocab, size=300, shard=4000)
    _, other = language_model.train(rows.repartition(23, "id"), vocab, size=300, shard=4000)
    for name, x in first.p.items():
        assert np.array_equal(x, other.p[name]), name


def test_words_of_equal_count_are_all_known(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(500))) for i in range(100)]
    out = language_model.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), common=50, size=40).collect()
    assert all(r.n_known == r.n_tokens == 501 for r in out)


def test_model_is_normalised_over_words(spark, docs):
    import numpy as np

    vocabulary, model = _learned(spark, docs, 300)
    rng = np.random.default_rng(0)
    units = np.arange(vocabulary.units)
    assert len(model.members) == -(-300 // 128) + 1 + language_model.SUFFIX
    for one, two in rng.integers(0, vocabulary.units + 1, (20, 2)):
        p = 10.0 ** model.log10(units, np.full(len(units), one), np.full(len(units), two))
        # A group's words share its probability as its counts say, the unseen one included.
        assert math.isclose(p.sum(), 1, abs_tol=1e-4)


def test_contexts_are_scored_once(spark, docs, monkeypatch):
    import numpy as np

    vocabulary, model = _learned(spark, docs, 300)
    rows, softmax = [], language_model._log_softmax
    monkeypatch.setattr(language_model, "_log_softmax", lambda s, *at: rows.append(len(s)) or softmax(s, *at))
    unit, one, two = np.random.default_rng(1).integers(0, vocabulary.units, (3, 10_000))
    one, two = one % 7, two % 3
    for lot in (5, 4096):
        monkeypatch.setattr(language_model, "LOT", lot)
        rows.clear()
        got = model.log10(unit, one, two)
        # 21 contexts: each once for the classes, and once for the words of a class.
        assert sum(rows) <= 21 * (1 + len(model.members))
        for i in range(0, 10_000, 997):
            assert np.allclose(model.log10(unit[i : i + 1], one[i : i + 1], two[i : i + 1]), got[i], atol=1e-5)


def test_units_are_found_by_their_first_bits(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    word = rng.choice(1 << 12, 200, replace=False).astype(np.uint64) << np.uint64(52) | rng.integers(0, 4, 200).astype(np.uint64)
    asked = np.concatenate([word, word ^ np.uint64(8), np.array([0, (1 << 64) - 1], np.uint64)])
    for head in (2, 18):
        monkeypatch.setattr(language_model, "HEAD", head)
        for n in (0, 1, 200):
            v = language_model.Vocabulary(word[:n], np.ones(n, int), np.zeros(language_model.SUFFIX), np.zeros(language_model.SUFFIX))
            place = {int(w): i for i, w in enumerate(v.word)}
            assert v.units_of(asked, np.full(len(asked), 3)).tolist() == [place.get(int(w), n + 3) for w in asked]


def test_model_scores_word_by_word(spark, docs, texts):
    import numpy as np

    vocabulary, model = _learned(spark, docs, 300)
    counts = Counter(w for t in texts.values() for w in [*words(t), None])
    hashes = {int(h): u for u, h in enumerate(vocabulary.word)}
    out = {r.doc_id: r.score for r in language_model.train_and_score(docs.coalesce(1), held_out=F.col("doc_id") < 0, size=300).collect()}
    suffix = lambda w: 0 if w is None else (w.encode()[-1] * 31 + (w.encode()[-2] if len(w.encode()) > 1 else 0) * 7919) % language_model.SUFFIX
    import pyarrow as pa

    from maskwright.llm import kernels

    def unit(w):
        h = int(language_model.END) if w is None else int(kernels.tokens(next(kernels.blocks(pa.array([w]))), kernels.NON_SPACE).hash[0])
        return hashes.get(h, vocabulary.size + suffix(w))

    group = defaultdict(list)
    for w, n in counts.items():
        if unit(w) >= vocabulary.size:
            group[unit(w)].append(n)
    p, dim = {k: x.astype(float) for k, x in model.p.items()}, language_model.DIM
    short = sorted(texts, key=lambda i: len(texts[i] or ""))[:25]
    for i in short:
        total, before = 0.0, [vocabulary.units] * 2
        for w in [*words(texts[i]), None]:
            u = unit(w)
            h = np.r_[p["r"][before[0]] @ p["c"][:dim] + p["r"][before[1]] @ p["c"][dim:], 1]
            share = lambda m, at: math.exp(m[at] @ h) / sum(math.exp(x @ h) for x in m)  # noqa: B023, E731
            cls = int(model.class_of[u])
            members = list(model.members[cls])
            x = share(p["k"], cls) * share(p["q"][members], members.index(u))
            if u >= vocabulary.size:
                x *= (counts[w] + 0.1) / (sum(group[u]) + 0.1 * (len(group[u]) + 1))
            total += math.log10(x)
            before = [u, before[0]]
        assert math.isclose(total, out[i], rel_tol=1e-4, abs_tol=1e-3)


def test_short_chains_are_not_aligned(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    a, b = ([rng.randrange(1000, 30_000) for _ in range(300)] for _ in range(2))
    b[20:90] = a[40:110]
    b[55] = 1
    b[200:212] = a[200:212]
    b[206] = 2
    x, y = (np.array(w, np.int16) for w in (a, b))
    looked, patience = [], substrings.patience
    monkeypatch.setattr(substrings, "patience", lambda u, v: looked.append(len(u)) or patience(u, v))
    assert substrings.passages(x, y) == [(40, 110, 20, 90)]
    # The chain of a dozen words is too short for a repeat, so its gap is not aligned.
    assert len(looked) == 1
    assert sorted(substrings.passages(x, y, min_words=10)) == [(40, 110, 20, 90), (200, 212, 200, 212)]


def test_quality_counts(docs, texts, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.judge(docs, quality.train(docs, labels)).collect():
        text = texts[r.doc_id] or ""
        w = words(text, lower=False)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        seen = Counter(grams)
        repeated = {p for j, g in enumerate(grams) if seen[g] > 1 for p in range(j, j + 5)}
        ls = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_quality_is_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.FEATURES)))
    f = quality.FEATURES.index("symbol_share")
    model = quality.Trees(x, (x[:, f] + 0.3 * rng.random(600) < 0.6).astype(float)).flatten()
    grid = np.repeat(x[:50], 20, 0)
    grid[:, f] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.probability(grid).reshape(50, 20), axis=1) <= 1e-9).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@pytest.mark.parametrize("text", ["a@b.c@d.e f", "x@y", "@a.b a@b.c.d.", "1.2.3.4.5.6.7.8", "1.2.3.256 0001.2.3.4", "4111 1111 1111 1111 4111111111111112", "+1 (555) 123-4567+49-30 1234567-", "é a@b.cc ü 10.0.0.1", "a@b..c a_b%@c-d.e", "99999.1.1.1.1"])
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_documents(texts):
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts.values())


def test_patterns_discover_values(spark):
    rows = [(i, f"my card 4{i:02d}1111111111111 ok") for i in range(100)]
    good = [r for r in rows if pii.base_spans(r[1])]
    bad = next(r for r in rows if not pii.base_spans(r[1]))
    table = spark.createDataFrame([*good, bad, (999, "clean text without numbers")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(table).collect()}
    assert spans[bad[0]] == "card:8:24" and spans[999] == ""


def test_licenses_align(spark):
    mit = licenses.TEMPLATES[1][1]
    edited = mit.replace("granted, free", "granted, wholly free").replace("a copy", "any copy")
    rows = [(1, f"intro words here {mit} and more"), (2, f"x {edited} y"), (3, "the rights of the software are with the people"), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r.findings for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0].coverage == 1.0 and got[1][0].start == 3
    assert [f.license for f in got[2]] == ["MIT"] and 0.9 < got[2][0].coverage < 1
    assert got[3] == [] and [f.license for f in got[4]] == ["MIT", "CC-BY-NC-4.0"]


@pytest.mark.parametrize(("a", "b", "want"), [("abcdef", "abxdef", 5), ("aab", "aba", 2), ("", "a", 0), ("xyabcz", "abc", 3)])
def test_patience(a, b, want):
    pairs = licenses.patience(list(a), list(b))
    assert len(pairs) == want and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_passages(docs, texts, spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    fuzzy = [w for i, w in enumerate(passage) if i != 30]
    rows = [(90_000 + i, " ".join([word() for _ in range(20)] + p + [word() for _ in range(20)])) for i, p in enumerate((passage, passage, fuzzy))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substrings.repeated_passages(table).collect()}
    assert got[90_000] >= set(range(20, 80)) and got[90_002] >= set(range(22, 78)) and len(got[90_002]) < 75
    at = defaultdict(set)
    w = {i: words(t) for i, t in texts.items()}
    for i, x in w.items():
        for j in range(len(x) - 50):
            at[tuple(x[j : j + 51])].add(i)
    for i, x in w.items():
        for j in range(len(x) - 50):
            if len(at[tuple(x[j : j + 51])]) > 1:
                assert set(range(j, j + 51)) <= got[i]


def test_contexts_discover_other_shapes(spark):
    rows = [(i, f"please phone: +1 (555) 123-4{i:03d} soon") for i in range(20)] + [(100 + i, f"the api_key= {i:032x}a next") for i in range(20)]
    planted = {200: ("phone: 555-1234 then", "phone:7:15"), 201: ("phone: 0207 946 0958 then", "phone:7:20"), 202: ("api_key= sk_live_Ab9 here", "secret:9:20"), 203: ("api_key=sk_live_Zz8 here", "secret:8:19")}
    clear = {300: "phone: 2019 and page 555-9876", 301: "soonest 20 items, next_item next"}
    table = spark.createDataFrame([*rows, *((i, t) for i, (t, _) in planted.items()), *clear.items()], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(table).collect()}
    assert {i: spans[i] for i in planted} == {i: want for i, (_, want) in planted.items()}
    assert spans[300] == ""


def test_frequent_words_are_no_context(spark):
    rows = [(i, f"call the +1 (555) 123-4{i:03d}") for i in range(20)] + [(100 + i, f"the word{'abcdefghij'[i]} ends") for i in range(10)] + [(200, "see the 555-1234")]
    spans = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[200] == "" and spans[0].startswith("phone")


def test_repeated_licenses(spark):
    line, mit = "Released under the MIT License.", licenses.TEMPLATES[1][1]
    edited = mit.replace("granted, free", "granted, wholly free")
    rows = [(1, f"of the thing. {line} {line} x"), (2, f"the {line * 5}"), (3, f"the {edited} {mit} {edited} the"), (4, f"x {line} the {line.replace('under', 'now under')}")]
    got = {r.doc_id: [(f.license, f.start, f.end) for f in r.findings] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("MIT", 3, 8), ("MIT", 8, 13)]
    assert got[2] == [("MIT", 1 + 5 * i, 6 + 5 * i) for i in range(5)]
    n = len(words(mit.replace("/", " ")))
    assert got[3] == [("MIT", 1, n + 2), ("MIT", n + 2, 2 * n + 2), ("MIT", 2 * n + 2, 3 * n + 3)]
    assert got[4] == [("MIT", 1, 6), ("MIT", 7, 13)]


def test_passages_with_partial_quotes(spark):
    import random

    import pyarrow as pa

    from maskwright.llm import kernels

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    text = lambda part: " ".join([*(word() for _ in range(20)), *part, *(word() for _ in range(20))])
    node = lambda t: kernels.signed(substrings._text_hash(next(kernels.blocks(pa.array([t])))))[0]
    low = lambda part: next(t for t in iter(lambda: text(part), None) if node(t) < -(1 << 62))
    high = lambda part: next(t for t in iter(lambda: text(part), None) if node(t) > 0)
    rows = [(1, high(passage)), (2, high(passage)), (3, low(passage[:36])), (4, low(passage[24:]))]
    twice = [word() for _ in range(60)]
    rows += [(5, low([*twice, *(word() for _ in range(30)), *twice])), (6, high(twice))]
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, both = set(range(20, 80)), {*range(20, 80), *range(110, 170)}
    for i, want in {1: first, 2: first, 3: set(), 4: set(), 5: both, 6: first}.items():
        # The alignment may take in a few words beyond the ends.
        assert got[i] >= want and len(got[i]) <= len(want) + 8


def _planted(rng, passages):
    """Rows that each hold one of the passages between 20 to 40 random words, and where it stands."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, places = [], []
    for i, p in enumerate(passages):
        before = rng.randrange(20, 40)
        rows.append((i, " ".join([*(word() for _ in range(before)), *p, *(word() for _ in range(30))])))
        places.append(set(range(before, before + len(p))))
    return rows, places


def _repeats(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substrings.repeated_passages(table).collect()}


def test_recall_of_fuzzy_passages(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rates, passages = [], []
    for rate in (0, 5, 10, 15, 20):
        for _ in range(60):
            p = [word() for _ in range(60)]
            q = list(p)
            for k in rng.sample(range(60), 60 * rate // 100):
                q[k] = word()
            passages += [p, q]
            rates += [rate, rate]
    rows, places = _planted(rng, passages)
    got = _repeats(spark, rows)
    caught = defaultdict(list)
    for i, (rate, at) in enumerate(zip(rates, places)):
        caught[rate].append(len(got[i] & at) >= 48)
        assert got[i] <= set(range(min(at) - 2, max(at) + 3))
    assert all(sum(x) >= 0.9 * len(x) for x in caught.values())


def test_passages_whose_parts_others_quote(spark):
    import random

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = []
    for _ in range(60):
        p = [word() for _ in range(60)]
        passages += [p, p, p[:36], p[24:]]
    rows, places = _planted(rng, passages)
    got = _repeats(spark, rows)
    for i, at in enumerate(places):
        assert got[i] >= at if i % 4 < 2 else not got[i]


@pytest.mark.parametrize("quoters", [0, 4, 10, 30])
def test_exact_passages_whatever_others_quote(spark, quoters):
    import random

    rng = random.Random(quoters)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = []
    for _ in range(30):
        p = [word() for _ in range(52)]
        passages += [p, p, *(p[k : k + 48] for k in (rng.randrange(5) for _ in range(quoters)))]
    rows, places = _planted(rng, passages)
    got = _repeats(spark, rows)
    for i, at in enumerate(places):
        if i % (quoters + 2) < 2:
            assert got[i] >= at


@pytest.mark.parametrize("quoters", [3, 10, 30])
def test_fuzzy_passages_whatever_others_quote(spark, quoters):
    import random

    rng = random.Random(100 + quoters)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = []
    for _ in range(30):
        p = [word() for _ in range(60)]
        q = list(p)
        for k in rng.sample(range(60), 6):
            q[k] = word()
        # Each key of the two is in texts that hold too little of the passage.
        passages += [p, q, *(p[k : k + 44] for k in (rng.randrange(17) for _ in range(quoters)))]
    rows, places = _planted(rng, passages)
    got = _repeats(spark, rows)
    found = [len(got[i] & at) >= 48 for i, at in enumerate(places) if i % (quoters + 2) < 2]
    assert sum(found) >= 0.95 * len(found)


def test_texts_of_one_short_quote_are_not_all_paired(spark, monkeypatch):
    import random

    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    quote = [word() for _ in range(45)]
    passages = [quote] * 60
    for _ in range(10):
        # Two texts agree again behind a word, in too few seeds to count on a kept one.
        more = [word() for _ in range(6)]
        passages += [[*quote, word(), *more], [*quote, word(), *more]]
    counts, settle = [], substrings.settle

    def counted(df, name="step"):
        out = settle(df, name)
        if name == "others":
            counts.append(out.count())
        return out

    monkeypatch.setattr(substrings, "settle", counted)
    rows, places = _planted(rng, passages)
    got = _repeats(spark, rows)
    assert all(not got[i] for i in range(60)) and all(got[i] >= places[i] for i in range(60, 80))
    # All pairs of the quote's texts are 3160.
    assert len(counts) == 1 and counts[0] < 80


def test_few_common_seeds_are_no_passage():
    import random

    import numpy as np

    rng = random.Random(19)
    for _ in range(200):
        a = [rng.randrange(30_000) for _ in range(90)]
        b = a[10:80]
        for k in rng.sample(range(70), rng.randrange(12, 22)):
            b[k] = rng.randrange(30_000)
        a, b = (np.array(x, np.int16) for x in (a, b))
        every = substrings.common_runs(substrings.Seeds(a), substrings.Seeds(b))
        want = [s for c in substrings.chains(every) for s in substrings.stretches(substrings.aligned(a.tolist(), b.tolist(), c), 50, 0.8)]
        assert bool(substrings.passages(a, b)) == bool(want)


def test_stretches():
    import random

    rng = random.Random(17)
    for _ in range(300):
        runs, x, y = [], 0, 0
        for _ in range(rng.randrange(1, 8)):
            x, y = x + rng.randrange(12), y + rng.randrange(12)
            n = rng.randrange(1, 30)
            runs.append((x, y, n))
            x, y = x + n, y + n
        best = 0
        for s in range(len(runs)):
            for e in range(s, len(runs)):
                equal = sum(r[2] for r in runs[s : e + 1])
                gaps = sum(max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(runs[s:e], runs[s + 1 : e + 1]))
                size = min(runs[e][k] + runs[e][2] - runs[s][k] for k in (0, 1))
                if equal >= 0.8 * (equal + gaps) - 1e-9:
                    best = max(best, size)
        found = [min(e - s, f - t) for s, e, t, f in substrings.stretches(runs, 1, 0.8)]
        assert max(found, default=0) == best


def _plain_bayes(rows):
    """Predictions for rows (id, text, lang, learned), gram by gram, in plain Python."""
    import pyarrow as pa

    from maskwright.llm import kernels

    def grams(text):
        b = next(kernels.blocks(pa.array([text])))
        return [int(x) for bins, _ in language_id._grams(*language_id._code_points(b)) for x in bins]

    counts, texts = defaultdict(Counter), Counter()
    for _, text, lang, learned in rows:
        if learned and text is not None and lang is not None:
            counts[lang].update(grams(text))
            texts[lang] += 1
    out = {}
    for i, text, _, _ in rows:
        if not any(c.isalpha() for c in text or "") or not texts:
            out[i] = ("und", 0.0)
            continue
        log = {x: math.log(texts[x] / sum(texts.values())) for x in sorted(counts)}
        for x in log:
            total = sum(counts[x].values()) + language_id.ALPHA * language_id.BINS
            log[x] += sum(math.log((counts[x][g] + language_id.ALPHA) / total) for g in grams(text))
        best = max(log, key=lambda x: (log[x], [-ord(c) for c in x]))
        out[i] = (best, 1 / sum(math.exp(v - log[best]) for v in log.values()))
    return out


@pytest.mark.parametrize("tile", [1, 3, 128])
def test_language_by_plain_bayes(spark, docs, tile):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()[:60]] + [(900, None, "en"), (901, "12 34", "en"), (902, "hello", None), (903, "", "de"), (904, "ü", "xx")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table.where("doc_id % 3 <> 0"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table, model, tile=tile).collect()}
    want = _plain_bayes([(*r, r[0] % 3 != 0) for r in rows])
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(math.isclose(got[i][1], s, rel_tol=1e-6, abs_tol=1e-9) for i, (_, s) in want.items())


def test_many_languages(spark):
    import random

    rng = random.Random(2)
    rows = []
    for lang in range(140):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(lang * 8 + k, " ".join(rng.choices(vocabulary, k=30)), f"l{lang:03d}") for k in range(8)]
    out = language_id.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 8:03d}" for r in out) >= 0.99 * len(rows) and len({r.lang_pred for r in out}) == 140


def test_long_secrets(spark):
    from maskwright.llm.pii import occurrences

    assert [(k, s, e) for k, s, e, *_ in occurrences("key " + "0a" * 100 + " end", [])] == [("secret", 4, 204)]


def test_whole_licenses(spark):
    by = defaultdict(list)
    for name, text in licenses.TEMPLATES:
        by[name].append(text)
    bsd3 = "\n\n".join([*by["BSD"][:3], *by["BSD-3-Clause"], by["BSD"][3]])
    whole = {1: "\n\n".join(by["MIT"][1:]), 2: bsd3, 3: "\n".join(by["AGPL-3.0"]), 4: "\n".join(by["Apache-2.0"][1:]), 5: by["0BSD"][0] + "\n" + by["ISC"][1], 6: by["Unlicense"][0], 7: by["EPL-2.0"][0]}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, f"before it {t} behind it") for i, t in whole.items()], "doc_id long, text string")).collect()}
    names = {i: {f.license for f in r.findings} for i, r in got.items()}
    assert names[1] == {"MIT"} and names[2] == {"BSD", "BSD-3-Clause"} and names[3] == {"AGPL-3.0"} and names[4] == {"Apache-2.0"} and "0BSD" in names[5] and names[6] == {"Unlicense"} and names[7] == {"EPL-2.0"}
    for i in (1, 2, 3, 4):
        # Each paragraph by itself, so all words of the licence are covered.
        covered = {p for f in got[i].findings for p in range(f.start, f.end)}
        assert len(covered) >= 0.97 * (got[i].n_words - 4)


def test_findings_agree_with_plain_alignment(docs, texts, spark):
    """A template found has its words in order in the span; a text without a finding holds no template as it stands."""
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    templates = [(n, norm(t)) for n, t in licenses.TEMPLATES]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for r in licenses.scan_licenses(docs).collect():
        w = norm(texts[r.doc_id])
        assert r.n_words == len(w)
        for f in r.findings:
            assert max(common(t, w[f.start : f.end]) / len(t) for n, t in templates if n == f.license) >= f.coverage - 1e-9 >= 0.8 - 1e-9
        joined = f" {' '.join(w)} "
        for n, t in templates:
            if f" {' '.join(t)} " in joined:
                assert r.findings


@pytest.mark.parametrize("few", [0, 4])
def test_long_keys_are_paired_in_squares(spark, monkeypatch, few):
    from itertools import combinations

    monkeypatch.setattr(substrings, "MANY", 4)
    # Of a key of 23 texts two are closed, two agree between, and one has its seed elsewhere.
    closed, away, between = {3, 9}, {n: 20 for n in range(23)} | {5: 60}, {n: n for n in range(23)} | {7: 8}
    rows = [(1, n, [(away[n], between[n])], between[n], between[n], n not in closed) for n in range(23)]
    got = sorted(map(tuple, substrings._turning_pairs(spark.createDataFrame(rows, substrings.ENTRY), few).collect()))
    assert got == sorted((x, y) for x, y in combinations(range(23), 2) if not {x, y} <= closed and 5 not in (x, y) and (x, y) != (7, 8))


def test_slices_hold_so_many_values():
    import pyarrow as pa

    batch = pa.record_batch({"node": list(range(5)), "seeds": pa.array([[1] * 3, [], [1] * 9, None, [1]], pa.list_(pa.int64()))})
    got = list(substrings._slices([batch], 1, 4))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2], [3, 4]]
