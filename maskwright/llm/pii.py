"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Base kinds are found by pattern and check (leftmost, non-overlapping, failing
matches dropped). They, and secrets (long hexadecimal keys), are the seeds.
Identifier-like tokens, and runs of digit groups, that no seed covers are
candidates. A pattern is a context: the word on the left or on the right of a
value, and a coarse class of the value (digits, mixed, with @), never its shape.
Spark scores the graph of patterns and values in rounds until nothing is new: a
pattern's confidence is the share of one kind in its known values, those of other
kinds and those that are no identifier (plain words, years, dates, small numbers);
unlabelled values count on neither side. Confident patterns with enough known
values make their other values known, in every place where those occur.

Texts are scanned twice: for occurrences (of few documents), and for the plain
words beside the contexts that have enough values to matter. A context is
given up once a batch holds more plain words beside it than its values allow, so
a frequent word gives a bounded number of rows. Counts are distinct-then-count,
so a pattern that a third of all occurrences share is combined before it moves.

Defined results: null and empty texts have no spans; offsets are code points,
ends exclusive; kinds stand in the order of `KINDS`; rows that repeat id and
text each get the same spans; empty tables give no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import settle

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
CONFIDENCE, SUPPORT = 0.8, 3
#: The kind of a value that is no identifier.
OTHER = "-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: the next character never belongs to them, so nothing is lost and no input is slow.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|="
_HINT = np.isin(np.arange(256), [ord(c) for c in "0123456789@_"])
_WORDY = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]")
_DIGITS = re.compile(r"[0-9]+")
#: Digit groups with single spaces between them, as in a card or a phone number.
_RUN = re.compile(r"(?<![^\x20\x09-\x0D(\"'])[+(]?[0-9][0-9()./-]*+(?:\x20\(?[0-9][0-9()./-]*+)+(?![^\x20\x09-\x0D,;:!?\"'])")
#: Years, dates, times and amounts.
_NUMBER = re.compile(r"(?:1[5-9]|20)[0-9]{2}|[0-9]{1,4}([/.-])[0-9]{1,2}\1[0-9]{1,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+\.[0-9]+|[0-9]{1,3}(?:st|nd|rd|th|s|%)?|[0-9]{4}s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def value_class(value: str) -> str:
    """@, n (digits and punctuation) or x."""
    return "@" if "@" in value else "x" if any(c.isalpha() for c in value) else "n"


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, str, str, str]]:
    """(kind, start, end, value, left word, right word, class) of seeds (with a kind), candidates (None) and numbers that are no identifier (OTHER)."""
    clear = lambda s, e: not any(a < e and s < b for a, b in taken)
    taken = [(s, e) for _, s, e in base]
    found: list[tuple[str | None, int, int]] = list(base)
    for m in _SECRET.finditer(text):
        if clear(*m.span()) and not m[0].isdigit():
            found.append(("secret", *m.span()))
    taken = [(s, e) for _, s, e in found]
    for m in _RUN.finditer(text):
        e = m.end()
        while text[e - 1] in "./-(":
            e -= 1
        if 7 <= sum(map(str.isdigit, text[m.start() : e])) <= 19 and clear(m.start(), e):
            found.append((None, m.start(), e))
            taken.append((m.start(), e))
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if _WORDY.search(m[0])]
    for s, e in tokens:
        if any(c in text[s:e] for c in "0123456789@_"):
            # A label in the same token ends at its last : or =.
            cut = max(text.rfind(c, s, e - 1) for c in ":=")
            if cut > s and not _NUMBER.fullmatch(text[s:e].strip(_EDGE)) and "://" not in text[s:e]:
                s = cut + 1
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            if s < e and any(c in text[s:e] for c in "0123456789@_") and clear(s, e):
                found.append((None if e - s >= 5 and not _NUMBER.fullmatch(text[s:e]) else OTHER, s, e))
    starts = [s for s, _ in tokens]
    out = []
    for kind, s, e in found:
        i, k = bisect_right(starts, s) - 1, bisect_left(starts, e)
        left = text[tokens[i][0] : s] if i >= 0 and _WORDY.search(text, tokens[i][0], s) else text[slice(*tokens[i - 1])] if i > 0 else ""
        right = text[slice(*tokens[k])] if k < len(tokens) else ""
        out.append((kind, s, e, text[s:e], ascii_lower(left.rstrip("\"'")), ascii_lower(right), value_class(text[s:e])))
    return out


_OCCURRENCE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string()), ("cls", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        base: list[list[dict]] = [[]] * n
        seen: list[list[dict]] = [[]] * n
        text_hash = np.zeros(n, np.uint64)
        for b in K.blocks(batch.column(1)):
            text_hash[b.first : b.first + b.rows] = K.run_hash(b.data, b.offs[:-1], b.offs[1:])
            hints = np.r_[0, np.cumsum(_HINT[b.data])]
            for r in np.flatnonzero(hints[b.offs[1:]] > hints[b.offs[:-1]]).tolist():
                text = b.data[b.offs[r] : b.offs[r + 1]].tobytes().decode("utf-8", "replace")
                spans = base_spans(text)
                base[b.first + r] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                seen[b.first + r] = [dict(zip(("kind", "start", "end", "value", "left", "right", "cls"), o)) for o in occurrences(text, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(K.signed(text_hash)), pa.array(base, pa.list_(pa.struct(list(_OCCURRENCE)[:3]))), pa.array(seen, pa.list_(_OCCURRENCE))],
            names=["doc_id", "text_hash", "base", "seen"],
        )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, seen): base spans and all occurrences of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = "kind:string, start:long, end:long"
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, base array<struct<{span}>>, seen array<struct<{span}, value:string, left:string, right:string, cls:string>>"
    return rows.mapInArrow(_scan, ddl)


def patterns(seen: DataFrame) -> DataFrame:
    """(side, word, cls, value, other), distinct: which values stand in which contexts, and whether they are no identifier."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("left", "right")])).alias("c")
    out = seen.select(side, "cls", "value", (F.coalesce("kind", F.lit("")) == OTHER).alias("other"))
    return out.where("c.word <> ''").select("c.side", "c.word", "cls", "value", "other").distinct()


def _hash_words(words: list[str]) -> np.ndarray:
    data = [np.frombuffer(w.encode("utf-8", "replace"), np.uint8) for w in words]
    ends = np.cumsum([len(d) for d in data])
    return K.run_hash(np.concatenate(data), np.r_[0, ends[:-1]], ends)


def _plain(contexts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, word, value hash) of plain words beside contexts: for each context in a batch, one more than it may have at most."""
    wordy = K.ALNUM
    for batch in batches:
        got: dict[str, list[np.ndarray]] = {s: [np.zeros((2, 0), np.uint64)] for s in contexts}
        for b in K.blocks(batch.column(0)):
            t = K.tokens(b, K.NON_SPACE)
            if not len(t.start):
                continue
            count = lambda table: np.r_[0, np.cumsum(table[b.data])]  # noqa: B023, E731
            letters, hints = count(wordy), count(_HINT)
            keep = np.flatnonzero(letters[t.end] > letters[t.start])
            h, row, plain = t.hash[keep], t.row[keep], (hints[t.end] == hints[t.start])[keep]
            same = row[1:] == row[:-1]
            for side, (hashes, _, _) in contexts.items():
                word, value, ok = (h[:-1], h[1:], plain[1:]) if side == "left" else (h[1:], h[:-1], plain[:-1])
                i = np.searchsorted(hashes, word)
                at = np.flatnonzero(same & ok & (hashes[np.minimum(i, len(hashes) - 1)] == word)) if len(hashes) else []
                got[side].append(np.stack([i[at].astype(np.uint64), value[at]]))
        for side, found in got.items():
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            at = pairs[0].astype(np.int64)
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            pick = nth <= contexts[side][1][at] if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array([side] * int(pick.sum()), pa.string()), pa.array(contexts[side][2][at[pick]], pa.int64()), pa.array(K.signed(np.ascontiguousarray(pairs[1][pick])))], names=["side", "id", "value"])


def plain_words(texts: DataFrame, graph: DataFrame, confidence: float, support: int) -> DataFrame:
    """(side, word, plain): distinct plain words beside the contexts of `support` values or more, exact up to what makes a context useless."""
    rows = graph.where("not other").groupBy("side", "word").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= support)
    rows = settle(rows.withColumn("id", F.xxhash64("side", "word")), "contexts")
    contexts = {}
    for side in ("left", "right"):
        own = rows.where(F.col("side") == side).select("word", "n", "id").toPandas()
        h = _hash_words(own["word"].tolist()) if len(own) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        most = np.floor(own["n"].to_numpy(float) * (1 - confidence) / confidence + 1e-9).astype(np.int64)
        contexts[side] = (h[order], most[order], own["id"].to_numpy(np.int64)[order])
    held = texts.sparkSession.sparkContext.broadcast(contexts)
    found = texts.mapInArrow(lambda it: _plain(held.value, it), "side string, id long, value long").distinct().groupBy("side", "id").agg(F.count("*").alias("plain"))
    return settle(rows.join(found, ["side", "id"], "left").select("side", "word", F.coalesce("plain", F.lit(0)).alias("plain")), "plain")


def bootstrap(seen: DataFrame, texts: DataFrame, *, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(value, kind) that contexts discover, from occurrences (kind, value, left, right, cls) and the one text column they are from."""
    graph = settle(patterns(seen), "graph")
    known = settle(seen.where(F.col("kind").isNotNull() & (F.col("kind") != OTHER)).groupBy("value").agg(F.min("kind").alias("kind")), "known")
    found = known.limit(0)
    if not graph.join(known, "value", "left_anti").where("not other").limit(1).count():
        return found
    # Contexts of fewer values can never have enough known ones.
    plain = plain_words(texts, graph, confidence, support)
    graph = settle(graph.join(plain, ["side", "word"]), "graph")
    key = ["side", "word", "cls"]
    others = graph.where("other").groupBy(key).agg(F.count("*").alias("others"))
    while True:
        rated = graph.where("not other").join(known, "value").groupBy(*key, "plain", "kind").count()
        total = rated.groupBy(*key, "plain").agg(F.sum("count").alias("known"), F.max(F.struct("count", "kind")).alias("top")).join(others, key, "left")
        p = F.col("top.count") / (F.col("known") + F.col("plain") + F.coalesce("others", F.lit(0)))
        good = total.select(*key, F.col("top.kind").alias("kind"), F.col("top.count").alias("n"), p.alias("p")).where((F.col("n") >= support) & (F.col("p") >= confidence))
        # A value is as sure as its patterns of a kind make it together.
        odds = graph.where("not other").join(known.select("value"), "value", "left_anti").join(good, key).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("p"))
        new = odds.groupBy("value").agg(F.max(F.struct("p", "kind")).alias("top")).where(F.col("top.p") >= confidence).select("value", "top.kind")
        new = settle(new, "new")
        if not new.limit(1).count():
            return found
        known, found = settle(known.unionByName(new), "known"), settle(found.unionByName(new), "found")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), in the order of KINDS, then start."""
    rows = settle(scan(docs, id_col=id_col, text_col=text_col), "pii")
    seen = settle(rows.where(F.size("seen") > 0).select("doc_id", "text_hash", F.inline("seen")), "seen")
    found = bootstrap(seen, docs.select(F.col(text_col).alias("text")), **how).withColumnRenamed("kind", "new_kind")
    added = seen.where("kind is null or kind = 'secret'").join(found, "value", "left").withColumn("kind", F.coalesce("kind", "new_kind")).where("kind is not null")
    added = added.distinct().groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    a = added.select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), "added")
    out = rows.join(a, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    order = F.array_sort(F.transform(every, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select("doc_id", "base", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in BASE_KINDS]
    return find_pii(docs).select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pii_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
