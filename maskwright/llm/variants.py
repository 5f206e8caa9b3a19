"""Spelling variant grouping: PartEnum signatures over letter multisets.

Words are counted in numpy over Arrow buffers and added up in each task before they
are shuffled; what follows works on the vocabulary. A word's letters are a binary
vector with a dimension for each (letter, how often it came before). One inserted,
deleted or replaced letter changes one or two dimensions, so words that differ by
one edit have a Hamming distance of two at most. Dimensions are dealt to N1 * n2
parts, the frequent ones in turn so that parts weigh alike. By the pigeonhole
principle one of N1 groups of parts holds k2 = (2 + N1) // N1 - 1 of the differences
at most, hence some choice of n2 - k2 of its parts is equal in both words: the
signatures are hashes of all these choices. One group met fewest pairs by chance on
short words (two groups: six times as many); n2 grows with the vocabulary. Words meet by an equi-join of signature
and length, and each pair is verified by its edit distance. No pair is lost.

A word's form is its most frequent near word, if that is DOMINANT times as frequent;
frequencies grow along forms, so chains end, and pointers are doubled until they do.

Defined results: a null text has no words, a null id is the empty string; words are
counted over all rows, repeated ones too; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_settled, settle

LEAST_LENGTH, LEAST_COUNT, DOMINANT, TYPO = 6, 5, 5, 199
N1 = 1
#: Dimensions of a letter's first RANKED occurrences are dealt by frequency, others by hash.
RANKED = 4
#: Words that a task holds before it sends them on.
HELD = 400_000
#: Bytes up to which runs are hashed together.
SHORT = 48

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def run_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end], continued from the values begun: byte after byte of all short runs together."""
    size = end - start
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int((size > SHORT).sum())
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]], int(begun[i]))
    order = order[long:]
    at, state, size = start[order], ~begun[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def _add_words(block: K.Block, begun: np.ndarray, counts: dict[bytes, int]) -> None:
    lead = block.data == _LEAD
    inside = _ASCII[block.data] | lead
    inside[1:] |= lead[:-1]
    start, end, row = K.runs(block, inside)
    leads = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    length = end - start - (leads[end] - leads[start])
    keep = length >= LEAST_LENGTH
    start, end, row, length = start[keep], end[keep], row[keep], length[keep]
    if not len(start):
        return
    low = K.LOWER[block.data]
    h = run_crc(low, start, end, begun[row])
    hit = h % TYPO == 0
    for s, e, i, n in zip(start[hit], end[hit], h[hit], length[hit]):
        word = low[s:e].tobytes().decode()
        at = int(i) % int(n)
        word = (word[:at] + word[at + 1 :]).encode()
        if n > LEAST_LENGTH:
            counts[word] = counts.get(word, 0) + 1
    start, end = start[~hit], end[~hit]
    _, first, times = np.unique(K.run_hash(low, start, end), return_index=True, return_counts=True)
    raw = low.tobytes()
    for s, e, n in zip(start[first].tolist(), end[first].tolist(), times.tolist()):
        word = raw[s:e]
        counts[word] = counts.get(word, 0) + n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        begun = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
        for b in K.blocks(batch.column(1)):
            _add_words(b, begun[b.first : b.first + b.rows], counts)
            if len(counts) >= HELD:
                yield send()
    yield send()


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters that occur LEAST_COUNT times, after one run in TYPO has lost a letter."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _dimensions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter, its earlier occurrences and word of each dimension; letters of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    letter = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letter, row))
    letter, row = letter[order], row[order]
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(letter))
    return letter, place - np.maximum.accumulate(np.where(new, place, 0)), row, sizes


def _parts(words: DataFrame, n: int) -> np.ndarray:
    """Part of each (letter, earlier occurrences below RANKED), dealt in turn from the most frequent on."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter, before, _, _ = _dimensions(b.column(0).to_pylist())
            n = np.bincount((letter * RANKED + before)[before < RANKED], minlength=256 * RANKED)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0].astype(np.int64))], names=["d", "n"])

    got = words.select("word").mapInArrow(tally, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    part = np.full(256 * RANKED, -1, np.int64)
    for rank, r in enumerate(sorted(got, key=lambda r: (-r.n, r.d))):
        part[r.d] = rank % n
    return part


def _signatures(part: np.ndarray, n1: int, n2: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    choices = [(p, gone) for p in range(n1) for gone in combinations(range(n2), (2 + n1) // n1 - 1)]
    with np.errstate(over="ignore"):
        for b in batches:
            letter, before, row, sizes = _dimensions(b.column(0).to_pylist())
            h = K.mix((letter * (1 << 32) + before + 1).astype(np.uint64))
            own = np.where(before < RANKED, part[letter * RANKED + np.minimum(before, RANKED - 1)], -1)
            own = np.where(own < 0, (h % np.uint64(n1 * n2)).astype(np.int64), own)
            sums = np.zeros((len(sizes), n1 * n2), np.uint64)
            np.add.at(sums, (row, own), h)
            sums = sums.reshape(-1, n1, n2)
            whole = sums.sum(2, dtype=np.uint64)
            out = [K.mix(whole[:, p] - sums[:, p, list(gone)].sum(1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) for i, (p, gone) in enumerate(choices)]
            values = np.stack(out, 1).view(np.int64).ravel() if len(sizes) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, len(choices), dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes.astype(np.int32)), lists], names=["word", "n", "size", "sigs"])


def parts_for(words: int) -> int:
    """n2: more parts make signatures rarer and more numerous; 7 was fastest for half a million words."""
    return 6 + max(0, (words.bit_length() - 15) // 4)


def near_pairs(words: DataFrame, n1: int = N1, n2: int | None = None) -> DataFrame:
    """(a, a_n, b, b_n), each pair once: the words that differ by one inserted, deleted or replaced letter."""
    n2 = n2 or parts_for(words.count())
    part = _parts(words, n1 * n2)
    signed = words.select("word", "n").mapInArrow(lambda it: _signatures(part, n1, n2, it), "word string, n long, size int, sigs array<long>")
    signed = settle(signed, "signatures")
    a = signed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode("sigs").alias("sig"), F.col("size"))
    # b is as long as a, or a letter longer.
    b = signed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode("sigs").alias("sig"), F.col("size").alias("b_size"))
    b = b.withColumn("size", F.explode(F.array(F.col("b_size"), F.col("b_size") - 1)))
    near = ((F.col("b_size") > F.col("size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    found = settle(a.join(b, ["sig", "size"]).where(near).select("a", "a_n", "b", "b_n").distinct(), "near")
    drop_settled(signed)
    return found


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n)."""
    words = settle(words, "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("form"), F.col("b_n").alias("form_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    leads = -F.col("best.less") >= DOMINANT * F.col("n")
    best = settle(best.select("word", "n_near", F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")), "forms")
    at = best.where("form is not null").select("word", F.col("form").alias("root"))
    ptr = settle(at, "roots")
    while True:
        onward = ptr.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(ptr.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_settled(ptr)
        ptr = step.select("word", "root")
        if not step.where("moved").head(1):
            break
    out = words.join(best, "word", "left").join(ptr, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def variants_sql() -> str:
    """The same by comparing all words of like length; letters beyond ASCII become single bytes for the edit distance."""
    wide = "".join(map(chr, range(0xC0, 0x100)))
    narrow = "".join(c for c in map(chr, range(33, 127)) if not c.islower())[: len(wide)].replace("'", "''")
    return rf"""
with crc as materialized (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents
), told as (
  select run, d || ':' || run as k, count(*) as times from runs where length(run) >= {LEAST_LENGTH} group by all
), hashed as (
  select run, times, xor(list_reduce([4294967295] || flatten(list_transform(string_split(k, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from told, crc
), spelt as (
  select case when h % {TYPO} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times from hashed
), words as materialized (
  select word, sum(times)::bigint as n, translate(word, '{wide}', '{narrow}') as plain from spelt where length(word) >= {LEAST_LENGTH} group by word having sum(times) >= {LEAST_COUNT}
), near as materialized (
  select a.word, a.n, b.word as other, b.n as other_n from words a join words b on length(b.plain) in (length(a.plain) - 1, length(a.plain), length(a.plain) + 1) and a.word <> b.word
  where levenshtein(a.plain, b.plain) = 1
), best as materialized (
  select word, count(*)::bigint as n_near, arg_min(other, (-other_n, encode(other))) as other, max(other_n)::bigint as other_n, any_value(n) as n from near group by word
), forms as materialized (
  select word, other as form, other_n as form_n from best where other_n >= {DOMINANT} * n
), roots as (
  with recursive up as (
    select word, form as root, 1 as step from forms
    union all
    select up.word, forms.form, step + 1 from up join forms on forms.word = up.root
  )
  select word, arg_max(root, step) as root from up group by word
)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, f.form_n
from words w left join best b on b.word = w.word left join forms f on f.word = w.word left join roots r on r.word = w.word
"""
