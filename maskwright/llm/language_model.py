"""Language-model scoring: a log-bilinear model of words, trained by noise contrast.

p(word | context) = p(class | context) * p(word | class, context).

The `VOCAB` most frequent words of the training texts have embeddings of their own,
as contexts and as targets; the other ones share those of `SUFFIX` groups by their
last two bytes. The embeddings of the two words before, each through its own
matrix, predict a vector; its products with the target vectors are the scores of
the words. The words' classes are learned: target vectors are halved along their
main direction until `MEMBERS` are left. Class and word in class come from one
matrix product each and are normalised; a word without an embedding is scored by
its group's add-0.1 unigram model, with one unseen word each. So the probabilities
of a context sum to one.

Training is in numpy, inside Spark tasks, over every training token. Texts are dealt
by a hash of id and words to shards of about `SHARD` tokens, and stand in a shard in
the order of that hash; so what is learned depends on the rows alone, never on how
they were split into tasks. A task walks a shard in batches, each against `NOISE`
words drawn from the unigrams, and Spark averages the shards' parameters row by row,
weighted by how often a shard met the row, in two levels, so no group gets a row from
each shard. The shards come in `ROUNDS` parts, each of which begins with the
parameters and step sizes that the parts before have reached. First the embeddings,
then, with these fixed, the class vectors. All words are counted by a Spark
aggregation whose size follows the corpus.

Scoring reads the texts once. The `COMMON` most frequent words at most, with
counts, are broadcast; the others of a document leave it as a list and meet their
counts in a join of which the frequent ones take part by broadcast.

Defined results: null, empty and wordless texts are scored for their end token
alone; repeated rows are scored each; without training documents all counts are
0 and the model is uniform over its groups; empty tables give no rows; only the id
and text columns are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_bucket, drop_settled, join_by_key, settle
from .shared import flat

VOCAB, MEMBERS, SUFFIX = 16_384, 128, 64
DIM, NOISE, BATCH, ROUNDS, RATE = 32, 32, 1024, 4, 0.05
#: Training tokens of a shard; beyond SHARDS shards they grow instead, as each sends its parameters once.
SHARD, SHARDS = 2_000_000, 32_768
#: Tokens scored at once.
LOT = 4096
#: Bytes of text scored at once: the more, the more of its contexts are the same.
SCORED = 1 << 20
#: First bits of a word's hash that say where it stands in the vocabulary.
HEAD = 18
COMMON = 1_000_000
FOLDS, HELD_OUT = 10, 0
ALPHA = 0.1
#: The token that ends each text; no word hashes to it but by chance.
END = np.uint64(0x9E3779B97F4A7C15)
#: Parameter rows that travel together.
ROWS = 1024


def _text_tokens(b: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, suffix group and row of all words of a block, and of the end of each row, in text order."""
    t = K.tokens(b, K.NON_SPACE)
    low = K.LOWER[b.data] if len(b.data) else np.zeros(1, np.uint8)
    last = low[t.end - 1].astype(np.int64)
    before = np.where(t.end - t.start > 1, low[np.maximum(t.end - 2, 0)], 0).astype(np.int64)
    suffix = (last * 31 + before * 7919) % SUFFIX
    ends = np.searchsorted(t.row, np.arange(b.rows), "right")
    return np.insert(t.hash, ends, END), np.insert(suffix, ends, 0), np.insert(t.row, ends, np.arange(b.rows))


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(values)).astype(np.int64), first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joined():
        key, n, first = _merge([x[0] for x in held], [x[1] for x in held])
        return key, n, np.concatenate([x[2] for x in held])[first]

    def out(key, n, suffix):
        return pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(n), pa.array(suffix)], names=["word", "n", "suffix"])

    size = 0
    for batch in batches:
        for b in K.blocks(batch.column(0)):
            h, suffix, _ = _text_tokens(b)
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((key, n, suffix[first]))
            size += len(key)
            if size > 1_000_000:
                held = [joined()]
                size = len(held[0][0])
                if size > 700_000:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*joined())


def _find(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash, -1 if not there."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


class Vocabulary:
    """The words with embeddings, and groups of the others: units 0 .. n-1 and n .. n+SUFFIX-1; START is one more, as context only."""

    def __init__(self, word: np.ndarray, n: np.ndarray, group_n: np.ndarray, group_v: np.ndarray):
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        self.size = len(word)
        self.units = self.size + SUFFIX
        #: Tokens of each unit, and of a group's unigram model with its unseen word.
        self.tokens = np.r_[self.n, group_n].astype(np.float64)
        self.log_group = np.log10(group_n + ALPHA * (group_v + 1))
        #: Where the words that begin with some HEAD bits stand, and the most that have the same ones.
        self.first = np.searchsorted(self.word >> np.uint64(64 - HEAD), np.arange((1 << HEAD) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    def units_of(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = self.size + suffix
        at, here = self.first[(h >> np.uint64(64 - HEAD)).astype(np.int64)], np.arange(len(h))
        for step in range(self.most):
            # Words are in order, so one that is passed is not there.
            there = np.minimum(at + step, self.size - 1)
            word = self.word[there]
            same = word == h[here]
            out[here[same]] = there[same]
            left = np.flatnonzero((word < h[here]) & (at + step < self.size))
            at, here = at[left], here[left]
        return out


def contexts(unit: np.ndarray, row: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each token; `start` before the first."""
    one, two = np.full(len(unit), start), np.full(len(unit), start)
    one[1:] = np.where(row[1:] == row[:-1], unit[:-1], start)
    two[2:] = np.where(row[2:] == row[:-2], unit[:-2], start)
    return one, two


class _Groups(NamedTuple):
    """Distinct indexes, how many of each, the order that puts equal ones together, where each begins in it, and where a new one does."""

    units: np.ndarray
    times: np.ndarray
    order: np.ndarray
    cuts: np.ndarray
    new: np.ndarray

    def inverse(self) -> np.ndarray:
        """The place of each index among the distinct ones."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out

    def sums(self, g: np.ndarray) -> np.ndarray:
        """The sums of the rows of g that belong to each distinct index. Most have one row, which needs no sum."""
        out = g.take(self.order[self.cuts], 0)
        several = self.times > 1
        n = self.times[several]
        if len(n):
            out[several] = np.add.reduceat(g.take(self.order[np.repeat(several, self.times)], 0), np.cumsum(n) - n, 0)
        return out


def _grouped(at: np.ndarray) -> _Groups:
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")
    ranked = at[order]
    new = np.ones(len(at), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    cuts = np.flatnonzero(new)
    times = np.empty(len(cuts), np.int64)
    np.subtract(cuts[1:], cuts[:-1], out=times[:-1])
    times[-1:] = len(at) - cuts[-1:]
    return _Groups(ranked[cuts], times, order, cuts, new)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    np.maximum(x, -30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(s: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the share of column `at` of the given rows of scores, which it may change."""
    # Scores of moderate size neither overflow nor vanish.
    if s.size and max(s.max(), -s.min()) > 40:
        s -= s.max(1, keepdims=True)
    own = s[row, at]
    return own - np.log(np.exp(s, out=s).sum(1))[row]


class LogBilinear:
    """Context embeddings r, matrices c of the two places, target vectors q and class vectors k; the last column of q and k is the bias."""

    def __init__(self, tokens: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.share = (tokens + ALPHA) / (tokens + ALPHA).sum()
        self.p = {"r": f(len(tokens) + 1, DIM), "c": np.concatenate([np.eye(DIM, dtype=np.float32)] * 2) + f(2 * DIM, DIM) / 10, "q": f(len(tokens), DIM + 1)}
        self.p["q"][:, -1] = np.log(self.share)
        #: Squared gradients so far, a row's mean; they set its step size.
        self.square: dict[str, np.ndarray] = {}
        #: Class of each unit, and its place among the members.
        self.class_of, self.place_of = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        self.members: list[np.ndarray] = []

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """All context embeddings through the matrix of either place, for use while they don't change."""
        return self.p["r"] @ self.p["c"][:DIM], self.p["r"] @ self.p["c"][DIM:]

    @staticmethod
    def predicted(first: np.ndarray, second: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The vector that each context predicts from turned embeddings, and 1 for the bias."""
        out = np.empty((len(one), DIM + 1), np.float32)
        np.add(first.take(one, 0), second.take(two, 0), out=out[:, :DIM])
        out[:, DIM] = 1
        return out

    def learn_classes(self, words: int) -> None:
        """Halves the words' target vectors along their main direction; each group of the other words is a class."""
        parts, self.members = [np.arange(words)] if words else [], []
        while parts:
            part = parts.pop()
            if len(part) <= MEMBERS:
                self.members.append(np.sort(part))
                continue
            x = self.p["q"][part, :DIM].astype(np.float64)
            x -= x.mean(0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            part = part[np.lexsort((part, along))]
            parts += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.members += [np.array([u]) for u in range(words, len(self.share))]
        for c, m in enumerate(self.members):
            self.class_of[m] = c
            self.place_of[m] = np.arange(len(m))
        self.class_share = np.bincount(self.class_of, self.share, len(self.members))
        k = np.stack([np.average(self.p["q"][m], axis=0, weights=self.share[m]) for m in self.members]).astype(np.float32)
        k[:, -1] = np.log(self.class_share)
        self.p["k"] = k

    def log10(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, turned: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 p(unit | the units one and two before), for each token."""
        # A context's classes are looked at once for all its tokens, and its words of a class once for all tokens of that class.
        context, place = np.unique(one.astype(np.int64) * (len(self.share) + 1) + two, return_inverse=True)
        h = self.predicted(*(turned or self.turned()), *np.divmod(context, len(self.share) + 1))
        cls = self.class_of[unit]
        out = np.empty(len(unit))
        k = np.ascontiguousarray(self.p["k"].T)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(0, len(context) + LOT, LOT))
        for at, i, j in zip(range(0, len(context), LOT), cuts, cuts[1:]):
            own = order[i:j]
            out[own] = _log_softmax(h[at : at + LOT] @ k, place[own] - at, cls[own])
        # Tokens of a class stand together, so that its words' products are one slice.
        order = order[np.argsort(cls[order].astype(np.uint16), kind="stable")]
        cls, place = cls[order], place[order]
        cuts = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else []
        for i, j in zip(cuts, [*cuts[1:], len(cls)]):
            m = self.members[cls[i]]
            if len(m) > 1:
                new = np.ones(j - i, bool)
                np.not_equal(place[i + 1 : j], place[i : j - 1], out=new[1:])
                q, row, column = self.p["q"][m].T, np.cumsum(new) - 1, self.place_of[unit[order[i:j]]]
                first = np.flatnonzero(new)
                for at in range(0, len(first), LOT):
                    to = np.searchsorted(row, at + LOT)
                    start = first[at]
                    out[order[i + start : i + to]] += _log_softmax(h[place[i + first[at : at + LOT]]] @ q, row[start:to] - at, column[start:to])
        return out / np.log(10)


class Trainer:
    """Noise-contrastive steps of one shard, on its own copy of the parameters."""

    def __init__(self, model: LogBilinear, classes: bool, shard: int):
        self.model, self.classes = model, classes
        self.names = ("k",) if classes else ("r", "c", "q")
        model.p = {name: x.copy() if name in self.names else x for name, x in model.p.items()}
        self.square = {name: model.square[name].copy() if name in model.square else np.full(len(model.p[name]), 1e-6, np.float32) for name in self.names}
        self.met = {name: np.zeros(len(model.p[name])) for name in self.names}
        share = model.class_share if classes else model.share
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.up_to = np.cumsum(share)
        self.turned = model.turned() if classes else None
        self.rng = np.random.default_rng((7, shard))

    def _move(self, name: str, at: np.ndarray, grad: np.ndarray, times: np.ndarray) -> None:
        """Adagrad with one step size a row."""
        square = self.square[name].take(at)
        square += np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        self.square[name][at] = square
        grad *= (np.float32(RATE) / np.sqrt(square))[:, None]
        grad += self.model.p[name].take(at, 0)
        self.model.p[name][at] = grad
        self.met[name][at] += times

    def step(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.model.p
        target = self.model.class_of[unit] if self.classes else unit
        q = p["k"] if self.classes else p["q"]
        noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE) * self.up_to[-1]), len(self.up_to) - 1)
        if self.classes:
            h = self.model.predicted(*self.turned, one, two)
        else:
            # Each distinct context unit is turned once.
            places = [(at, _grouped(at), p["c"][i : i + DIM]) for i, at in ((0, one), (DIM, two))]
            rows = [p["r"].take(g.units, 0) for _, g, _ in places]
            h = self.model.predicted(*(r @ c for r, (_, _, c) in zip(rows, places)), *(g.inverse() for _, g, _ in places))
        own, other = q.take(target, 0), q.take(noise, 0)
        real = 1 - _sigmoid(np.einsum("ij,ij->i", h, own) - self.log_noise[target])
        false = -_sigmoid(h @ other.T - self.log_noise[noise])
        if not self.classes:
            own *= real[:, None]
            dh = np.ascontiguousarray((own + false @ other)[:, :DIM])
        by = _grouped(np.concatenate([target, noise]))
        self._move("k" if self.classes else "q", by.units, by.sums(np.concatenate([real[:, None] * h, false.T @ h])), by.times)
        if not self.classes:
            sums = [g.sums(dh) for _, g, _ in places]
            grads = [(g.units, s @ c.T, g.times) for s, (_, g, c) in zip(sums, places)]
            turned = np.concatenate([r.T @ s for r, s in zip(rows, sums)])
            for g in grads:
                self._move("r", *g)
            self._move("c", np.arange(2 * DIM), turned, np.full(2 * DIM, len(unit)))


def _units(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id and the units of each text."""
    for batch in batches:
        for b in K.blocks(batch.column(1)):
            h, suffix, row = _text_tokens(b)
            offsets = np.r_[0, np.cumsum(K.per_row(row, b.rows))].astype(np.int32)
            units = pa.ListArray.from_arrays(pa.array(offsets), pa.array(held.value.units_of(h, suffix).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), units], names=["id", "units"])


def _train(held, classes: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard makes of the parameters: rows of each matrix and their squares, times how often they were met."""
    start, model = held.value
    trainer, at_shard = None, -1
    rest = [np.zeros(0, np.int64)] * 3

    def learned() -> Iterator[pa.RecordBatch]:
        if len(rest[0]):
            trainer.step(*rest)
        for name in trainer.names:
            x, met = np.c_[trainer.model.p[name], trainer.square[name]], trainer.met[name]
            for i in range(0, len(x), ROWS):
                w = met[i : i + ROWS].astype(np.float32)
                if w.any():
                    yield _packed([name], [i], [at_shard], [w], [x[i : i + ROWS] * w[:, None]])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        for i in np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else ():
            # Rows stand by shard: a new one begins with the parameters that were sent.
            k = int(np.searchsorted(shards[i:], shards[i], "right"))
            if shards[i] != at_shard:
                if trainer is not None:
                    yield from learned()
                # The broadcast object is the worker's own and of several shards: only a copy changes.
                own = LogBilinear.__new__(LogBilinear)
                own.__dict__ = dict(model.__dict__)
                at_shard = int(shards[i])
                trainer, rest = Trainer(own, classes, at_shard), [np.zeros(0, np.int64)] * 3
            unit, row = flat(batch.column(1).slice(i, k))
            rest = [np.concatenate(x) for x in zip(rest, (unit, *contexts(unit, row, start)))]
            at = 0
            while len(rest[0]) - at >= BATCH:
                trainer.step(*(x[at : at + BATCH] for x in rest))
                at += BATCH
            rest = [x[at:] for x in rest]
    if trainer is not None:
        yield from learned()


def _packed(names: list[str], starts: list[int], shards: list[int], weights: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    lists = lambda xs: pa.array([x.ravel() for x in xs], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(starts, pa.int64()), pa.array(shards, pa.int64()), lists(weights), lists(values)], names=["name", "start", "shard", "weight", "value"])


PARAMETERS = "name string, start long, shard long, weight array<float>, value array<float>"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows that stand together by name, start and group, as they stream by: one sum is held."""
    key, total, shard = None, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(c)[i].as_py() for c in (0, 1, 5))
            new = [batch.column(c)[i].values.to_numpy().astype(np.float64) for c in (3, 4)]
            if row == key:
                total = [a + b for a, b in zip(total, new)]
                continue
            if key is not None:
                yield _packed([key[0]], [key[1]], [shard], *[[x.astype(np.float32)] for x in total])
            key, total, shard = row, new, batch.column(2)[i].as_py()
    if key is not None:
        yield _packed([key[0]], [key[1]], [shard], *[[x.astype(np.float32)] for x in total])


def _sum_up(sent: DataFrame, groups: int) -> DataFrame:
    """One row of sums for each block of parameters and each of the groups of shards."""
    keyed = sent.withColumn("part", F.pmod("shard", F.lit(groups)))
    return keyed.repartition("name", "start", "part").sortWithinPartitions("name", "start", "part", "shard").mapInArrow(_added, PARAMETERS)


def train_round(texts: DataFrame, units: int, model: LogBilinear, classes: bool, shards: int) -> None:
    """One walk over texts (shard, place, units); the model takes the average of their shards, `shards` at most."""
    held = texts.sparkSession.sparkContext.broadcast((units, model))
    # Twice as many partitions, so that few of them get several shards.
    dealt = texts.repartition(2 * shards, "shard").sortWithinPartitions("shard", "place").select("shard", "units")
    sent = dealt.mapInArrow(lambda it: _train(held, classes, it), PARAMETERS)
    groups = math.isqrt(shards)
    # The sums of a group keep the number of one of its shards, which deals them no further.
    got = _sum_up(_sum_up(sent, groups) if groups > 1 else sent, 1).toArrow()
    for i in range(got.num_rows):
        name, start, _, w, value = (got.column(c)[i] for c in range(5))
        name, w = name.as_py(), w.values.to_numpy()
        at = np.flatnonzero(w)
        mean = value.values.to_numpy().reshape(len(w), -1)[at] / w[at, None]
        square = model.square.setdefault(name, np.full(len(model.p[name]), 1e-6, np.float32))
        model.p[name][start.as_py() + at], square[start.as_py() + at] = mean[:, :-1], mean[:, -1]
    held.destroy()


class Scorer:
    def __init__(self, vocabulary: Vocabulary, model: LogBilinear, word: np.ndarray, n: np.ndarray):
        order = np.argsort(word)
        self.vocabulary, self.model, self.word, self.n = vocabulary, model, word[order], n[order]


def _score(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; words that aren't common are listed, and counted as unseen."""
    scorer = held.value
    v, log_n, unseen = scorer.vocabulary, np.log10(scorer.n + ALPHA), np.log10(ALPHA)
    log_own = np.log10(v.n + ALPHA)
    serial, turned = TaskContext.get().partitionId() << 40, scorer.model.turned()
    for batch in batches:
        for b in K.blocks(batch.column(1), SCORED):
            h, suffix, row = _text_tokens(b)
            unit = v.units_of(h, suffix)
            model = scorer.model.log10(unit, *contexts(unit, row, v.units), turned)
            # Words with embeddings are common; only the others are looked for.
            grouped = np.flatnonzero(unit >= v.size)
            key, inverse = np.unique(h[grouped], return_inverse=True)
            at = _find(scorer.word, key)
            other = np.where(at >= 0, log_n[at] if len(log_n) else unseen, unseen)[inverse]
            part = np.empty(len(h))
            part[grouped] = other
            own = np.flatnonzero(unit < v.size)
            part[own] = log_own[unit[own]]
            # Of a group's word: its own count, less the group's total.
            inside = np.zeros(len(h))
            inside[grouped] = other - v.log_group[unit[grouped] - v.size]
            common = np.ones(len(h), bool)
            common[grouped] = (at >= 0)[inverse]
            rare, times = np.unique(row[~common] * len(key) + inverse[at[inverse] < 0], return_counts=True)
            r, w = rare // max(1, len(key)), key[rare % max(1, len(key))] if len(rare) else np.zeros(0, np.uint64)
            offsets = pa.array(np.r_[0, np.cumsum(K.per_row(r, b.rows))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(b.first, b.rows),
                    pa.array(serial + np.arange(b.rows)),
                    pa.array(K.per_row(row, b.rows)),
                    pa.array(K.per_row(row, b.rows, common.astype(float)).astype(np.int64)),
                    pa.array(K.per_row(row, b.rows, part)),
                    pa.array(K.per_row(row, b.rows, model + inside)),
                    pa.ListArray.from_arrays(offsets, pa.array(K.signed(w))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                names=["doc_id", "serial", "n_tokens", "n_common", "base", "model", "words", "times"],
            )
            serial += b.rows


def train(learn: DataFrame, vocab: DataFrame, *, size: int = VOCAB, rounds: int = ROUNDS, shard: int = SHARD) -> tuple[Vocabulary, LogBilinear]:
    """Vocabulary and model of all texts of `learn` (id, text), from the counts (word, n, suffix) of its words."""
    top = vocab.orderBy(F.desc("n"), "word").limit(size).select("word", "n", "suffix").toArrow()
    word, n, suffix = (c.to_numpy() for c in top.columns)
    # Groups hold the words that have no embedding of their own.
    group_n, group_v = -np.bincount(suffix, n, SUFFIX), -np.bincount(suffix, minlength=SUFFIX).astype(float)
    total = 0
    for r in vocab.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        group_n[r.suffix] += r.n
        group_v[r.suffix] += r.v
        total += r.n
    vocabulary = Vocabulary(word.view(np.uint64), n, group_n, group_v)
    model = LogBilinear(vocabulary.tokens)
    shards = min(max(1, -(-total // shard)), SHARDS)
    held = learn.sparkSession.sparkContext.broadcast(vocabulary)
    texts = learn.mapInArrow(lambda it: _units(held, it), f"id {learn.schema['id'].dataType.simpleString()}, units array<int>")
    place = F.xxhash64(F.col("id").cast("string"), "units")
    texts = settle(texts.select(F.pmod(place, F.lit(shards)).alias("shard"), place.alias("place"), "units"), "units")
    rounds = min(rounds, shards)
    for i in range(rounds if total else 0):
        low, high = shards * i // rounds, shards * (i + 1) // rounds
        train_round(texts.where((F.col("shard") >= low) & (F.col("shard") < high)), vocabulary.units, model, False, high - low)
    model.learn_classes(vocabulary.size)
    if total:
        train_round(texts, vocabulary.units, model, True, shards)
    drop_settled(texts)
    held.destroy()
    return vocabulary, model


def train_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, common: int = COMMON, size: int = VOCAB) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT if held_out is None else held_out
    learn = rows.where(~held).select(F.col("doc_id").alias("id"), "text")
    vocab = settle(learn.select("text").mapInArrow(_count_words, "word long, n long, suffix long").groupBy("word").agg(F.sum("n").alias("n"), F.first("suffix").alias("suffix")), "vocab")
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary, model = train(learn, vocab, size=size)
    # The lowest count whose words, with all above, are few enough; counts in steps of a tenth, and none if the first step has too many.
    steps = vocab.groupBy(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("low")).orderBy(F.desc("step")).collect()
    least, k = (1 << 62), 0
    for s in steps:
        if (k := k + s.k) > common:
            break
        least = s.low
    got = vocab.where(F.col("n") >= least).select("word", "n").toArrow()
    word, at = np.unique(np.concatenate([vocabulary.word, got.column("word").to_numpy().view(np.uint64)]), return_index=True)
    n = np.concatenate([vocabulary.n, got.column("n").to_numpy()])[at]
    del got, at

    shared = docs.sparkSession.sparkContext.broadcast(Scorer(vocabulary, model, word, n))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, serial long, n_tokens long, n_common long, base double, model double, words array<long>, times array<long>"
    scored = settle(rows.mapInArrow(lambda it: _score(shared, it), ddl), "scored")
    # Words that were counted as unseen and may not be.
    rare = scored.select("serial", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    count = scored.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    out = scored
    if count and total.n:
        seen = vocab.where(F.col("n") < least).select("word", F.col("n").alias("c"))
        asked = settle(rare.groupBy("word").agg(F.count("*").alias("n")).join(seen, "word", "left"), "asked")
        c = F.coalesce("c", F.lit(0))
        more = join_by_key(rare, asked, "word", count).groupBy("serial").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"), F.sum(F.col("times") * (F.log10(c + F.lit(ALPHA)) - F.lit(float(np.log10(ALPHA))))).alias("more"))
        out = scored.join(more, "serial", "left")
    else:
        out = scored.withColumn("more_known", F.lit(0)).withColumn("more", F.lit(0.0))
    zero = lambda name: F.coalesce(name, F.lit(0))
    norm = float(np.log10(total.n + ALPHA * (total.v + 1)))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_common") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + zero("more")).alias("score"),
    )


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
