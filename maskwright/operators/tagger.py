"""Names, addresses and birth dates by context: a linear-chain tagger trained on given spans.

Words of a line get tags B-kind, I-kind or O. A tag's score is a sum of weights of
features of the word, its neighbours and the tag before; the best sequence is found
by Viterbi over all lines of an Arrow batch together. Features belong to distinct
words, so each distinct word of a batch is looked at once and its scores are
gathered for all its places.

Training is an averaged perceptron with iterative parameter mixing. Lines are cut to
pieces of at most PIECE words, and every distinct piece teaches. The weights to begin
with come from rounds over the `first` pieces of least hash: dealt to one shard for
each SHARE of them, SHARDS at most, each shard makes PASSES passes, or STEPS steps if
that is more, from the mixed weights on, and the driver averages as many arrays of a
fixed size as there are shards. Then all pieces teach, in shards of about WHOLE_SHARE
that each read their pieces as a stream, once, from these weights on: WHOLE_BATCH pieces
are tagged together, and those that come out wrong take steps; what a shard changes
is summed by row of the weights, in whole numbers. So the weights depend on the pieces
alone, whatever the cluster's number of tasks, and a task holds no more than one batch
of pieces. All lines are tagged.

Defined results: a null text has no spans; lines are split at line feeds and tagged
whole, of whatever length; spans that cut a word take all of it; spans of other
kinds, or outside the text, teach nothing; without any span nothing is found;
repeated rows are tagged separately; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import lots
from ..session import drop_settled, settled

#: Kinds of the built-in template that no pattern finds.
KINDS = ("Full Name", "Physical Address", "Date of Birth")
SHARE, SHARDS, ROUNDS, PASSES, STEPS, FIRST, BATCH, PIECE = 1000, 8, 4, 3, 400, 20_000, 4, 48
#: Pieces of a shard, and those tagged together, when all teach; what a shard changes counts in parts of 1 / UNIT.
WHOLE_SHARE, WHOLE_BATCH, UNIT = 20_000, 128, 1 << 16
#: Rows of hashed features.
ROWS = 1 << 16
#: Words that are tagged together.
TOGETHER = 200_000
FORBIDDEN = -1e9

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_")
#: Which neighbours are looked at, and how many of their features.
PLACES = {0: 8, -1: 5, 1: 5, -2: 3, 2: 3}
_EDGE = ("<line>",)


def tags(kinds: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def allowed(kinds: tuple[str, ...]) -> np.ndarray:
    """0 where a tag may follow another, FORBIDDEN where an I has no B or I of its kind before; the last row is the line's start."""
    n = 2 * len(kinds) + 1
    a = np.zeros((n + 1, n))
    for k in range(len(kinds)):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        a[:, inside] = FORBIDDEN
        a[[begin, inside], inside] = 0
    return a


class _Kinds(dict):
    """Kind of character by code point, looked up once each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else "w" if c.isalnum() else c
        return self[code]


_KIND, _RUN = _Kinds(), re.compile(r"(.)\1{2,}")


def shape(word: str) -> str:
    """Kinds of characters, runs cut to two: Xx, XX, dd/dd."""
    return _RUN.sub(r"\1\1", word[:24].translate(_KIND))


@lru_cache(maxsize=1 << 17)
def _features(word: str) -> tuple[int, ...]:
    """Hashes of what a word is, the most telling for its neighbours first."""
    low, form = word.lower(), shape(word)
    return tuple(zlib.crc32(f.encode()) for f in ("", f"w{low}", f"s{form}", f"e{low[-3:]}", f"b{low[:3]}", f"n{min(len(word), 9)}", f"z{low[-2:]}", f"d{form.count('d')}{len(word)}"))


def _rows(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Rows of weights, other ones for each salt."""
    return ((hashes + np.uint64(salt * 0x51ED27)) * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(16)).astype(np.int64) % ROWS


class Lines:
    """Lines of words as arrays: per word an index into the distinct words; features of each distinct word and place."""

    def __init__(self, lines: list[list[str]]):
        index: dict[str, int] = {_EDGE[0]: 0}
        self.sizes = np.array([len(x) for x in lines], np.int64)
        flat = np.array([index.setdefault(w, len(index)) for line in lines for w in line], np.int64)
        words = list(index)
        row = np.repeat(np.arange(len(lines)), self.sizes)
        at = np.arange(len(flat))
        self.around = {}
        for place in PLACES:
            there = at + place
            ok = (there >= 0) & (there < len(flat))
            there = np.where(ok, there, 0)
            ok &= row[there] == row if len(row) else ok
            self.around[place] = np.where(ok, flat[there] if len(flat) else 0, 0)
        hashes = np.array([_features(w) for w in words], np.uint64)
        self.by_word = {p: _rows(hashes[:, :n], p + 3) for p, n in PLACES.items()}
        # Shapes of a word and the one before, as numbers.
        _, form = np.unique(hashes[:, 2], return_inverse=True)
        pairs, first, self.pair_of = np.unique(form[self.around[-1]] * (form.max() + 1) + form[self.around[0]], return_index=True, return_inverse=True)
        before, own = (hashes[self.around[p][first], 2] for p in (-1, 0))
        self.pair = _rows(before * np.uint64(31) + own, 9)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each tag at each word, without transitions."""
        total = weights[self.pair][self.pair_of] if len(self.pair) else np.zeros((0, weights.shape[1]))
        for p in PLACES:
            total += weights[self.by_word[p]].sum(1)[self.around[p]]
        return total

    def rows_at(self, at: np.ndarray) -> np.ndarray:
        """Rows of weights that speak at some words, a column a word."""
        return np.concatenate([*(self.by_word[p][self.around[p][at]].T for p in PLACES), self.pair[self.pair_of[at]][None, :]])


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of all lines; of equal ways that with the lower tag, from the end on. moves: tag to tag, the last row from the start."""
    out = np.zeros(len(scores), np.int64)
    start = np.r_[0, np.cumsum(sizes)]
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        # Lines from the longest on that fill TOGETHER places when padded; one at least.
        own = order[at : at + max(1, TOGETHER // longest)]
        at += len(own)
        n = sizes[own]
        best = scores[start[own]] + moves[-1]
        back = np.zeros((longest, len(own), scores.shape[1]), np.int8)
        for i in range(1, longest):
            live = int(np.searchsorted(-n, -i, "left"))
            ways = best[:live, :, None] + moves[None, :-1, :]
            back[i, :live] = ways.argmax(1)
            best[:live] = ways.max(1) + scores[start[own[:live]] + i]
        tag = best.argmax(1)
        for i in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-n, -i, "left"))
            out[start[own[:live]] + i] = tag[:live]
            tag[:live] = back[i, np.arange(live), tag[:live]]
    return out


def words_of(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(line)]


def gold(places: list[tuple[int, int]], spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> list[int]:
    """Tags of words from spans (start, end, kind); of overlapping spans the first one speaks."""
    found = [0] * len(places)
    for start, end, kind in sorted(spans):
        hit = [i for i, (s, e) in enumerate(places) if s < end and e > start]
        if kind in kinds and hit and not any(found[i] for i in hit):
            for i in hit:
                found[i] = 2 + 2 * kinds.index(kind)
            found[hit[0]] -= 1
    return found


class Tagger:
    """Weights by hashed feature and tag, and moves from tag to tag."""

    def __init__(self, kinds: tuple[str, ...], weights: np.ndarray, moves: np.ndarray):
        self.kinds, self.weights, self.moves = tuple(kinds), weights, moves

    def tag(self, lines: list[list[str]]) -> np.ndarray:
        x = Lines(lines)
        return viterbi(x.scores(self.weights), x.sizes, self.moves + allowed(self.kinds))

    def spans(self, text: str) -> list[tuple[str, str, int, int]]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str | None]) -> list[list[tuple[str, str, int, int]]]:
        """(kind, text, start, length) of each text."""
        # Equal lines are tagged once; most have no span, so that their words' places aren't needed.
        index: dict[str, int] = {}
        owner = []
        for i, text in enumerate(texts):
            at = 0
            for line in (text or "").split("\n"):
                if line:
                    owner.append((i, at, index.setdefault(line, len(index))))
                at += len(line) + 1
        lines = list(index)
        words = [WORD.findall(line) for line in lines]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        tagged = self.tag(words)
        inside: dict[int, list[tuple[int, int, int]]] = {}
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(tagged), "right")).tolist():
            spans, here = words_of(lines[k]), inside.setdefault(k, [])
            begin = end = kind = None
            for (s, e), t in zip(spans + [(0, 0)], tagged[ends[k] - len(spans) : ends[k]].tolist() + [0]):
                if begin is not None and (t == 0 or t % 2 == 1):
                    here.append((kind, begin, end))
                    begin = None
                if t:
                    begin, kind, end = s if t % 2 == 1 else begin, (t - 1) // 2, e
        found: list[list] = [[] for _ in texts]
        for i, at, k in owner:
            found[i] += [(self.kinds[kind], lines[k][s:e], at + s, e - s) for kind, s, e in inside.get(k, ())]
        return found


class _Learner:
    """Weights that take steps, and their mean over all steps."""

    def __init__(self, kinds: tuple, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float64), moves.astype(np.float64)
        # What a step adds counts in the mean as often as steps follow it.
        self.late_w, self.late_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
        self.ok, self.step, self.lines = allowed(kinds), 0, 0

    def tag(self, x: Lines) -> np.ndarray:
        return viterbi(x.scores(self.weights), x.sizes, self.moves + self.ok)

    def learn(self, x: Lines, want: np.ndarray) -> None:
        got = self.tag(x)
        wrong = np.flatnonzero(want != got)
        if len(wrong):
            rows, start = x.rows_at(wrong), len(self.moves) - 1
            first = (np.cumsum(x.sizes) - x.sizes)[x.sizes > 0]
            for path, sign in ((want, 1.0), (got, -1.0)):
                np.add.at(self.weights, (rows, path[wrong]), sign)
                np.add.at(self.late_w, (rows, path[wrong]), sign * self.step)
                before = np.r_[start, path[:-1]]
                before[first] = start
                np.add.at(self.moves, (before, path), sign)
                np.add.at(self.late_m, (before, path), sign * self.step)
        self.step += 1

    def learn_wrong(self, lines: list[str], labels: list[list[int]]) -> None:
        """Steps of the pieces that these weights tag wrong; the others have nothing to teach, but count in the mean."""
        x, want = _batch(lines, labels)
        wrong = np.unique(np.searchsorted(np.cumsum(x.sizes), np.flatnonzero(self.tag(x) != want), "right")).tolist()
        behind = self.step + -(-len(lines) // BATCH)
        for at in range(0, len(wrong), BATCH):
            self.learn(*_batch([lines[i] for i in wrong[at : at + BATCH]], [labels[i] for i in wrong[at : at + BATCH]]))
        self.step = behind
        self.lines += len(lines)

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        steps = max(self.step, 1)
        return self.weights - self.late_w / steps, self.moves - self.late_m / steps


def _batch(lines: list[str], labels: list[list[int]]) -> tuple[Lines, np.ndarray]:
    return Lines([t.split("\x00") for t in lines]), np.array([t for x in labels for t in x], np.int64)


def _learnt(kinds: tuple, weights: np.ndarray, moves: np.ndarray, table: pa.Table) -> pa.Table:
    """Passes of a shard over its pieces: the weights behind the last step, and the mean over all steps."""
    _, lines, labels = zip(*sorted(zip(*(table.column(c).to_pylist() for c in ("place", "line", "tags")))))
    batches = [_batch(lines[at : at + BATCH], labels[at : at + BATCH]) for at in range(0, len(labels), BATCH)]
    own = _Learner(kinds, weights, moves)
    for _ in range(max(PASSES, -(-STEPS // max(len(batches), 1)))):
        for x, want in batches:
            own.learn(x, want)
    pack = lambda *x: pa.array([b"".join(a.astype(np.float32).tobytes() for a in x)], pa.binary())
    return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int32()), "mean": pack(*own.mean()), "last": pack(own.weights, own.moves), "lines": pa.array([len(labels)], pa.int64())})


CHANGE = "row int, tag int, change long"


def _changes(kinds: tuple, held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard's pieces (line, tags, shard), which follow each other, change in the mean over their steps, times their number and UNIT: the moves stand behind the weights."""
    weights, moves = held.value
    begin = np.concatenate([weights, moves]).astype(np.float64)
    own, shard, lines, labels = None, None, [], []

    def step():
        own.learn_wrong(lines, labels)
        lines.clear()
        labels.clear()

    def done():
        if lines:
            step()
        change = np.rint((np.concatenate(own.mean()) - begin) * (own.lines * UNIT)).astype(np.int64)
        row, tag = np.nonzero(change)
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(tag.astype(np.int32)), pa.array(change[row, tag])], names=["row", "tag", "change"])

    for b in batches:
        for line, tagged, of in zip(*(c.to_pylist() for c in b.columns)):
            if of != shard:
                if own:
                    yield done()
                own, shard = _Learner(kinds, weights, moves), of
            lines.append(line)
            labels.append(tagged)
            if len(lines) == WHOLE_BATCH:
                step()
    if own:
        yield done()


def _pieces(kinds: tuple, text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, str, tuple[int, ...]]]:
    """Pieces of a text's lines (place, words, tags), from its spans (start, end, kind)."""
    at = 0
    for line in text.split("\n"):
        here = [(s - at, e - at, k) for s, e, k in spans if s < at + len(line) and e > at]
        at += len(line) + 1
        words, cut = WORD.findall(line), 0
        tagged = gold(words_of(line), here, kinds) if here else [0] * len(words)
        while cut < len(words):
            to = min(cut + PIECE, len(words))
            while to < len(words) and tagged[to] and tagged[to] % 2 == 0:  # no piece begins inside a span
                to += 1
            piece = "\x00".join(words[cut:to])
            yield zlib.crc32(piece.encode()), piece, tuple(tagged[cut:to])
            cut = to


def _least(kinds: tuple, few: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pieces, repeated ones once as far as it has met them lately; with `few`, of the distinct ones with a span, and of those without, so many of least place and line: what is among the least of all is among them."""
    held: tuple[set, set] = (set(), set())
    last = [1 << 32, 1 << 32]

    def rows(of: list) -> pa.RecordBatch:
        columns = list(zip(*of)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int32())), pa.array(columns[0], pa.int64())], names=["line", "tags", "place"])

    for b in lots(batches, 0):
        for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            spans = [(s["start"], s["start"] + s["length"], s["entity_type"]) for s in spans or () if None not in s.values()]
            for p in _pieces(kinds, text or "", spans):
                some = any(p[2])
                if p[0] <= last[some]:
                    held[some].add(p)
        for i, x in enumerate(held):
            if few is None:
                if len(x) > 10_000:
                    yield rows(list(x))
                    x.clear()
            elif len(x) > few + 10_000:
                kept = sorted(x)[:few]
                x.clear()
                x.update(kept)
                last[i] = kept[-1][0] if kept else -1
    yield rows([p for x in held for p in sorted(x)[:few]])


def train(texts: DataFrame, spans: DataFrame | str, *, keys=("doc_id",), text_col: str = "text", kinds: tuple[str, ...] = KINDS, first: int = FIRST, rounds: int = ROUNDS) -> Tagger:
    """A tagger of `kinds` from all texts and their spans (keys, entity_type, start, length); texts without spans teach what is none.

    Spans may be the name of a column of texts that holds them as an array; then no text moves but in pieces.
    """
    if isinstance(spans, str):
        joined = texts.select(F.col(text_col).alias("text"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["entity_type"].alias("entity_type"))).alias("_spans"))
    else:
        by = spans.where(F.col("entity_type").isin(*kinds)).groupBy(*keys).agg(F.collect_list(F.struct("start", "length", "entity_type")).alias("_spans"))
        joined = texts.join(by, list(keys), "left").select(F.col(text_col).alias("text"), "_spans")
    pieces = settled(joined.mapInArrow(lambda it: _least(kinds, None, it), "line string, tags array<int>, place long").distinct(), "pieces")
    try:
        count = pieces.count()
        weights, moves = _begun(pieces, kinds, first, rounds)
        if not count:
            return Tagger(kinds, weights, moves)
        held = texts.sparkSession.sparkContext.broadcast((weights, moves))
        # By ranges of the shard: those of a partition follow each other, and a piece of a shard is in no other partition.
        shards = max(1, count // WHOLE_SHARE)
        dealt = pieces.withColumn("shard", (F.col("place") % shards).cast("int")).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "place", "line", "tags")
        changes = dealt.select("line", "tags", "shard").mapInArrow(lambda it: _changes(kinds, held, it), CHANGE)
        got = changes.groupBy("row", "tag").agg(F.sum("change").alias("change")).toArrow()
        mean = np.concatenate([weights, moves]).astype(np.float64)
        mean[got.column("row").to_numpy(), got.column("tag").to_numpy()] += got.column("change").to_numpy() / (count * UNIT)
        held.unpersist()
        return Tagger(kinds, *np.split(mean.astype(np.float32), [len(weights)]))
    finally:
        drop_settled(pieces)


def _begun(pieces: DataFrame, kinds: tuple[str, ...], first: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and moves that all pieces (line, tags, place) begin with: of rounds over the `first` ones."""
    few = first - first // 2
    # Pieces with a span are rare in prose: half of the first ones are theirs, as far as they go.
    some = F.exists("tags", lambda t: t > 0)
    dealt = pieces.where(some).orderBy("place", "line", "tags").limit(first // 2).unionByName(pieces.where(~some).orderBy("place", "line").limit(few))
    piece = settled(dealt, "taught")
    shards = max(1, min(SHARDS, piece.count() // SHARE))
    # By ranges, a shard is a partition of its own; small partitions of a hash exchange would be put together again.
    dealt = piece.withColumn("shard", (F.col("place") % shards).cast("int")).repartitionByRange(shards, "shard")
    n = 2 * len(kinds) + 1
    weights, moves = np.zeros((ROWS, n), np.float32), np.zeros((n + 1, n), np.float32)
    sums, total = [np.zeros(weights.shape), np.zeros(moves.shape)], 0
    try:
        for turn in range(rounds):
            held = pieces.sparkSession.sparkContext.broadcast((weights, moves))

            def learn(t: pa.Table) -> pa.Table:
                return _learnt(kinds, *held.value, t)  # noqa: B023

            got = dealt.groupBy("shard").applyInArrow(learn, "shard int, mean binary, last binary, lines long").collect()
            if not got:
                break
            got.sort(key=lambda r: r.shard)
            share = [r.lines / sum(r.lines for r in got) for r in got]
            mixed = [sum(f * np.frombuffer(r[c], np.float32) for f, r in zip(share, got)) for c in ("last", "mean")]
            weights, moves = (x.astype(np.float32).reshape(y.shape) for x, y in zip(np.split(mixed[0], [weights.size]), (weights, moves)))
            if 2 * turn >= rounds - 1:  # early rounds know little
                sums = [a + b.reshape(a.shape) for a, b in zip(sums, np.split(mixed[1], [weights.size]))]
                total += 1
            held.unpersist()
    finally:
        drop_settled(piece)
    return tuple((x / max(total, 1)).astype(np.float32) for x in sums)


def tag_documents(texts: DataFrame, model: Tagger, *, keys=("doc_id",), text_col: str = "text") -> DataFrame:
    """A row for each span found: keys, entity_type, original_text, start, length (in characters, from 0)."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, len(keys)):
            found = held.value.spans_of(b.column(len(keys)).to_pylist())
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = list(zip(*(x for f in found for x in f))) or [()] * 4
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(len(keys))), *made], names=[*keys, "entity_type", "original_text", "start", "length"])

    rows = texts.select(*keys, text_col)
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{ddl}, entity_type string, original_text string, start int, length int")
