"""Conversation structure repair: Four-Russians block tables over edit costs.

Rows of a conversation become symbols (initial of the role, truncated or not; or
"must go"). The cheapest edits that turn the initials into `(s?(ua)+)?` follow
from a recurrence over four states: nothing yet, after s, after u, after a. Its
vectors of costs-to-go, with their least taken off, are few (some dozens), so a
table says for each of them and each block of `BLOCK` symbols which vector lies
before the block and what it adds. A conversation is a lookup per block from its
end to its start; its audit is then written forward, a block at a time, out of the
vectors inside the block, which are expanded backward from the vector behind it.
In each state every edit leads to one state only, so the first of D, I, K, R that
stays on a cheapest way gives the ASCII-least audit.

Rows are dealt by conversation, sorted, and streamed. A conversation of more than
`LONG_ROWS` rows or `LONG_BYTES` bytes never meets in one task: its rows are dealt
by ranges of the order, each chunk becomes the map that it is on the vectors, the
maps are folded backward, states forward, and only the digest of its repaired text,
which is sequential by definition, streams through one task, a batch at a time.

Defined results: damage and order are those of `damaged`; rows of one turn are
ordered by role and text; a null role or text is one space, in the key of the
damage a null conv_id or turn is one, too; null conv_ids form one conversation,
returned as null; an empty or foreign role has an initial that is never legal;
repeated rows are separate rows (the later ones duplicates); conversations that
damage leaves without rows have zeros, an empty audit and the hash of nothing;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, if_small, settle

#: A conversation beyond one of these is dealt to several tasks, in chunks of CHUNK rows.
LONG_ROWS, LONG_BYTES, CHUNK = 10_000, 32 << 20, 10_000
#: Symbols in a block.
BLOCK = 4
DELETE, RENAME, INSERT, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing yet, after s, after u, after a. Symbol 0 must go, 1 + 2 * c + t is class c of CLASSES, truncated (t = 1) or not.
CLASSES = "sua?"
SYMBOLS = 1 + 2 * len(CLASSES)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
#: What an inserted or renamed row becomes in each state, and the state then.
MADE = {q: next((role, NEXT[role[0]][q]) for role in ("user", "assistant") if q in NEXT[role[0]]) for q in range(4)}
ENDS = (0, FAR, FAR, 0)


def _inserting(g: tuple) -> tuple:
    """Costs where any number of insertions may come first; three lead round the states."""
    f = list(g)
    for _ in range(3):
        f = [min(f[q], INSERT + f[MADE[q][1]]) for q in range(4)]
    return tuple(min(x, FAR) for x in f)


def _edits(f: tuple, symbol: int, q: int) -> list[tuple[str, int, int]]:
    """(edit, cost to the end, next state) of what can be done to a row in state q, given the costs behind it."""
    found = [("D", DELETE + f[q], q)]
    if symbol:
        c, cut = CLASSES[(symbol - 1) >> 1], TRUNCATED * ((symbol - 1) & 1)
        if q in NEXT[c]:
            found.append(("K", cut + f[NEXT[c][q]], NEXT[c][q]))
        found.append(("R", RENAME + cut + f[MADE[q][1]], MADE[q][1]))
    return found


def _before(f: tuple, symbol: int) -> tuple:
    return _inserting(tuple(min(cost for _, cost, _ in _edits(f, symbol, q)) for q in range(4)))


class Tables:
    """Vectors, steps over one symbol and jumps over blocks of up to BLOCK symbols: arrays of (vector before, cost) by (vector behind, code)."""

    def __init__(self) -> None:
        self.vectors = [_inserting(ENDS)]
        number, steps = {self.vectors[0]: 0}, []
        for v in self.vectors:  # grows while it is read
            for s in range(SYMBOLS):
                w = _before(v, s)
                least = min(w)
                w = tuple(x - least for x in w)
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
                steps.append((number[w], least))
        one = np.array(steps, np.int64).reshape(-1, SYMBOLS, 2)
        self.jump = [None, one]
        for _ in range(BLOCK - 1):
            # The last symbol of a block is passed first.
            last = self.jump[1][:, None, :, :]
            rest = self.jump[-1][last[..., 0], np.arange(self.jump[-1].shape[1])[None, :, None]]
            self.jump.append(np.stack([rest[..., 0], rest[..., 1] + last[..., 1]], -1).reshape(len(one), -1, 2))
        self.lists = [t.tolist() if t is not None else None for t in self.jump]

    def blocks(self, symbols: list[int] | bytes) -> list[tuple[int, int]]:
        """(length, code) of the blocks of a chunk; the last one may be shorter."""
        found = []
        for at in range(0, len(symbols), BLOCK):
            code = 0
            part = symbols[at : at + BLOCK]
            for s in part:
                code = code * SYMBOLS + s
            found.append((len(part), code))
        return found

    def behind(self, blocks: list[tuple[int, int]], vector: int) -> tuple[list[int], int, int]:
        """The vector behind each block, that before the first one, and the cost of all."""
        found, cost = [0] * len(blocks), 0
        for i in range(len(blocks) - 1, -1, -1):
            n, code = blocks[i]
            found[i] = vector
            vector, more = self.lists[n][vector][code]
            cost += more
        return found, vector, cost

    def as_map(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """What a chunk makes of every vector behind it."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for n, code in reversed(self.blocks(symbols)):
            step = self.jump[n][at, code]
            at, cost = step[:, 0], cost + step[:, 1]
        return at, cost


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=1 << 16)
def _written(n: int, code: int, vector: int, q: int) -> tuple[str, int]:
    """The edits of a block entered in state q, and the state behind it: its inner vectors are expanded backward."""
    symbols = [code // SYMBOLS ** (n - 1 - i) % SYMBOLS for i in range(n)]
    inner = [tables().vectors[vector]]
    for s in reversed(symbols):
        inner.append(_before(inner[-1], s))
    inner.reverse()
    audit = ""
    for i, s in enumerate(symbols):
        while True:
            best = inner[i][q]
            at_row = {e: to for e, cost, to in _edits(inner[i + 1], s, q) if cost == best}
            ways = at_row | ({"I": MADE[q][1]} if INSERT + inner[i][MADE[q][1]] == best else {})
            edit = min(ways)
            audit, q = audit + edit, ways[edit]
            if edit != "I":
                break
    return audit, q


def _closing(q: int) -> str:
    """Insertions after the last row."""
    end, audit = tables().vectors[0], ""
    while end[q]:
        audit, q = audit + "I", MADE[q][1]
    return audit


def write_audit(symbols: bytes, vector: int, q: int) -> tuple[str, int]:
    """The edits of a chunk entered in state q before the vector behind it, and the state behind it."""
    blocks = tables().blocks(symbols)
    behind, _, _ = tables().behind(blocks, vector)
    parts = []
    for (n, code), v in zip(blocks, behind):
        audit, q = _written(n, code, v, q)
        parts.append(audit)
    return "".join(parts), q


def repair(symbols: bytes) -> tuple[str, int]:
    """Audit and cost of a whole conversation."""
    _, first, cost = tables().behind(tables().blocks(symbols), 0)
    audit, q = write_audit(symbols, 0, 0)
    return audit + _closing(q), cost + tables().vectors[first][0]


def replay(audit: Iterator[str], rows: Iterator[tuple[str, str]], q: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of what the edits make of rows."""
    for edit in audit:
        if edit == "I":
            role, q = MADE[q]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "K":
            q = NEXT[role[:1]][q]
            yield role, text
        elif edit == "R":
            role, q = MADE[q]
            yield role, text


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): crc32 of `conv:turn` mod 20 drops a row (no copies are left: it keeps its conversation only),
    empties its text, takes its `.!?`, repeats it or makes the role user."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    role, text = blank(F.col(role_col)), blank(F.col(text_col))
    return rows.select(
        conv.alias("conv"),
        F.when(fault != 0, turn.cast("long")).alias("turn"),
        F.when(fault == 4, "user").when(fault != 0, role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).when(fault != 0, text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def as_given(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns without damage."""
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _with_kind(rows: DataFrame) -> DataFrame:
    """kind: the symbol of a row that is no duplicate; null where damage dropped it."""
    rest = F.rtrim("text", F.lit(SPACE))
    cut = F.when(F.substring(rest, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    letter = F.position(F.substring("role", 1, 1), F.lit(CLASSES[:3]))
    initial = F.when((F.col("role") == "") | (letter == 0), len(CLASSES) - 1).otherwise(letter - 1)
    kind = F.when(F.col("copies") > 0, F.when(rest == "", 0).otherwise(1 + 2 * initial + cut))
    return rows.withColumn("initial", F.when(F.col("copies") > 0, initial)).withColumn("kind", kind)


ORDER = ("turn", "role", "text")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class Counted:
    """Counts over rows in order; as a chunk also what its neighbours must know."""

    def __init__(self) -> None:
        self.low = self.high = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.symbols = bytearray()

    def add(self, turn: int | None, initial: int, kind: int, copies: int, seen: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        for _ in range(copies):
            self.blank += not kind
            self.duplicate += bool(kind) and seen
            self.truncated += bool(kind) and not seen and not kind & 1
            self.illegal += self.tail is not None and (self.tail, initial) not in _LEGAL
            self.head = initial if self.head is None else self.head
            self.tail = initial
            self.symbols.append(0 if seen else kind)
            seen = True

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def _digest(parts: Iterator[tuple[str, str]]) -> str:
    sha, between = hashlib.sha256(), b""
    for role, text in parts:
        sha.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return sha.hexdigest()


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "position long, role string, text string"


def _streamed(turns: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations out of sorted rows: what is said of each, or its repaired turns."""
    none = object()
    conv, texts, seen, counted, out, kind_of = none, [], set(), Counted(), [], None

    def close() -> None:
        audit, cost = repair(bytes(counted.symbols))
        if turns:
            out.extend((conv, i, *turn) for i, turn in enumerate(replay(iter(audit), iter(texts))))
            return
        out.append((conv, counted.gaps(), counted.blank, counted.duplicate, counted.truncated, counted.illegal, cost, audit, _digest(replay(iter(audit), iter(texts)))))

    def send() -> pa.RecordBatch:
        types = [kind_of, pa.int64(), pa.string(), pa.string()] if turns else [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*out)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "position", "role", "text"] if turns else ["conv", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind_of = batch.schema.field(0).type
        for c, turn, role, text, copies, initial, kind in zip(*(x.to_pylist() for x in batch.columns)):
            if conv is none or c != conv:
                if conv is not none:
                    close()
                conv, texts, seen, counted = c, [], set(), Counted()
            if copies:
                key = (role, text)
                counted.add(turn, initial, kind, copies, key in seen)
                seen.add(key)
                texts += [key] * copies
        yield send()
        out.clear()
    if conv is not none:
        close()
        yield send()


def _long(rows: DataFrame, n_rows: int, conv_type: str, turns: bool) -> DataFrame:
    """The same for conversations that no task shall hold; conv is no null here."""
    n = max(1, -(-n_rows // CHUNK))
    keys = ["conv", *ORDER, "tie"]
    dealt = rows.where("copies > 0").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    r = settle(dealt.drop("tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "conv-long")
    same = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    first = r.groupBy("conv", same.alias("same")).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("seen"))
    marked = r.select("conv", "part", "at", "turn", "initial", "kind", "copies").join(first, "at", "left").withColumn("seen", F.coalesce("seen", F.lit(True)))

    def chunk(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        counted = Counted()
        for turn, initial, kind, copies, seen in zip(*(t.column(c).to_pylist() for c in ("turn", "initial", "kind", "copies", "seen"))):
            counted.add(turn, initial, kind, copies, seen)
        before, cost = tables().as_map(bytes(counted.symbols))
        head = t.slice(0, 1).select(["conv", "part"])
        for name, value, kind in [(c, getattr(counted, c), pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")] + [("symbols", bytes(counted.symbols), pa.binary()), ("before", before.tolist(), pa.list_(pa.int64())), ("adds", cost.tolist(), pa.list_(pa.int64()))]:
            head = head.append_column(name, pa.array([value], kind))
        return head

    chunk_ddl = f"conv {conv_type}, part int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head long, tail long, symbols binary, before array<long>, adds array<long>"
    chunks = settle(marked.groupBy("conv", "part").applyInArrow(chunk, chunk_ddl), "conv-chunks")

    def fold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vector behind each chunk, from the last to the first; the first one of a conversation also has its cost."""
        conv, vector, total = object(), 0, 0
        for b in batches:
            behind, cost = [], []
            for c, maps, adds in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if c != conv:
                    conv, vector, total = c, 0, 0
                behind.append(vector)
                total += adds[vector]
                vector = maps[vector]
                cost.append(total + tables().vectors[vector][0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(behind, pa.int64()), pa.array(cost, pa.int64())], names=["conv", "part", "vector", "cost"])

    folded = chunks.select("conv", "part", "before", "adds").repartition("conv").sortWithinPartitions("conv", F.desc("part")).mapInArrow(fold_back, f"conv {conv_type}, part int, vector long, cost long")

    def four(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk's edits are in each of the states that it may be entered in."""
        for b in batches:
            ways = [[write_audit(s, v, q) for q in range(4)] for s, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[a for a, _ in w] for w in ways], pa.list_(pa.string())), pa.array([[q for _, q in w] for w in ways], pa.list_(pa.int64()))], names=["conv", "part", "audits", "states"])

    ways = chunks.select("conv", "part", "symbols").join(folded, ["conv", "part"]).select("conv", "part", "symbols", "vector").mapInArrow(four, f"conv {conv_type}, part int, audits array<string>, states array<long>")
    facts = [c for c in chunks.columns if c not in ("symbols", "before", "adds")]
    all_chunks = settle(chunks.select(*facts).join(folded, ["conv", "part"]).join(ways, ["conv", "part"]), "conv-ways")

    def fold_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's own audit, and what a boundary adds to illegal pairs or takes from distinct turns."""
        conv, q, tail, high = object(), 0, None, None
        for b in batches:
            audits, ends, more, fewer = [], [], [], []
            for r in b.to_pylist():
                if r["conv"] != conv:
                    conv, q, tail, high = r["conv"], 0, None, None
                audits.append(r["audits"][q])
                q = r["states"][q]
                ends.append(_closing(q))
                more.append(int(tail is not None and (tail, r["head"]) not in _LEGAL))
                fewer.append(int(r["low"] is not None and r["low"] == high))
                tail, high = r["tail"], r["high"] if r["high"] is not None else high
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (audits, ends)), *(pa.array(x, pa.int64()) for x in (more, fewer))], names=["conv", "part", "audit", "closing", "more", "fewer"])

    own = all_chunks.select("conv", "part", "audits", "states", "head", "tail", "low", "high").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(fold_on, f"conv {conv_type}, part int, audit string, closing string, more long, fewer long")
    own = settle(own.join(all_chunks.drop("audits", "states"), ["conv", "part"]), "conv-own")
    last = own.groupBy("conv").agg(F.max("part").alias("part")).select("conv", "part", F.lit(True).alias("ends"))
    # One audit piece a chunk meets the rows of its conversation, which stream in order through the digest.
    pieces = own.join(last, ["conv", "part"], "left").withColumn("audit", F.concat("audit", F.when(F.col("ends"), F.col("closing")).otherwise("")))
    pieces = settle(pieces, "conv-pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, sha, n, q, audit, at, out = none, None, 0, 0, "", 0, []

        def put(role: str, text: str) -> None:
            nonlocal n
            if turns:
                out.append((conv, n, role, text))
            else:
                sha.update(b"\n" * (n > 0) + f"{role}:{text}".encode())
            n += 1

        def send() -> pa.RecordBatch:
            types = [kind_of, pa.int64(), pa.string(), pa.string()] if turns else [kind_of, pa.string()]
            columns = list(zip(*out)) or [()] * len(types)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "position", "role", "text"] if turns else ["conv", "sha"])
            out.clear()
            return made

        def insert() -> None:
            nonlocal q, at
            while at < len(audit) and audit[at] == "I":
                role, q = MADE[q]
                put(role, "")
                at += 1

        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            for c, role, text, copies, piece in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                if conv is none or c != conv:
                    if conv is not none and not turns:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, n, q = c, hashlib.sha256(), 0, 0
                if piece is not None:
                    audit, at = piece, 0
                for _ in range(copies or 0):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        q = NEXT[role[:1]][q]
                        put(role, text)
                    elif edit == "R":
                        new, q = MADE[q]
                        put(new, text)
                if copies is not None and at < len(audit) and not audit[at:].strip("I"):
                    insert()
            yield send()
        if conv is not none and not turns:
            out.append((conv, sha.hexdigest()))
            yield send()

    stream = r.select("conv", "part", "at", "role", "text", "copies", F.lit(None).cast("string").alias("audit")).unionByName(pieces.select("conv", "part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("copies"), "audit"))
    read = stream.repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(digest, f"conv {conv_type}, " + (_TURNS if turns else "sha string"))
    if turns:
        out = settle(read, "conv-repaired")
        drop_settled(r, chunks, all_chunks, own, pieces)
        return out
    shas = settle(read, "conv-sha")
    total = lambda c: F.sum(c).cast("long")
    facts = pieces.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - total("turns") + total("fewer"), F.lit(0)).cast("long").alias("gaps"),
        total("blank").alias("blank"),
        total("duplicate").alias("duplicate"),
        total("truncated").alias("truncated"),
        (total("illegal") + total("more")).alias("illegal"),
        F.max_by("cost", -F.col("part")).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    out = settle(facts.join(shas, "conv").select("conv", *COUNTS, "audit", F.col("sha").alias("repaired_sha256")), "conv-repaired")
    drop_settled(r, chunks, all_chunks, own, pieces, shas)
    return out


def _repaired(rows: DataFrame, turns: bool) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    rows = _with_kind(rows)
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) * F.col("copies")).alias("b"))
    long = settle(sizes.where((F.col("n") > LONG_ROWS) | (F.col("b") > LONG_BYTES)), "conv-sizes")
    n_long = long.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = []
    if n_long:
        ids = if_small(long.select(F.col("conv").alias("of")))
        is_long = F.col("conv").eqNullSafe(F.col("of"))
        here, rows = rows.join(ids, is_long, "left_semi"), rows.join(ids, is_long, "left_anti")
        # Keys of joins and groups inside are never null, so the conversation without an id takes part as one of its own.
        for some, none in ((here.where("conv is not null"), False), (here.where("conv is null").withColumn("conv", F.lit("")), True)):
            if some.head(1):
                got = _long(some, n_long, "string" if none else kind, turns)
                parts.append(got.withColumn("conv", F.lit(None).cast(kind)) if none else got)
    short = rows.select("conv", "turn", "role", "text", "copies", "initial", "kind").repartition("conv").sortWithinPartitions("conv", *ORDER)
    out = short.mapInArrow(lambda it: _streamed(turns, it), f"conv {kind}, {_TURNS if turns else _OUT}")
    for part in parts:
        out = out.unionByName(part)
    return out.withColumnRenamed("conv", "conv_id")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, turn, role, text, copies)."""
    return _repaired(rows, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves; one of which nothing is left has no row."""
    return _repaired(rows, True)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def conversation_sql() -> str:
    """The same by a recurrence over rows and states, without blocks."""
    return r"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), faulty as (
  select conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault from keyed, crc
), rows_ as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when fault = 3 then 2 else 1 end)) as copy
  from faulty where fault <> 0
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    count(*) over (partition by conv_id) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as rest, substr(role, 1, 1) as ini
  from rows_
), marked as (
  select *, rest = '' as is_blank, rest <> '' and nth > 1 as is_dup,
    rest <> '' and nth = 1 and not right(rest, 1) in ('.', '!', '?') as is_cut,
    lag(ini) over (partition by conv_id order by i) as prev
  from ordered
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (is_blank)::bigint as blank,
    count(*) filter (is_dup)::bigint as duplicate, count(*) filter (is_cut)::bigint as truncated,
    count(*) filter (i > 1 and not (prev || ini) in ('su', 'ua', 'au'))::bigint as illegal
  from marked group by conv_id
), back as (
  select distinct conv_id, (n + 1)::bigint as i, [0, 6, 3, 0]::bigint[] as f from marked
  union all
  select conv_id, i, [least(g[1], 3 + least(g[3], 3 + g[4])), least(g[2], 3 + least(g[3], 3 + g[4])), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])] as f
  from (
    select b.conv_id, m.i, list_transform([1, 2, 3, 4], lambda q: least(4 + b.f[q],
      case when m.is_blank or m.is_dup then 1000000 else (case when m.is_cut then 3 else 0 end) + least(3 + b.f[case when q = 3 then 4 else 3 end],
        case when m.ini = 's' and q = 1 then b.f[2] when m.ini = 'u' and q <> 3 then b.f[3] when m.ini = 'a' and q = 3 then b.f[4] else 1000000 end) end)) as g
    from back b join marked m on m.conv_id is not distinct from b.conv_id and m.i = b.i - 1
  )
), trace as (
  select conv_id, 1::bigint as i, 1 as q, '' as audit, []::varchar[] as made, false as over from facts
  union all
  select conv_id, case when e in ('D', 'K', 'R') then i + 1 else i end, case when e = 'K' then kept when e in ('I', 'R') then new_q else q end,
    audit || e, case when e = 'K' then made || [role || ':' || text] when e = 'R' then made || [new_role || ':' || text] when e = 'I' then made || [new_role || ':'] else made end, e = ''
  from (
    select *, case when not must_not and 4 + g[q] = f[q] then 'D' when 3 + f[new_q] = f[q] then 'I' when must_not then ''
      when not must_go and kept is not null and cut + g[kept] = f[q] then 'K' else 'R' end as e
    from (
      select t.conv_id, t.i, t.q, t.audit, t.made, b.f, c.f as g, m.role, m.text, m.i is null as must_not, m.is_blank or m.is_dup as must_go,
        case when m.is_cut then 3 else 0 end as cut, case when t.q = 3 then 4 else 3 end as new_q, case when t.q = 3 then 'assistant' else 'user' end as new_role,
        case when m.ini = 's' and t.q = 1 then 2 when m.ini = 'u' and t.q <> 3 then 3 when m.ini = 'a' and t.q = 3 then 4 end as kept
      from trace t join back b on b.conv_id is not distinct from t.conv_id and b.i = t.i
      left join back c on c.conv_id is not distinct from t.conv_id and c.i = t.i + 1
      left join marked m on m.conv_id is not distinct from t.conv_id and m.i = t.i
      where not t.over
    )
  )
), done as (
  select t.conv_id, b.f[1]::bigint as cost, t.audit, sha256(array_to_string(t.made, chr(10))) as repaired_sha256
  from trace t join back b on b.conv_id is not distinct from t.conv_id and b.i = 1 where t.over
), ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from ids left join facts f on f.conv_id is not distinct from ids.conv_id left join done d on d.conv_id is not distinct from ids.conv_id
"""
