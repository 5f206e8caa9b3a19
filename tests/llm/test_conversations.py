"""Repaired conversations against a forward search over all edits, damage against plain Python, long paths against short ones."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Audit, cost and repaired text of rows (role, text, must go, truncated), forward and without tables."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    made = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def with_inserts(best):
        for _ in range(4):
            for q, (cost, audit, out) in list(best.items()):
                way = (cost + 3, audit + "I", out + [made[q] + ":"])
                to = step[q][made[q][0]]
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    best = with_inserts({"": (0, "", [])})
    for role, text, must_go, cut in rows:
        after = {}

        def offer(to, way):
            if to not in after or way[:2] < after[to][:2]:
                after[to] = way

        for q, (cost, audit, out) in best.items():
            offer(q, (cost + 4, audit + "D", out))
            if not must_go:
                if role[:1] and role[:1] in step[q]:
                    offer(step[q][role[:1]], (cost + 3 * cut, audit + "K", out + [f"{role}:{text}"]))
                offer(step[q][made[q][0]], (cost + 3 + 3 * cut, audit + "R", out + [f"{made[q]}:{text}"]))
        best = with_inserts(after)
    return min(best[q] for q in ("", "a") if q in best)


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            rest = text.rstrip(SPACE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        legal = [a[1][:1] + b[1][:1] in ("su", "ua", "au") for a, b in zip(rows, rows[1:])]
        cost, audit, made = plain([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(rows, faults)])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), legal.count(False), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(C.damaged(df)).select("conv_id", *C.COUNTS, "audit", "repaired_sha256").collect()}


def table(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice((0, 1, 2, 5, 9, 30))):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "User"))
            text = rng.choice(("Yes.", "No", "", None, "  \t", "What is it? ", "Well...\n", f"text {rng.randrange(9)}!", "é?", "𝄞 sings."))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 3, None)), role, text))
    return rows + rows[:7]


def test_equals_forward_search(spark):
    rows = table()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_long_conversations_equal_forward_search(spark, monkeypatch):
    rows = table(12, 7) + [(None, i, "user", f"{i}.") for i in range(20)]
    monkeypatch.setattr(C, "LONG_ROWS", 4)
    monkeypatch.setattr(C, "CHUNK", 6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == expected(rows)
    long = C.repaired_turns(C.damaged(df)).collect()
    monkeypatch.setattr(C, "LONG_ROWS", 1000)
    short = C.repaired_turns(C.damaged(df)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, long)) == sorted(map(key, short)) and long


def test_repaired_turns_hash_to_the_digest(spark):
    df = spark.createDataFrame(table(20, 11), SCHEMA)
    made = {}
    for r in sorted(C.repaired_turns(C.damaged(df)).collect(), key=lambda r: r.position):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in got(df).items():
        assert hashlib.sha256("\n".join(made.get(conv, [])).encode()).hexdigest() == row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_forward_search(seed):
    rng = random.Random(seed)
    for n in [*range(14), 40, 133]:
        symbols = bytes(rng.randrange(C.SYMBOLS) for _ in range(n))
        rows = [(C.CLASSES[max(0, s - 1) >> 1], "", s == 0, bool(s) and not s & 1) for s in symbols]
        cost, audit, _ = plain(rows)
        assert C.repair(symbols) == (audit, cost)


def test_tables_are_bounded():
    t = C.Tables()
    assert len(t.vectors) < 100 and t.jump[C.BLOCK].shape == (len(t.vectors), C.SYMBOLS**C.BLOCK, 2)


def test_edges(spark):
    clash = "conv long, kind int, copies int, of string"
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 1, 2, 3, "x")], f"{SCHEMA}, {clash}")
    assert C.repair_conversations(C.as_given(df)).collect()[0].audit == "KI"
    assert C.repair_conversations(C.damaged(df.limit(0))).collect() == []
    # Conversation 0 has no row left: its only turn is one that damage drops.
    turn = next(t for t in range(999) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(0, turn, "user", "x")], SCHEMA)
    assert got(gone) == {0: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    wide = spark.createDataFrame([(5, 2, "assistant", "word " * 60_000 + ".")], SCHEMA)
    assert C.repair_conversations(C.as_given(wide)).select(F.sum("truncated")).first()[0] == 0
