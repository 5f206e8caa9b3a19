"""The stream of sessions against the batch over all events, with late, repeated and unordered events, a restart, time-outs and expiry."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import sessions
from maskwright.streaming import jobs, lifecycle

START = datetime(2024, 1, 1)


def write(path, rows):
    path.write_text("\n".join(json.dumps({"session_id": s, "status": st, "error_message": None, "at": (START + timedelta(seconds=t)).isoformat() + "Z"}) for s, st, t in rows))


def run(spark, folder, checkpoint, out, **how):
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))

    def keep(df, _):
        out.extend(tuple(r) for r in df.collect())

    q = lifecycle.session_lifecycle(stream, **how).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture
def few(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_equals_batch_after_restart(spark, tmp_path, few):
    rng = random.Random(2)
    folder = tmp_path / "in"
    folder.mkdir()
    events = [(f"s{rng.randrange(6)}", rng.choice(("uploaded", "processing", "processing", "completed")), t) for t in range(0, 3000, 30)]
    sent = [(*e, e[2] + rng.randrange(200)) for e in events]  # up to 200 s late
    sent += rng.sample(sent, 20)
    sent = [e[:3] for e in sorted(sent, key=lambda e: e[3])]
    half = len(sent) // 2
    out = []
    how = dict(limit_seconds=10**6, delay="400 seconds")
    for i, part in enumerate((sent[: half // 2], sent[half // 2 : half])):
        write(folder / f"{i}.json", part)
    run(spark, folder, tmp_path / "cp", out, **how)
    for i, part in enumerate((sent[half : half + 9], sent[half + 9 :])):
        write(folder / f"{2 + i}.json", part)
    run(spark, folder, tmp_path / "cp", out, **how)
    latest = {}
    for s, change, status, _, at in out:
        assert change == "state"
        latest[s] = (status, at)
    log = spark.createDataFrame([(s, st, None, START + timedelta(seconds=t)) for s, st, t in events], jobs.EVENTS.replace("at timestamp", "at timestamp_ntz"))
    want = {r.session_id: r.status for r in sessions.current_state(log).collect()}
    assert {s: x[0] for s, x in latest.items()} == want


def test_timeout_and_expiry(spark, tmp_path, few):
    folder = tmp_path / "in"
    folder.mkdir()
    out = []
    run_ = lambda: run(spark, folder, tmp_path / "cp", out, limit_seconds=60, expiry_hours=1, delay="1 second")
    write(folder / "0.json", [("a", "processing", 0), ("b", "processing", 0), ("b", "completed", 20), ("a", "processing", 30)])
    run_()
    write(folder / "1.json", [("c", "uploaded", 200)])
    run_()
    write(folder / "2.json", [("c", "completed", 4000)])
    run_()
    write(folder / "3.json", [("d", "uploaded", 9000)])
    run_()
    got = [(s, change, status, message) for s, change, status, message, _ in out]
    assert got.count(("a", "timeout", "error", "timed out")) == 1 and ("b", "timeout", "error", "timed out") not in got
    assert ("a", "expired", "error", "timed out") in got and ("b", "expired", "completed", None) in got
    assert ("c", "expired", "completed", None) in got and not any(s == "d" and c != "state" for s, c, *_ in got)


def test_fold():
    assert lifecycle.fold(None, []) is None
    p = lambda t: (t, "processing", None)
    assert lifecycle.fold(None, [p(1), p(5)]) == (5, "processing", None, 1)
    assert lifecycle.fold((5, "processing", None, 1), [(6, "uploaded", None), p(9), p(11)]) == (11, "processing", None, 9)
