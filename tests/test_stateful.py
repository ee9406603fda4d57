"""Streams with timers and state of their own end, keep order, and leave nothing behind."""

from __future__ import annotations

import hashlib
import os
import random
import subprocess
import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from govlens.operators import access_history as H
from govlens.session import scratch_dir
from govlens.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)


def hashed(key):
    return hashlib.sha256(key.encode()).hexdigest()


MESSAGE = "session_id string, timestamp timestamp, closes boolean"


def folder(spark):
    return scratch_dir(spark, "arriving")


def add(spark, path, rows, schema):
    """One more file for a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def wait(query, done, seconds=60):
    until = time.monotonic() + seconds
    while not done() and time.monotonic() < until:
        assert query.isActive, query.exception()
        time.sleep(0.1)
    assert done()


def test_silent_sessions_end_without_other_events_and_resumed_ones_go_on(spark):
    """Nothing arrives after the last message: each session still ends, once, and its state goes."""
    path, root = folder(spark), scratch_dir(spark, "silent")
    add(spark, path, [("a", T0, False), ("b", T0, False), ("c", T0, None), (None, T0, False)], MESSAGE)
    gap = timedelta(seconds=8)
    ended = stateful.silent_sessions(arriving(spark, path, MESSAGE), gap)
    writer = ended.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
    query = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        wait(query, lambda: (stateful.state_rows(query) or 0) > 0)
        add(spark, path, [("a", T0 + timedelta(minutes=9), False), ("c", T0 + timedelta(minutes=9), True)], MESSAGE)
        wait(query, lambda: query.lastProgress["numInputRows"] == 0 and stateful.state_rows(query) == 0)
    finally:
        query.stop()
    got = spark.read.parquet(f"{root}/out").collect()
    assert sorted((r.session_id, r.status, r.ended_at, r.n_messages) for r in got) == [
        ("a", "abandoned", T0 + timedelta(minutes=9) + gap, 2),
        ("b", "abandoned", T0 + gap, 1),
    ]


def test_timers_survive_a_restart(spark):
    """A session that was open when the job stopped is ended by the next run, which gets no event at all."""
    path, root = folder(spark), scratch_dir(spark, "restart")
    add(spark, path, [("a", T0, False)], MESSAGE)
    ended = stateful.silent_sessions(arriving(spark, path, MESSAGE), timedelta(seconds=6))
    writer = ended.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
    query = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="500 milliseconds").start()
    wait(query, lambda: (stateful.state_rows(query) or 0) > 0)
    query.stop()
    stateful.run_while_open(
        stateful.silent_sessions(arriving(spark, path, MESSAGE), timedelta(seconds=6)), f"{root}/out", f"{root}/checkpoint"
    )
    assert [r.session_id for r in spark.read.parquet(f"{root}/out").collect()] == ["a"]


def test_counters_expire(spark):
    schema = "session_id string, has_pii boolean, was_blocked boolean"
    path, root = folder(spark), scratch_dir(spark, "expiring")
    add(spark, path, [("a", True, False), ("a", None, True), ("b", False, False)], schema)
    counts = stateful.expiring_counters(arriving(spark, path, schema), timedelta(seconds=5))
    seen = []
    query = (
        counts.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
        .outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="500 milliseconds").start()
    )
    try:
        wait(query, lambda: len(seen) == 2)
        assert sorted(seen) == [("a", 2, 1, 1), ("b", 1, 0, 0)]
        time.sleep(5)
        add(spark, path, [("b", True, False)], schema)
        wait(query, lambda: len(seen) == 3)
        assert seen[-1] == ("b", 1, 1, 0)  # what it was has been forgotten
    finally:
        query.stop()


TURN = "session_id string, timestamp timestamp, message_id string, role string, seq int"


def conversation(session, n, start):
    roles = ["user", "assistant", "assistant", "user", "user", "tool"]
    return [
        (session, start + timedelta(minutes=i // 2), f"{session}-{i}", roles[(i * 7 + len(session)) % 6], i) for i in range(n)
    ]


def numbered(rows):
    out, turn = [], {}
    for session, _, message, role, seq in sorted(rows, key=lambda r: (r[0], r[4])):
        turn[session] = turn.get(session, 0) + (role == "user")
        out.append((session, message, role, seq, turn[session]))
    return sorted(out)


def test_turn_numbers_on_a_stream_equal_those_of_the_batch(spark):
    """Messages shuffled within the watermark, over two restarts; a last message closes what waits."""
    rows = [r for k in range(5) for r in conversation(f"s{k}" * (k + 1), 60, T0 + timedelta(minutes=3 * k))]
    random.Random(4).shuffle(rows)
    rows.sort(key=lambda r: int((r[1] - T0) / timedelta(minutes=20)))  # within 20 minutes any order
    path, root = folder(spark), scratch_dir(spark, "turns")
    files = [rows[a : a + 50] for a in range(0, len(rows), 50)]
    files.append([("end", T0 + timedelta(days=1), "end", "user", 0)])
    for part in (files[:2], files[2:4], files[4:]):
        for rows_of_file in part:
            add(spark, path, rows_of_file, TURN)
        turns = stateful.streamed_turn_numbers(arriving(spark, path, TURN), "1 hour", timedelta(hours=3))
        jobs.run_append(turns, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{root}/out").collect()
    assert sorted(map(tuple, got)) == numbered(rows)


def test_state_of_idle_sessions_goes(spark):
    path, root = folder(spark), scratch_dir(spark, "idle")
    add(spark, path, conversation("a", 4, T0), TURN)
    add(spark, path, [("b", T0 + timedelta(days=9), "b", "user", 0)], TURN)
    add(spark, path, [("c", T0 + timedelta(days=20), "c", "user", 0)], TURN)
    turns = stateful.streamed_turn_numbers(arriving(spark, path, TURN), "1 hour", timedelta(hours=3))
    query = jobs.run_append(turns, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    # What is left is the one message that waits, and its timer, which is kept by key and by time.
    assert sorted(r.message_id for r in spark.read.parquet(f"{root}/out").collect()) == ["a-0", "a-1", "a-2", "a-3", "b"]
    assert stateful.state_rows(query) <= 3


ACCESS = "event_id long, presented_key string, ts timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_keys_made_while_the_stream_runs_are_recognised(spark):
    """Changes between accesses count from their moment on, in whatever order the rows arrive, over a restart."""
    def change(key, minutes, active, expires=10**6):
        return (hashed(key), f"id-{key}", "agent", at(minutes), at(expires), active)

    accesses = [(1, "k", at(5)), (2, "k", at(20)), (3, "new", at(10)), (4, "new", at(40)), (5, "k", at(35)), (6, "old", at(30)), (7, None, at(31))]
    changes = [change("k", 0, True), change("k", 15, False), change("k", 30, True), change("old", 0, True, 25)]
    keys, events, root = folder(spark), folder(spark), scratch_dir(spark, "keys")
    add(spark, events, accesses, ACCESS)
    add(spark, keys, changes, H.CHANGE_SCHEMA)
    for more in ([change("new", 35, True)], None):
        stream = stateful.streamed_access(arriving(spark, events, ACCESS), arriving(spark, keys, H.CHANGE_SCHEMA), "2 hours")
        jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
        if more:
            add(spark, keys, more, H.CHANGE_SCHEMA)
            add(spark, events, [(99, "end", at(10_000))], ACCESS)
    got = {int(r.event_id): (r.status, r.key_id) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {
        1: ("valid", "id-k"), 2: ("inactive", None), 3: ("unknown", None), 4: ("valid", "id-new"), 5: ("valid", "id-k"),
        6: ("expired", None), 7: ("unknown", None),
    }


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_stream_equals_the_batch_join(spark, threshold):
    draw = random.Random(8)
    keys = [f"k{i}" for i in range(6)]
    changes = [(hashed(k), f"id-{k}", f"a{k}", at(draw.randint(0, 300)), at(draw.randint(100, 900)), draw.random() < 0.6) for k in keys for _ in range(5)]
    changes = list({(c[0], c[3]): c for c in changes}.values())
    accesses = [(i, draw.choice([*keys, "none"]), at(draw.randint(0, 400))) for i in range(500)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        batch = H.access_as_of(spark.createDataFrame(accesses, ACCESS), spark.createDataFrame(changes, H.CHANGE_SCHEMA), length=timedelta(hours=1))
        batch = {r.event_id: (r.status, r.key_id, r.agent_id) for r in batch.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = {}
    for event, key, when in accesses:
        before = [c for c in changes if c[0] == hashed(key) and c[3] <= when]
        state = max(before, key=lambda c: c[3], default=None)
        status = "unknown" if state is None else "inactive" if not state[5] else "expired" if state[4] < when else "valid"
        plain[event] = (status, *(state[1:3] if status == "valid" else (None, None)))
    assert batch == plain
    keys_path, events_path, root = folder(spark), folder(spark), scratch_dir(spark, "both")
    add(spark, keys_path, changes, H.CHANGE_SCHEMA)
    add(spark, events_path, [*accesses, (-1, "end", at(10_000))], ACCESS)
    stream = stateful.streamed_access(arriving(spark, events_path, ACCESS), arriving(spark, keys_path, H.CHANGE_SCHEMA))
    jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{root}/out").filter(F.col("event_id") != "-1").collect()
    assert {int(r.event_id): (r.status, r.key_id, r.agent_id) for r in got} == plain


@pytest.mark.parametrize("buckets", [1, 4])
def test_keys_share_the_state_of_their_bucket(spark, monkeypatch, buckets):
    """However many keys there are: a timer per bucket, pieces that are cut anew while rows wait, and a restart."""
    monkeypatch.setattr(stateful, "KEY_BUCKETS", buckets)
    monkeypatch.setattr(stateful, "ROWS_PER_PIECE", 70)
    draw, names = random.Random(5), [f"k{i}" for i in range(300)]
    change = lambda k, minutes, active: (hashed(k), f"id-{k}", "agent", at(minutes), at(10**6), active)
    changes = [change(k, i % 40, True) for i, k in enumerate(names)]
    # Of two changes at one moment the revocation counts, whichever comes first.
    changes += [change(k, 60, active) for i, k in enumerate(names) for active in ((True, False) if i % 2 else (False, True))]
    accesses = [(i * 3 + j, k, at(minutes)) for i, k in enumerate(names) for j, minutes in enumerate((20, 45, 70))]
    accesses.append((-1, "none", at(33)))
    draw.shuffle(accesses)
    keys, events, root = folder(spark), folder(spark), scratch_dir(spark, "buckets")
    add(spark, keys, changes, H.CHANGE_SCHEMA)
    for part in (accesses[:400], accesses[400:], [(-2, "end", at(30))], [(-3, "end", at(200))]):
        add(spark, events, part, ACCESS)
        stream = stateful.streamed_access(arriving(spark, events, ACCESS), arriving(spark, keys, H.CHANGE_SCHEMA), "100 minutes")
        query = jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        timers = [o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]]
        assert max(timers) <= buckets
    got = {int(r.event_id): r.status for r in spark.read.parquet(f"{root}/out").collect()}
    plain = {i * 3 + j: s for i in range(300) for j, s in enumerate(("valid" if i % 40 <= 20 else "unknown", "valid", "inactive"))}
    assert got == {**plain, -1: "unknown", -2: "unknown"}
    # A known key is one row among those of its bucket.
    assert stateful.state_rows(query) <= 6 * buckets


def test_idle_keys_leave_the_state(spark):
    change = lambda k, minutes: (hashed(k), f"id-{k}", "agent", at(minutes), at(10**6), True)
    keys, events, root = folder(spark), folder(spark), scratch_dir(spark, "idle-keys")
    add(spark, keys, [change("a", 0), change("b", 0)], H.CHANGE_SCHEMA)
    for part in ([(1, "a", at(10)), (2, "b", at(50)), (3, "a", at(70))], [(4, "end", at(130))], [(5, "a", at(135)), (6, "b", at(140)), (7, "end", at(400))]):
        add(spark, events, part, ACCESS)
        stream = stateful.streamed_access(
            arriving(spark, events, ACCESS), arriving(spark, keys, H.CHANGE_SCHEMA), "1 minute", timedelta(hours=1)
        )
        query = jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
    got = {int(r.event_id): r.status for r in spark.read.parquet(f"{root}/out").collect()}
    # Not idle for an hour before 129 minutes, where the watermark is then: a alone.
    assert got == {1: "valid", 2: "valid", 3: "valid", 4: "unknown", 5: "valid", 6: "unknown"}
    assert stateful.state_rows(query) <= 3  # the last access and its timer


def test_accesses_of_any_year(spark):
    """A key that is made after the times pandas can hold, and accesses before and after that."""
    years = lambda n: T0.replace(year=n)
    changes = [(hashed(k), f"id-{k}", "agent", years(made), years(9000), True) for k, made in (("a", 2024), ("b", 2639))]
    accesses = [(1, "a", years(2025)), (2, "b", years(2025)), (3, "b", years(2640)), (4, "a", years(2640))]
    keys, events, root = folder(spark), folder(spark), scratch_dir(spark, "years")
    add(spark, keys, changes, H.CHANGE_SCHEMA)
    add(spark, events, accesses, ACCESS)
    for end in (2700, None):
        stream = stateful.streamed_access(spark.readStream.schema(ACCESS).parquet(events), spark.readStream.schema(H.CHANGE_SCHEMA).parquet(keys))
        jobs.run_append(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
        if end:
            add(spark, events, [(5, "end", years(end))], ACCESS)
    got = {int(r.event_id): (r.status, r.ts) for r in spark.read.parquet(f"{root}/out").collect()}
    # Key a has been idle for long in 2640.
    plain = {1: "valid", 2: "unknown", 3: "valid", 4: "unknown"}
    assert got == {n: (status, accesses[n - 1][2]) for n, status in plain.items()}


def test_processors_load_where_the_package_is_missing(tmp_path):
    """As in a Python worker that does not find govlens."""
    made = [stateful.Silence(timedelta(seconds=2)), stateful.Counters(timedelta(days=2))]
    made.append(stateful.InOrder(stateful._next_turn, None, "turn long", [], timedelta(days=1)))
    (tmp_path / "made").write_bytes(cloudpickle.dumps(made))
    code = "import sys; from pyspark import cloudpickle; print(len(cloudpickle.load(open('made', 'rb'))), 'govlens' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert said.stdout.strip() == "3 False", said.stderr
