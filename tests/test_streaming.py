"""Streams equal their batch twins, and survive a restart."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govlens.operators import conversations as C
from govlens.operators.policy import audit_rows, score
from govlens.plans import screening
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from govlens.streaming import jobs

T0 = datetime(2024, 1, 1)


def feed(spark, schema, batches):
    """A file stream that hands out one file per micro-batch."""
    path = scratch_dir(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


REQUEST = "request_id string, timestamp timestamp, agent_id string, prompt string, guardrails array<string>"


def test_screening_stream_equals_batch_and_restarts_once(spark):
    batches = [
        [(f"r{b}-{i}", T0 + timedelta(days=i), "a", f"mail u{i}@b.com you idiot", ["pii_detection", "toxicity"])
         for i in range(20)] + [(None, T0, "a", "x", None), (f"n{b}", T0, "a", None, None)]
        for b in range(3)
    ]
    root = scratch_dir(spark, "screened")
    arriving = feed(spark, REQUEST, batches)
    for _ in range(2):
        jobs.run_screening(arriving, root, f"{root}/checkpoint").awaitTermination()
    stored = tables.read_table(spark, root, "audit_logs")
    flat = [row for rows in batches for row in rows if row[0] and row[3]]
    batch = audit_rows(score(spark.createDataFrame(flat, REQUEST)))
    columns = ["request_id", "guardrail_type", "status", "has_pii", "redacted_prompt", "metadata"]
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    letters = spark.read.parquet(tables.dead_letter_path(root, "requests")).collect()
    assert sorted(r.violations for r in letters) == [["missing:prompt"]] * 3 + [["missing:request_id"]] * 3


def test_repeated_batch_replaces_its_rows(spark):
    """What a restart after a failed commit does: the same batch id is written again."""
    path = scratch_dir(spark, "repeat")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    for batch in ("4", "4", "5"):
        tables.write_batch(rows, path, batch)
    assert spark.read.parquet(path).count() == 4


AUDIT = (
    "request_id string, timestamp timestamp, user_id string, guardrail_type string, status string, has_pii boolean"
)


def audit_batches():
    return [
        [(f"r{b}-{i}", T0 + timedelta(hours=12 * b + i), f"u{i % 3}", "toxicity", "passed" if i % 2 else "blocked", i == 0)
         for i in range(12)]
        for b in range(8)
    ]


def test_daily_counts_close_days(spark):
    batches = audit_batches()
    root = scratch_dir(spark, "daily")
    counts = jobs.daily_counts(feed(spark, AUDIT, batches))
    jobs.run_append(counts, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = {r.date: r.total_requests for r in spark.read.parquet(f"{root}/out").collect()}
    everything = [row for rows in batches for row in rows]
    newest = max(row[1] for row in everything)
    expected = {}
    for row in everything:
        expected[row[1].date()] = expected.get(row[1].date(), 0) + 1
    closed = {
        d: n for d, n in expected.items()
        if datetime(d.year, d.month, d.day) + timedelta(days=1) <= newest - timedelta(days=1)
    }
    assert got == closed and closed


def test_dedup_drops_repeats_across_batches(spark):
    batches = audit_batches()
    doubled = [rows + previous[:6] for rows, previous in zip(batches, [[]] + batches[:-1], strict=True)]
    root = scratch_dir(spark, "dedup")
    rows = jobs.deduplicated(feed(spark, AUDIT, doubled), "3 days")
    jobs.run_append(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == sum(map(len, batches))


def test_session_counters_over_batches_equal_batch(spark, sf_dir):
    rows = X.turns(spark, sf_dir).select("session_id", "has_pii", "was_blocked")
    path = scratch_dir(spark, "turns")
    rows.repartition(5).write.parquet(path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = scratch_dir(spark, "counters")
    jobs.run_update(jobs.session_counters(arriving), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    values = ["message_count", "total_pii_incidents", "total_blocked"]
    changes = spark.read.parquet(f"{root}/out")
    assert changes.select("version").distinct().count() > 1
    got = jobs.current(changes, "session_id", values)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.session_counters(rows).collect()))


def test_current_values_after_a_new_checkpoint(spark):
    """Values written over a later checkpoint count, though its batch numbers begin anew."""
    schema = "session_id string, has_pii boolean, was_blocked boolean"
    root = scratch_dir(spark, "restarts")
    one, two = [("s", True, False)] * 10, [("s", True, True)] * 20
    counters = jobs.session_counters(feed(spark, schema, [one, two]))
    jobs.run_update(counters, f"{root}/out", f"{root}/checkpoint-1").awaitTermination()
    counters = jobs.session_counters(feed(spark, schema, [one + two + one]))
    jobs.run_update(counters, f"{root}/out", f"{root}/checkpoint-2").awaitTermination()
    values = ["message_count", "total_pii_incidents", "total_blocked"]
    assert jobs.current(spark.read.parquet(f"{root}/out"), "session_id", values).collect() == [("s", 40, 40, 20)]


def test_activity_sessions(spark):
    def event(user, minute):
        return (f"{user}{minute}", T0 + timedelta(minutes=minute), user, "toxicity", "passed", False)

    batches = [
        [event("u", 0), event("u", 29), event("v", 10)],
        [event("u", 58), event("u", 89), event("v", 20)],
        [event("w", 1_000)],
        [event("w", 1_001)],
    ]
    root = scratch_dir(spark, "sessions")
    jobs.run_append(
        jobs.activity_sessions(feed(spark, AUDIT, batches)), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    got = sorted((r.user_id, r.started_at, r.n_events) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [
        ("u", T0, 3),
        ("u", T0 + timedelta(minutes=89), 1),
        ("v", T0 + timedelta(minutes=10), 2),
    ]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_key_usage_over_batches(spark, sf_dir, threshold):
    access = X.access_log(spark, sf_dir)
    path = scratch_dir(spark, "access")
    access.repartition(4).write.parquet(path)
    arriving = spark.readStream.schema(access.schema).option("maxFilesPerTrigger", 2).parquet(path)
    root = scratch_dir(spark, "usage")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        usage = jobs.key_usage(arriving, X.api_keys(spark, sf_dir))
        jobs.run_update(usage, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = jobs.current(spark.read.parquet(f"{root}/out"), "key_id", ["last_used_at"])
    from govlens.operators.access import classify_access, latest_use

    expected = latest_use(classify_access(access, X.api_keys(spark, sf_dir)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_stream_source_equals_batch_source(spark, sf_dir):
    arriving = screening.ask_for(X.stream(spark, sf_dir, "documents", X.PROMPTS), ["pii_detection"])
    assert arriving.isStreaming and set(X.PROMPTS) < set(arriving.columns)


@pytest.mark.parametrize(
    "name", ["stream_conversation_stats", "stream_conversation_stats_expiring", "stream_abandoned_timers", "stream_abandoned"]
)
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    """A table of several files is a folder with the table's name."""
    rows = [(c, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], f"text {t}") for c in range(1, 6) for t in range(4)]
    rows += [(40_000 + 1_000 - 1, 1, "user", "late")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    import workload

    workload.load()
    got = workload.QUERIES[name](spark, str(tmp_path)).collect()
    turns = X.turns(spark, str(tmp_path))
    if name.startswith("stream_conversation_stats"):
        assert sorted(map(tuple, got)) == sorted(map(tuple, C.session_counters(turns).collect()))
    elif name == "stream_abandoned_timers":
        counts = {r.session_id: r.message_count for r in C.session_counters(turns).collect()}
        assert {r.session_id: r.n_messages for r in got} == counts
    else:
        assert {r.session_id for r in got} == {f"sess-{c}" for c in range(1, 6)}
