"""Sessions of any size: turn numbers, nested views and exports against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govlens.operators import conversations as C
from govlens.operators.common import running_total
from govlens.sources import fixtures as X

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """One session holds a third of all messages; positions have gaps."""
    draw = random.Random(7)
    rows, expected = [], {}
    for s in range(40):
        size = 3_000 if s == 0 else draw.randint(1, 300)
        position, turn = draw.randint(0, 5), 0
        for n in range(size):
            position += draw.choice([1, 1, 1, 2, 900])
            role = draw.choice(["user", "assistant"])
            turn += role == "user"
            at = DAY + timedelta(seconds=draw.randint(0, 40) + 30 * n)
            rows.append((f"m{s}-{n}", f"s{s}", position, role, f"c{n}", at, draw.random() < 0.1, draw.random() < 0.1))
            expected[f"m{s}-{n}"] = turn
    draw.shuffle(rows)
    df = spark.createDataFrame(
        rows,
        "message_id string, session_id string, seq long, role string, content string, timestamp timestamp, "
        "has_pii boolean, was_blocked boolean",
    ).repartition(8)
    return df.withColumns(
        {"agent_id": F.lit("a"), "feedback_rating": F.lit(None).cast("string"), "processing_time_ms": F.lit(1.0)}
    ), expected


def test_turn_numbers_equal_brute_force(history):
    df, expected = history
    got = {r.message_id: r.turn_number for r in C.turn_numbers(df).select("message_id", "turn_number").collect()}
    assert got == expected


def test_no_window_runs_over_a_whole_session(history):
    df, _ = history
    plan = C.turn_numbers(df)._jdf.queryExecution().executedPlan().toString()
    rows_window = [line for line in plan.splitlines() if "Window [" in line and "_amount" in line]
    assert rows_window and all("_range" in line for line in rows_window)


def test_running_total_treats_null_amounts_as_zero(spark):
    rows = spark.createDataFrame([("k", i, None if i % 2 else 1) for i in range(100)], "k string, i long, v long")
    out = running_total(rows, ["k"], {"_b": F.floor(F.col("i") / 7)}, ["i"], F.col("v"), "t").orderBy("i").collect()
    assert [r.t for r in out] == [i // 2 + 1 for i in range(100)]


def test_rows_without_session_or_position_are_kept(spark):
    rows = spark.createDataFrame(
        [(None, 1, "user"), (None, None, "user"), ("s", None, "user"), ("s", 5, "user"), ("s", 5_000, "user")],
        "session_id string, seq long, role string",
    )
    found = C.turn_numbers(rows).collect()
    assert len(found) == 5
    assert {r.seq: r.turn_number for r in found if r.session_id and r.seq} == {5: 2, 5_000: 3}


@pytest.fixture(scope="module")
def sessions(spark, history):
    df, _ = history
    starts = spark.createDataFrame(
        [(f"s{i}", "a", "u", "d", DAY + timedelta(hours=i)) for i in range(42)],
        "session_id string, agent_id string, user_id string, department string, started_at timestamp",
    ).withColumns(
        {
            "ended_at": F.lit(None).cast("timestamp"),
            "status": F.lit("completed"),
            "metadata": F.lit(None).cast("string"),
        }
    )
    return C.conversation_stats(starts, df)


def expected_messages(turns):
    by_session = {}
    for r in turns.collect():
        by_session.setdefault(r.session_id, []).append((r.turn_number, r.timestamp, r.message_id))
    return {s: [m for *_, m in sorted(rows)] for s, rows in by_session.items()}


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_long_sessions_come_in_parts(spark, history, sessions, threshold):
    """Parts concatenate to the whole session, with and without broadcast joins."""
    turns = C.turn_numbers(history[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = C.conversation_view(sessions, turns, part_size=250).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = expected_messages(turns)
    got, sizes = {}, {}
    for row in sorted(found, key=lambda r: (r.session_id, r.part)):
        got.setdefault(row.session_id, []).extend(m.message_id for m in row.messages)
        sizes.setdefault(row.session_id, []).append(len(row.messages))
    assert {s: m for s, m in got.items() if m} == expected
    assert max(max(x) for x in sizes.values()) <= 250
    assert sizes["s0"] == [250] * 12
    assert got["s40"] == [] and got["s41"] == [] and len(got) == 42


def test_short_sessions_need_one_row(history, sessions):
    found = C.session_transcript(sessions, C.turn_numbers(history[0]), part_size=5_000)
    assert found.count() == 42 and found.filter("part > 0").count() == 0


def test_counters(history, sessions):
    df, _ = history
    brute = {}
    for r in df.collect():
        n, p, b = brute.get(r.session_id, (0, 0, 0))
        brute[r.session_id] = (n + 1, p + r.has_pii, b + r.was_blocked)
    got = {r.session_id: (r.message_count, r.total_pii_incidents, r.total_blocked) for r in sessions.collect()}
    assert got == {f"s{i}": brute.get(f"s{i}", (0, 0, 0)) for i in range(42)}


def test_export_limit_comes_before_the_feedback_filter(spark):
    starts = spark.createDataFrame(
        [(f"s{i}", DAY + timedelta(hours=i), 2, 0, 0) for i in range(10)],
        "session_id string, started_at timestamp, message_count long, total_pii_incidents long, total_blocked long",
    ).withColumns({"agent_id": F.lit("a"), "department": F.lit("d"), "status": F.lit("completed")})
    messages = spark.createDataFrame(
        [(f"s{i}", f"m{i}-{j}", j, "user" if j == 0 else "assistant", "helpful" if i in (0, 1, 8) and j else "")
         for i in range(10) if i != 9 for j in range(2)],
        "session_id string, message_id string, turn_number long, role string, feedback_rating string",
    ).withColumns({"timestamp": F.lit(DAY), "content": F.lit("x")})
    latest = C.training_export(starts, messages, X.AS_OF, limit=3)
    assert {r.session_id for r in latest.collect()} == {"s9", "s8", "s7"}
    assert {r.session_id: len(r.messages) for r in latest.collect()} == {"s9": 0, "s8": 2, "s7": 2}
    rated = C.training_export(starts, messages, X.AS_OF, limit=3, only_with_feedback=True)
    assert [r.session_id for r in rated.collect()] == ["s8"]
    ratings = spark.createDataFrame([("s7", "helpful"), ("s1", "helpful"), ("s9", None)], "session_id string, rating string")
    linked = C.training_export(starts, messages, X.AS_OF, limit=3, only_with_feedback=True, session_ratings=ratings)
    assert {r.session_id for r in linked.collect()} == {"s8", "s7"}
    with pytest.raises(ValueError, match="min_messages"):
        C.training_export(starts, messages, X.AS_OF, min_messages=0)


def test_export_filters(spark):
    rows = [
        ("ok", DAY, "a", "completed", 2, 0),
        ("old", DAY - timedelta(days=60), "a", "completed", 2, 0),
        ("active", DAY, "a", "active", 2, 0),
        ("short", DAY, "a", "completed", 1, 0),
        ("pii", DAY, "a", "completed", 2, 1),
        ("other", DAY, "b", "completed", 2, 0),
    ]
    starts = spark.createDataFrame(
        rows,
        "session_id string, started_at timestamp, agent_id string, status string, message_count long, "
        "total_pii_incidents long",
    ).withColumns({"department": F.lit("d"), "total_blocked": F.lit(0).cast("long")})
    none = spark.createDataFrame(
        [],
        "session_id string, message_id string, turn_number long, timestamp timestamp, role string, content string, "
        "feedback_rating string",
    )
    ids = lambda **options: {r.session_id for r in C.training_export(starts, none, "2024-01-15", **options).collect()}
    assert ids() == {"ok", "other"}
    assert ids(agent_id="a") == {"ok"}
    assert ids(include_pii=True) == {"ok", "other", "pii"}
    assert ids(min_messages=1) == {"ok", "other", "short"}
    assert ids(days=90) == {"ok", "other", "old"}


def test_end_conversations(spark):
    sessions = spark.createDataFrame([("a", "active"), ("b", "active")], "session_id string, status string").withColumn(
        "ended_at", F.lit(None).cast("timestamp")
    )
    ends = spark.createDataFrame(
        [("a", "error", DAY), ("a", None, DAY + timedelta(hours=1))],
        "session_id string, status string, ended_at timestamp",
    )
    found = {r.session_id: (r.status, r.ended_at) for r in C.end_conversations(sessions, ends).collect()}
    assert found == {"a": ("completed", DAY + timedelta(hours=1)), "b": ("active", None)}


def test_ends_without_a_time_happen_now(spark):
    sessions = spark.createDataFrame(
        [("a", "active", None)], "session_id string, status string, ended_at timestamp"
    )
    ends = spark.createDataFrame([("a", "completed")], "session_id string, status string")
    assert C.end_conversations(sessions, ends, X.AS_OF).collect()[0].ended_at == datetime.fromisoformat(X.AS_OF)


def test_equal_starts_and_messages_keep_ids_of_their_own(spark, sf_dir):
    starts = spark.createDataFrame([("a", "u")] * 3 + [("a", None)], "agent_id string, user_id string")
    ids = [sorted(r.session_id for r in C.conversation_rows(starts, X.AS_OF).collect()) for _ in "ab"]
    assert ids[0] == ids[1] and len(set(ids[0])) == 4
    other = {r.session_id for r in C.conversation_rows(starts, X.AS_OF, "next").collect()}
    assert not other & set(ids[0])
    turns = X.messages(spark, sf_dir)
    assert len({r.message_id for r in C.message_rows(turns.unionByName(turns)).collect()}) == 2 * turns.count()


def test_row_builders_are_repeatable(spark, sf_dir):
    turns = X.messages(spark, sf_dir)
    once = {r.message_id for r in C.message_rows(turns, X.AS_OF).collect()}
    again = {r.message_id for r in C.message_rows(turns, X.AS_OF).collect()}
    assert once == again and len(once) == turns.count()
    start = spark.createDataFrame([("a", None, None)], "agent_id string, user_id string, metadata map<string,string>")
    row = C.conversation_rows(start, X.AS_OF).collect()[0]
    assert row.status == "active" and row.message_count == 0 and row.metadata is None and len(row.session_id) == 64
