"""Accesses are judged by what their key was when they happened."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest

from govlens.operators import access_history as H

T0 = datetime(2024, 1, 1)
KEY = "key_id string, agent_id string, key_hash string, created_at timestamp, expires_at timestamp, last_used_at timestamp, is_active boolean"
SWITCH = "key_id string, at timestamp, is_active boolean"
ACCESS = "event_id long, presented_key string, ts timestamp, key_id string, status string, _range long"


def hashed(key):
    return hashlib.sha256(key.encode()).hexdigest()


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def keys(spark):
    rows = [
        ("k1", "a1", hashed("one"), at(0), at(1_000), None, False),  # revoked, restored and revoked: see the switches
        ("k2", "a2", hashed("two"), at(0), at(50), None, True),
        ("k3", "a3", hashed("three"), at(0), at(1_000), None, False),  # inactive, nobody knows since when
        ("k4", "a4", None, at(0), at(1_000), None, True),
    ]
    return spark.createDataFrame(rows, KEY)


@pytest.fixture
def changes(spark, keys):
    switches = [
        ("k1", at(10), False), ("k1", at(40), True), ("k1", at(60), False), ("k1", at(60), True), ("k1", None, True),
        ("k1", at(-5), False), ("nobody", at(1), False),
    ]
    return H.key_changes(keys, spark.createDataFrame(switches, SWITCH))


def statuses(spark, changes, events, **options):
    rows = [(i, key, when, "own", "own", 1) for i, (key, when) in enumerate(events)]
    df = spark.createDataFrame(rows, ACCESS).drop("key_id", "status", "_range")
    out = H.access_as_of(df, changes, **options).collect()
    return {r.event_id: (r.status, r.key_id) for r in out}


def test_history(changes):
    rows = changes.filter("key_id = 'k1'").orderBy("valid_from").collect()
    assert [(r.valid_from, r.is_active) for r in rows] == [(at(0), True), (at(10), False), (at(40), True), (at(60), False)]
    assert changes.count() == 7


@pytest.mark.parametrize("length", [timedelta(minutes=7), timedelta(days=1), timedelta(days=400)])
@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_status_at_the_time(spark, changes, length, threshold):
    events = [
        ("one", at(-1)), ("one", at(0)), ("one", at(9.9)), ("one", at(10)), ("one", at(39)), ("one", at(40)),
        ("one", at(59)), ("one", at(60)), ("one", at(900)), ("two", at(50)), ("two", at(50.5)), ("three", at(5)),
        ("none", at(5)), (None, at(5)), ("one", None),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = statuses(spark, changes, events, length=length)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = [
        "unknown", "valid", "valid", "inactive", "inactive", "valid", "valid", "inactive", "inactive", "valid", "expired",
        "inactive", "unknown", "unknown", "unknown",
    ]
    assert [got[i][0] for i in range(len(events))] == expected
    assert got[1] == ("valid", "k1") and got[3] == ("inactive", None)


def test_uses_before_a_revocation_count(spark, keys, changes):
    events = [("one", at(50)), ("one", at(70)), ("two", at(60)), ("two", at(3)), ("three", at(3))]
    access = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(events)], "event_id long, presented_key string, ts timestamp")
    used = {r.key_id: r.last_used_at for r in H.last_used_as_of(keys, access, changes).collect()}
    assert used == {"k1": at(50), "k2": at(3), "k3": None, "k4": None}


def test_empty(spark, changes):
    assert statuses(spark, changes, [("one", at(1))][:0]) == {}
    assert statuses(spark, changes.limit(0), [("one", at(1))]) == {0: ("unknown", None)}


def test_hot_key_is_not_one_task(spark, changes):
    """Accesses of one key meet its states by range, or in salted pieces."""
    access = spark.range(10_000).selectExpr("id AS event_id", "'one' AS presented_key", "timestamp '2024-01-01' + make_dt_interval(0, id % 700) AS ts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = H.access_as_of(access, changes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and out.count() == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
