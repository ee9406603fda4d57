"""API keys, also with one key holding a third of all accesses and a key table beyond the broadcast limit."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govlens.operators import access as A
from govlens.operators import access_history, common

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def keys(spark):
    created = spark.createDataFrame(
        [(f"k{i}", f"agent-{i % 3}", f"gov_{i}", T0, 10 if i % 5 else 1) for i in range(50)],
        "key_id string, agent_id string, plain_key string, created_at timestamp, expires_days int",
    )
    return A.hash_keys(created).withColumn("is_active", F.col("key_id") != "k7")


@pytest.fixture(scope="module")
def access(spark):
    rows = [(i, f"gov_{1 if i % 3 == 0 else i % 60}", T0 + timedelta(hours=i % 200)) for i in range(3_000)]
    return spark.createDataFrame(rows, "event_id long, presented_key string, ts timestamp").repartition(8)


def brute(keys, access):
    known = {r.key_hash: r for r in keys.collect()}
    import hashlib

    out = {}
    for r in access.collect():
        key = known.get(hashlib.sha256(r.presented_key.encode()).hexdigest())
        if key is None:
            out[r.event_id] = ("unknown", None)
        elif not key.is_active:
            out[r.event_id] = ("inactive", None)
        elif key.expires_at < r.ts:
            out[r.event_id] = ("expired", None)
        else:
            out[r.event_id] = ("valid", key.key_id)
    return out


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_classify_access(spark, keys, access, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        classified = A.classify_access(access, keys)
        got = {r.event_id: (r.status, r.key_id) for r in classified.collect()}
        salted = "_salt" in classified._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute(keys, access)
    assert {s for s, _ in got.values()} == {"unknown", "inactive", "expired", "valid"}
    if threshold == "-1":
        assert salted


def test_small_key_file_is_broadcast(spark, keys, access, tmp_path):
    keys.write.parquet(str(tmp_path / "keys"))
    classified = A.classify_access(access, spark.read.parquet(str(tmp_path / "keys")))
    assert "BroadcastHashJoin" in classified._jdf.queryExecution().executedPlan().toString()


def test_last_used(keys, access):
    newest = {}
    when = {r.event_id: r.ts for r in access.collect()}
    for event, (status, key) in brute(keys, access).items():
        if status == "valid":
            newest[key] = max(newest.get(key, T0), when[event])
    got = {r.key_id: r.last_used_at for r in A.last_used(keys, access).collect()}
    assert got == {f"k{i}": newest.get(f"k{i}") for i in range(50)}


def test_duplicate_hashes_match_one_key(spark, keys, access):
    twice = keys.unionByName(keys.withColumn("key_id", F.concat(F.lit("z"), "key_id")))
    assert A.classify_access(access, twice).count() == access.count()


def test_inventory_hides_hashes_and_revocation(spark, keys):
    listed = A.agent_keys(keys, "agent-1")
    assert "key_hash" not in listed.columns and listed.count() == 17
    assert listed.first().key_prefix.endswith("...")
    revoked = spark.createDataFrame([("k1",), ("k1",), ("zz",)], "key_id string")
    state = {r.key_id: r.is_active for r in A.revoke_keys(keys, revoked).collect()}
    assert not state["k1"] and not state["k7"] and state["k2"] and len(state) == 50


def test_presented_keys_do_not_leave_the_join(keys, access):
    assert "presented_key" not in A.attribute_access(access, keys).columns


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_large_dimensions_are_copied_for_hot_keys_only(spark, how):
    """Of 5,000 keys one has half of the facts: 31 copies of its row, and of what few share its range of hashes."""
    facts = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 101 = 0 THEN NULL ELSE concat('k', id) END AS k")
    dimension = spark.range(5_000).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE concat('k', id * 2) END AS k", "id AS v")
    dimension = dimension.unionByName(spark.range(1_000).selectExpr("concat('k', id * 2 + 1) AS k", "id AS v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = common.hot_ranges(facts, "k")
        assert 1 <= len(hot) <= 1 / common.HOT
        rows, copies = common._salted(facts, dimension, "k", ["id"], hot)
        assert dimension.count() + 31 <= copies.count() < dimension.count() * 2
        assert rows.filter("k = 'hot'").select("_salt").distinct().count() == common.SALTS
        out = common.join_dimension(facts, dimension, "k", ["id"], how, large=True)
        assert sorted(map(str, out.collect())) == sorted(map(str, facts.join(dimension, "k", how).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("history", [False, True])
def test_key_rows_are_not_copied_for_every_salt(spark, history):
    """Classification with as many keys as accesses makes about as many rows as it reads."""
    keys = spark.range(3_000).selectExpr(
        "concat('k', id) AS key_id", "'a' AS agent_id", "sha2(concat('p', id), 256) AS key_hash",
        "timestamp '2024-01-01' AS valid_from", "timestamp '2025-01-01' AS expires_at", "id % 3 <> 0 AS is_active",
    )
    access = spark.range(3_000).selectExpr("id AS event_id", "concat('p', id) AS presented_key", "timestamp '2024-02-01' AS ts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = access_history.access_as_of(access, keys) if history else A.classify_access(access, keys)
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "_salt" in plan and "sequence(0, 31" in plan and "CASE WHEN" in plan.split("sequence(0, 31")[0].rsplit("explode(", 1)[-1]
        assert sorted((r.event_id, r.status) for r in out.collect()) == [(i, "valid" if i % 3 else "inactive") for i in range(3_000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
