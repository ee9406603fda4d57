"""Stored parts answer any period, follow the batches of their table, and read only the days that changed."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from govlens.operators import feedback as FB
from govlens.operators import rollups as P
from govlens.operators import usage as U
from govlens.plans import replay, rollup
from govlens.session import scratch_dir
from govlens.sources import batches, tables
from govlens.sources import fixtures as X

T0 = datetime(2024, 1, 1)


@pytest.fixture
def audit(spark, sf_dir):
    return X.audit_logs(spark, sf_dir)


def days_of(found):
    return {str(r[0]) for r in found}


def parts_without_sketches(df):
    rows = df.drop("users", "latency").select(*[F.round(c, 6).alias(c) if c == "ms_sum" else c for c in df.columns if c not in ("users", "latency")])
    return sorted(map(str, rows.select(*sorted(rows.columns)).collect()))


def files(spark, root):
    """The files of every day's parts."""
    path = rollup.parts_path(root, "usage_daily")
    return {day: batches.names(spark, f"{path}/{day}") for day in batches.names(spark, path) if day.startswith("event_date=")}


def test_refresh_follows_batches(spark, audit):
    root = scratch_dir(spark, "rollup")
    early, late = audit.filter("timestamp < '2024-01-11'"), audit.filter("timestamp >= '2024-01-21'")
    assert rollup.read_parts(spark, root).count() == 0 and rollup.refresh(spark, root) == []
    tables.append(early, root, "audit_logs", "one")
    assert len(rollup.refresh(spark, root)) == 10
    before = files(spark, root)
    assert rollup.refresh(spark, root) == [] and files(spark, root) == before

    tables.append(late, root, "audit_logs", "two")
    assert min(rollup.refresh(spark, root)) == "2024-01-21"
    after = files(spark, root)
    assert {d: f for d, f in after.items() if d in before} == before and len(after) > len(before)
    everything = P.daily_parts(early.unionByName(late))
    assert parts_without_sketches(rollup.read_parts(spark, root)) == parts_without_sketches(everything)

    # Replaced by fewer days: the parts of days that have no rows any more go.
    tables.append(early.filter("timestamp < '2024-01-04'"), root, "audit_logs", "one")
    assert len(rollup.refresh(spark, root)) == 10
    rest = P.daily_parts(early.filter("timestamp < '2024-01-04'").unionByName(late))
    assert parts_without_sketches(rollup.read_parts(spark, root)) == parts_without_sketches(rest)

    # A batch that is gone.
    tables.append(late.limit(0), root, "audit_logs", "two")
    rollup.refresh(spark, root)
    assert rollup.read_parts(spark, root).agg(F.max("event_date")).first()[0].isoformat() == "2024-01-03"


def test_refresh_reads_the_days_of_changed_batches_only(spark, audit, monkeypatch):
    root = scratch_dir(spark, "rollup")
    tables.append(audit, root, "audit_logs", "one")
    rollup.refresh(spark, root)
    tables.append(audit.filter("timestamp >= '2024-01-29'"), root, "audit_logs", "two")
    plans = []
    for name, make in rollup.PARTS.items():
        monkeypatch.setitem(rollup.PARTS, name, lambda df, make=make: plans.append(df) or make(df))
    rollup.refresh(spark, root)
    read = next(df for df in plans if df.limit(1).count())
    wanted = read.select("event_date").distinct().collect()
    assert min(days_of(wanted)) == "2024-01-29"
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "2024-01-29" not in scan.split("PartitionFilters")[0]
    everything = P.daily_parts(audit.unionByName(audit.filter("timestamp >= '2024-01-29'")))
    assert parts_without_sketches(rollup.read_parts(spark, root)) == parts_without_sketches(everything)


def test_parts_survive_compaction(spark, audit):
    root = scratch_dir(spark, "rollup")
    for batch in ("one", "two"):
        tables.append(audit, root, "audit_logs", batch)
    rollup.refresh(spark, root)
    before = parts_without_sketches(rollup.read_parts(spark, root))
    tables.compact(spark, root, "audit_logs", "2024-01-16")
    rollup.refresh(spark, root)
    assert parts_without_sketches(rollup.read_parts(spark, root)) == before
    assert rollup.refresh(spark, root) == []


def test_reports_of_parts_equal_those_of_rows(spark, audit):
    parts = P.daily_parts(audit)
    for first, last in (("2024-01-05", "2024-01-05"), ("2024-01-01", "2024-01-30"), ("2023-12-01", "2024-02-10")):
        rows = audit.filter(F.to_date("timestamp").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        one, other = P.overall(parts, first, last).first(), U.usage_overall(rows, "2024-12-31", 10_000).first()
        assert one.asDict() == other.asDict()  # so few users that their sketch is exact
        assert sorted(P.over_time(parts, first, last).collect()) == sorted(U.requests_over_time(rows, "2024-12-31", 10_000).collect())
        days = P.percentiles(parts, first, last, {"date": F.col("event_date")}).collect()
        assert all(r.p50_ms <= r.p90_ms <= r.p99_ms for r in days)
    assert P.overall(parts, "2020-01-01", "2020-01-01").first().total_requests == 0
    assert P.overview(parts, "2020-01-01", "2020-01-01").first().pii_rate_percent is None
    with pytest.raises(ValueError):
        P.overall(parts, "2024-01-01", "2024-04-30")


def test_estimates_of_many_users_and_times(spark):
    rows = spark.range(200_000).selectExpr(
        "timestamp '2024-01-01' + make_dt_interval(CAST(id % 20 AS INT)) AS timestamp", "concat('u', id % 50000) AS user_id",
        "'a' AS agent_id", "'d' AS department", "'toxicity' AS guardrail_type", "'passed' AS status", "false AS has_pii",
        "CAST(pmod(xxhash64(id), 100000) AS DOUBLE) AS processing_time_ms",
    )
    parts = P.daily_parts(rows)
    users = P.overall(parts, "2024-01-01", "2024-01-20").first().unique_users
    assert abs(users - 50_000) <= 3 * P.USER_ERROR * 50_000
    found = P.percentiles(parts, "2024-01-01", "2024-01-20").first()
    for name, p in P.PERCENTILES.items():
        assert abs(found[name] / 100_000 - p) <= 2 * P.RANK_ERROR


def test_null_groups_and_times(spark):
    schema = "timestamp timestamp, user_id string, agent_id string, department string, guardrail_type string, status string, has_pii boolean, processing_time_ms double"
    rows = [(T0, None, "a", None, "toxicity", "passed", None, None), (T0, "u", "a", None, "toxicity", None, True, 2.0), (None, "u", "a", "d", "toxicity", "passed", True, 1.0)]
    parts = P.daily_parts(spark.createDataFrame(rows, schema))
    found = P.by_department(parts, "2024-01-01", "2024-01-02").collect()
    assert [tuple(r) for r in found] == [("unknown", 1, 2, 1, 1, 0, 2.0)]


def folders(spark, root, table="audit_logs"):
    return {n for n in batches.names(spark, tables.path_of(root, table)) if n.startswith("event_date=")}


def test_a_write_lists_no_other_days(spark, audit, monkeypatch):
    root = scratch_dir(spark, "writes")
    tables.append(audit, root, "audit_logs", "one")
    monkeypatch.setattr(tables, "_days_on_disk", lambda *_: pytest.fail("all days were listed"))
    tables.append(audit.filter("timestamp < '2024-01-03'"), root, "audit_logs", "two")
    tables.append(audit.filter("timestamp >= '2024-01-29'"), root, "audit_logs", "two")
    stored = tables.read_table(spark, root, "audit_logs").filter("batch_id = 'two'")
    assert stored.agg(F.min("event_date")).first()[0].isoformat() == "2024-01-29"


def test_a_run_that_broke_off_is_replaced_whole(spark, audit, monkeypatch):
    root = scratch_dir(spark, "broken")
    tables.append(audit, root, "audit_logs", "other")
    monkeypatch.setattr(batches, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.append(audit, root, "audit_logs", "one")
    monkeypatch.undo()
    few = audit.filter("timestamp < '2024-01-03'")
    tables.append(few, root, "audit_logs", "one")
    assert tables.read_table(spark, root, "audit_logs").filter("batch_id = 'one'").count() == few.count()


def test_compaction_swaps_whole_days(spark, audit, monkeypatch):
    """Stopped after any move, a reader that comes then finds every day with its rows, and the next run ends the work."""
    root = scratch_dir(spark, "swap")
    for batch in ("one", "two"):
        tables.append(audit.filter("timestamp < '2024-01-05'"), root, "audit_logs", batch)
    rename, moves = batches.rename, []

    def stop_after_four(*args):
        if len(moves) == 4:
            raise OSError("lost")
        moves.append(args)
        rename(*args)

    monkeypatch.setattr(batches, "rename", stop_after_four)
    with pytest.raises(OSError):
        tables.compact(spark, root, "audit_logs", "2024-01-04")
    assert len(folders(spark, root)) == 4
    expected = 2 * audit.filter("timestamp < '2024-01-05'").count()
    assert tables.read_table(spark, root, "audit_logs").count() == expected
    monkeypatch.undo()
    tables.compact(spark, root, "audit_logs", "2024-01-04")
    stored = tables.read_table(spark, root, "audit_logs")
    assert stored.count() == expected
    assert {r[0] for r in stored.filter("event_date < '2024-01-04'").select("batch_id").distinct().collect()} == {"compacted"}
    # A batch that is replaced afterwards loses its later days only.
    tables.append(audit.limit(0), root, "audit_logs", "two")
    assert tables.read_table(spark, root, "audit_logs").count() == expected - audit.filter("timestamp >= '2024-01-04' AND timestamp < '2024-01-05'").count()


def scanned_days(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :]


def test_latest_rows_read_the_newest_days_only(spark, audit):
    root = scratch_dir(spark, "latest")
    # No personal data in the newest days.
    tables.append(audit.withColumn("has_pii", F.col("has_pii") & (F.col("timestamp") < F.lit("2024-01-27"))), root, "audit_logs", "one")
    table = tables.read_table(spark, root, "audit_logs")
    found = U.recent_pii_incidents(table, 5, "2024-01-30")
    assert "event_date#" in scanned_days(found) and "2024-01-2" in scanned_days(found)
    rows = table.drop("event_date")
    assert [r.request_id for r in found.collect()] == [r.request_id for r in U.recent_pii_incidents(rows, 5).collect()]
    everything = U.recent_pii_incidents(table, 10_000, "2024-01-30")
    assert everything.count() == table.filter("has_pii").count()


def test_latest_rows_before_and_after_the_date(spark, sf_dir):
    root = scratch_dir(spark, "suggestions")
    feedback = X.feedback(spark, sf_dir)
    tables.append(feedback, root, "feedback", "one")
    table = tables.read_table(spark, root, "feedback")
    expected = [r.feedback_id for r in FB.recent_suggestions(feedback).collect()]
    for as_of in ("2024-01-10", "2024-01-30", "2031-01-01", None):
        assert [r.feedback_id for r in FB.recent_suggestions(table, as_of=as_of).collect()] == expected
    assert FB.recent_suggestions(table.limit(0)).collect() == []


def test_replay_keeps_values_and_types(spark, audit):
    """A mended row equals the row that was right from the start, in every column, whatever its values."""
    root, other = scratch_dir(spark, "replay"), scratch_dir(spark, "right")
    text = F.when(F.col("has_pii"), F.lit('a "quoted" \\ line\n\U0001f600')).otherwise(F.col("original_prompt"))
    right = audit.withColumns({"original_prompt": text, "timestamp": F.expr("timestamp + INTERVAL 1 MICROSECOND")})
    wrong = right.withColumn("agent_id", F.when(F.xxhash64("request_id") % 2 == 0, F.col("agent_id")))
    tables.append_audit(wrong, root, "one")
    assert replay.open_letters(spark, root, "audit_logs", "one").count() > 0
    mend = lambda rows: rows.drop("agent_id").join(right.select("request_id", "agent_id"), "request_id")
    for _ in range(2):
        replay.replay_audit(spark, root, "one", mend)
    tables.append(right, other, "audit_logs", "one")
    columns = [c for c in right.columns if c != "batch_id"]
    mended, given = (tables.read_table(spark, r, "audit_logs").select(*columns) for r in (root, other))
    assert mended.exceptAll(given).count() == given.exceptAll(mended).count() == 0
    assert replay.open_letters(spark, root, "audit_logs", "one").count() == 0
    replay.replay_audit(spark, root, "never written", mend)
    assert tables.read_table(spark, root, "audit_logs").count() == right.count()


def test_compacted_changes_keep_the_newest(spark):
    from govlens.streaming import jobs

    path = scratch_dir(spark, "changes")
    for run, batch, rows in ((1, 0, [("a", 1), ("b", 1)]), (1, 1, [("a", 2)]), (2, 0, [("b", 5), ("c", None)])):
        version = F.struct(F.lit(run).cast("long").alias("run"), F.lit(batch).cast("long").alias("batch"))
        tables.write_batch(spark.createDataFrame(rows, "k string, n long").withColumn("version", version), path, f"{run}-{batch}")
    for _ in range(2):
        jobs.compact_changes(spark, path, "k")
        changes = spark.read.parquet(path)
        assert changes.count() == 3
        assert sorted(map(tuple, jobs.current(changes, "k", ["n"]).collect())) == [("a", 2), ("b", 5), ("c", None)]

