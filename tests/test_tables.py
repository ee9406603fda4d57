"""Tables, hygiene and exports."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from govlens import schemas as S
from govlens.operators import hygiene as H
from govlens.operators import usage as U
from govlens.operators.conversations import training_export
from govlens.plans.screening import screen, screen_to_table
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from govlens.streaming import jobs


def test_append_partitions_by_day_and_reads_back(spark, sf_dir):
    root = scratch_dir(spark, "tables")
    rows = X.audit_logs(spark, sf_dir)
    tables.append(rows, root, "audit_logs")
    stored = tables.read_table(spark, root, "audit_logs")
    assert stored.columns == [*S.AUDIT_LOGS.schema.fieldNames(), "event_date", "batch_id"]
    assert stored.count() == rows.count()
    assert stored.filter(F.to_date("timestamp") != F.col("event_date")).count() == 0


def test_reports_prune_days_and_columns(spark, sf_dir):
    root = scratch_dir(spark, "pruning")
    tables.append(X.audit_logs(spark, sf_dir), root, "audit_logs")
    audit = tables.read_table(spark, root, "audit_logs")
    report = U.usage_by_department(audit, X.AS_OF, 7)
    plan = report._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "event_date" in scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "GreaterThanOrEqual(timestamp" in scan.split("PushedFilters:")[1]
    assert "original_prompt" not in scan and "metadata" not in scan
    counts = lambda df: sorted(tuple(r)[:-1] for r in df.collect())
    assert counts(report) == counts(U.usage_by_department(X.audit_logs(spark, sf_dir), X.AS_OF, 7))


def test_recent_incidents_read_text_of_the_chosen_days_only(spark, sf_dir):
    root = scratch_dir(spark, "incidents")
    tables.append(X.audit_logs(spark, sf_dir), root, "audit_logs")
    found = U.recent_pii_incidents(tables.read_table(spark, root, "audit_logs"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    expected = U.recent_pii_incidents(X.audit_logs(spark, sf_dir), 5)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in expected.collect()]


def test_missing_table_is_empty(spark):
    for name in S.TABLES:
        assert tables.read_table(spark, scratch_dir(spark, "none"), name).count() == 0


def test_repeated_batch_replaces_its_rows(spark, sf_dir):
    root = scratch_dir(spark, "repeat")
    rows = X.feedback(spark, sf_dir)
    for batch in ("monday", "tuesday", "monday"):
        tables.append(rows, root, "feedback", batch)
    assert tables.read_table(spark, root, "feedback").count() == 2 * rows.count()


def test_unpartitioned_table_appends(spark, sf_dir):
    root = scratch_dir(spark, "agents")
    agents = X.agents(spark, sf_dir)
    tables.append(agents, root, "agents")
    tables.append(agents, root, "agents")
    assert tables.read_table(spark, root, "agents").count() == 2 * agents.count()


def test_batch_and_stream_share_the_audit_table(spark):
    """Both writers use the same layout, so one read sees all rows."""
    schema = "request_id string, timestamp timestamp, agent_id string, prompt string, guardrails array<string>"
    rows = spark.createDataFrame(
        [(f"r{i}", datetime(2024, 1, 1 + i % 3), "a", f"u{i}@b.com", ["pii_detection"]) for i in range(9)], schema
    )
    root, feed = scratch_dir(spark, "shared"), scratch_dir(spark, "feed")
    rows.write.parquet(feed)
    for _ in range(2):
        screen_to_table(rows, root, "load-1")
        arriving = spark.readStream.schema(schema).parquet(feed)
        jobs.run_screening(arriving, root, f"{root}/checkpoint").awaitTermination()
    assert tables.read_table(spark, root, "audit_logs").count() == 18


def test_create_tables_in_the_catalog(spark):
    root = scratch_dir(spark, "catalog")
    spark.sql("CREATE DATABASE IF NOT EXISTS governance_test")
    names = tables.create_tables(spark, root, "governance_test")
    assert names == tables.create_tables(spark, root, "governance_test")
    assert spark.table("governance_test.audit_logs").count() == 0
    assert "event_date" in spark.table("governance_test.feedback").columns
    assert "event_date" not in spark.table("governance_test.agents").columns
    spark.sql("DROP DATABASE governance_test CASCADE")


def test_hot_day_is_written_whole(spark, sf_dir):
    root = scratch_dir(spark, "hot")
    rows = X.audit_logs(spark, sf_dir).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    tables.append(rows, root, "audit_logs")
    assert tables.read_table(spark, root, "audit_logs").count() == rows.count()


def test_required_and_value_violations(spark):
    now = datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [("a", "x", "passed", 1, now), (None, "x", "odd", 1, now), ("c", None, None, None, None)],
        "request_id string, agent_id string, status string, prompt_length long, timestamp timestamp",
    )
    found = [r.violations for r in H.check(rows, "audit_logs").collect()]
    assert found == [
        [],
        ["missing:request_id", "invalid:status"],
        ["missing:timestamp", "missing:agent_id", "missing:status", "missing:prompt_length"],
    ]


def test_message_and_result_constraints(spark):
    rows = spark.createDataFrame(
        [("user", 1), ("system", 0), ("assistant", 10_000), ("assistant", 10_001)], "role string, turn_number long"
    )
    assert [r.violations for r in H.check(rows, "conversation_messages").collect()] == [
        [], ["invalid:role", "invalid:turn_number"], [], ["invalid:turn_number"],
    ]
    results = spark.createDataFrame([("passed", 1.2), ("failed", 1.0)], "status string, confidence double")
    assert [r.violations for r in H.check(results, "results").collect()] == [
        ["invalid:confidence"], ["invalid:status"],
    ]


def test_parameter_ranges():
    assert H.check_range("days", 90, 1, 90) == 90
    with pytest.raises(ValueError, match="days"):
        H.check_range("days", 91, 1, 90)


def test_screen_splits_off_incomplete_requests(spark):
    rows = spark.createDataFrame(
        [("a", "hi a@b.com", datetime(2024, 1, 1)), (None, "x", datetime(2024, 1, 1)), ("c", None, None)],
        "request_id string, prompt string, timestamp timestamp",
    )
    audit, rejected = screen(rows)
    assert [(r.request_id, r.agent_id, r.has_pii) for r in audit.collect()] == [("a", "default", True)]
    assert sorted(r.violations for r in rejected.collect()) == [
        ["missing:request_id"], ["missing:timestamp", "missing:prompt"],
    ]


def test_export_writes_lines_and_manifest(spark, sf_dir):
    path = scratch_dir(spark, "export")
    out = training_export(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.AS_OF)
    manifest = tables.export_jsonl(out, path, {"days": 30})
    lines = spark.read.text(f"{path}/conversations").collect()
    assert manifest["total_conversations"] == len(lines) == out.count()
    assert set(json.loads(lines[0].value)) >= {"session_id", "agent_id", "messages", "stats"}
    assert json.loads(spark.read.text(f"{path}/manifest").collect()[0].value) == manifest


def test_scratch_dir_reads_the_session(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_a_repeated_batch_drops_the_days_it_no_longer_has(spark, sf_dir):
    root = scratch_dir(spark, "changed")
    rows = X.audit_logs(spark, sf_dir)
    tables.append(rows, root, "audit_logs", "b1")
    tables.append(rows, root, "audit_logs", "b2")
    fewer = rows.filter("timestamp >= '2024-01-10'")
    tables.append(fewer, root, "audit_logs", "b1")
    found = tables.read_table(spark, root, "audit_logs").groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in found} == {"b1": fewer.count(), "b2": rows.count()}


def test_compaction_is_taken_up_after_a_failure(spark, sf_dir, monkeypatch):
    root = scratch_dir(spark, "compaction")
    rows = X.audit_logs(spark, sf_dir)
    tables.append(rows, root, "audit_logs", "b1")
    tables.append(rows, root, "audit_logs", "b2")
    write = tables.write_batch
    monkeypatch.setattr(tables, "write_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.compact(spark, root, "audit_logs", "2024-01-16")
    monkeypatch.setattr(tables, "write_batch", write)
    tables.compact(spark, root, "audit_logs", "2024-01-16")
    stored = tables.read_table(spark, root, "audit_logs")
    assert stored.count() == 2 * rows.count()
    assert {r.batch_id for r in stored.filter("event_date < '2024-01-16'").select("batch_id").distinct().collect()} == {"compacted"}
