"""Analytics: definitions that the aggregated forms must keep, empty inputs, ties."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from govlens.operators import feedback as FB
from govlens.operators import registry as R
from govlens.operators import usage as U
from govlens.plans import usage_report as P
from govlens.sources import fixtures as X


@pytest.fixture(scope="module")
def audit(spark, sf_dir):
    return X.audit_logs(spark, sf_dir)


@pytest.fixture(scope="module")
def agents(spark, sf_dir):
    return X.agents(spark, sf_dir)


def test_guardrail_counts_sum_to_the_total(audit):
    total = U.usage_overall(audit, X.AS_OF, 30).collect()[0].total_requests
    assert U.usage_by_guardrail(audit, X.AS_OF, 30).agg(F.sum("count")).collect()[0][0] == total


def test_top_agents_fan_out_with_repeated_registrations(audit, agents):
    """Aggregating before the join equals joining first, also when agents are registered several times."""
    renamed = agents.withColumn("agent_name", F.concat("agent_name", F.lit("-2")))
    registry = agents.unionByName(agents).unionByName(renamed).unionByName(agents.withColumn("team", F.lit("t")))
    joined_first = (
        audit.alias("a")
        .join(registry.alias("g"), F.col("a.agent_id") == F.col("g.agent_id"), "left")
        .groupBy("a.agent_id", "g.agent_name", "g.department")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("a.user_id").alias("u"),
            F.count_if("a.has_pii").alias("p"),
            F.round(F.avg("a.processing_time_ms"), 2).alias("ms"),
        )
        .select("agent_id", F.coalesce("agent_name", "agent_id"), F.coalesce("department", F.lit("Unknown")), "n", "u", "p", "ms")
    )
    got = U.top_agents_named(audit, registry, X.AS_OF, top=1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined_first.collect()))


def test_empty_audit_gives_zeros(spark, audit, agents):
    none = audit.filter("false")
    assert tuple(U.usage_overall(none, X.AS_OF).collect()[0]) == (0, 0, 0, 0, 0, 0)
    row = U.overview_metrics(none, X.AS_OF).collect()[0]
    assert row.total_requests == 0 and row.pii_rate_percent is None and row.avg_response_time_ms is None
    report = P.usage_analytics(none, X.AS_OF).collect()[0]
    assert report.total_requests == 0 and report.by_department == [] and report.by_guardrail == {}
    summary = P.dashboard_summary(agents, none, X.AS_OF).collect()[0]
    assert summary.total_requests_period == 0 and summary.pii_incident_rate == 0.0 and summary.total_agents > 0
    stats = R.agents_with_stats(agents, none).collect()
    assert len(stats) == agents.count() and all(r.total_requests == 0 for r in stats)


def test_report_equals_its_parts(audit):
    report = P.usage_analytics(audit, X.AS_OF, 7).collect()[0]
    by_department = U.usage_by_department(audit, X.AS_OF, 7).collect()
    assert [(d.department, d.total_requests, d.total_users, d.total_agents) for d in report.by_department] == [
        (d.department, d.total_requests, d.total_users, d.total_agents) for d in by_department
    ]
    for mine, theirs in zip(report.by_department, by_department, strict=True):
        assert mine.avg_response_time_ms == pytest.approx(theirs.avg_response_time_ms)
    by_agent = U.usage_by_agent(audit, X.AS_OF, 7).collect()
    assert [(a.agent_id, a.total_requests) for a in report.by_agent] == [(a.agent_id, a.total_requests) for a in by_agent]
    assert report.by_guardrail == {r["guardrail_type"]: r["count"] for r in U.usage_by_guardrail(audit, X.AS_OF, 7).collect()}
    with pytest.raises(ValueError, match="days"):
        P.usage_analytics(audit, X.AS_OF, 91)


def test_dashboard_data_has_all_sections(audit, agents):
    data = P.dashboard_data(agents, audit, X.AS_OF)
    assert set(data) == {"analytics", "leaderboard", "agents", "summary"}
    assert all(df.count() > 0 for df in data.values())


def test_range_is_closed_at_both_ends(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 1),), (datetime(2024, 1, 8),), (datetime(2024, 1, 8, 0, 0, 1),), (datetime(2023, 12, 31, 23, 59, 59),)],
        "timestamp timestamp",
    ).withColumns({"user_id": F.lit("u"), "agent_id": F.lit("a"), "has_pii": F.lit(False), "status": F.lit("passed")})
    assert U.usage_overall(rows, "2024-01-08 00:00:00", 7).collect()[0].total_requests == 2


def test_null_department_joins_its_label(spark):
    rows = spark.createDataFrame(
        [(None, "u"), ("unknown", "u"), ("Sales", "v")], "department string, user_id string"
    ).withColumns(
        {"timestamp": F.lit(datetime(2024, 1, 30)), "agent_id": F.lit("a"), "has_pii": F.lit(True)}
    )
    found = {r.department: (r.total_requests, r.unique_users, r.pii_rate) for r in U.department_leaderboard(rows, X.AS_OF).collect()}
    assert found == {"unknown": (2, 1, 100.0), "Sales": (1, 1, 100.0)}


def test_risk_bands(spark):
    rows = spark.createDataFrame([(50.1,), (50.0,), (20.1,), (20.0,), (None,)], "pii_rate double")
    assert [r.risk_band for r in U.pii_risk_bands(rows).collect()] == ["red", "yellow", "yellow", "green", "green"]


def test_feedback_summary_filters_and_rounds_half_even(spark):
    rows = spark.createDataFrame(
        [("a", "helpful", None)] + [("a", "incorrect", "u")] * 7 + [("b", "helpful", "u")],
        "agent_id string, rating string, user_id string",
    ).withColumn("timestamp", F.lit(datetime(2024, 1, 30)))
    found = FB.feedback_summary(rows, X.AS_OF, agent_id="a").collect()
    assert len(found) == 1
    assert (found[0].total_feedback, found[0].unique_users, found[0].helpful_rate) == (8, 1, 12.5)
    assert FB.feedback_summary(rows, X.AS_OF, agent_id="zz").collect() == []


def test_feedback_to_session_takes_the_latest(spark):
    audit = spark.createDataFrame(
        [("r1", "s1"), ("r1", "s1"), ("r2", "s1"), ("r3", None)], "request_id string, session_id string"
    )
    feedback = spark.createDataFrame(
        [("f1", "r1", "helpful", datetime(2024, 1, 1)), ("f2", "r2", "incorrect", datetime(2024, 1, 2)),
         ("f3", "r1", "not_helpful", datetime(2024, 1, 1, 1)), ("f4", "r3", "helpful", datetime(2024, 1, 5))],
        "feedback_id string, request_id string, rating string, timestamp timestamp",
    )
    assert [(r.session_id, r.rating) for r in FB.feedback_to_session(feedback, audit).collect()] == [("s1", "incorrect")]


def test_latest_agents(spark, agents):
    newer = agents.withColumns({"updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY"), "agent_name": F.lit("new")})
    found = R.latest_agents(agents.unionByName(newer))
    assert found.count() == agents.count() and found.filter("agent_name <> 'new'").count() == 0


def test_filtered_agent_list(audit, agents):
    department = agents.first().department
    found = R.agents_with_stats(agents, audit, department=department).collect()
    assert found and all(r.department == department for r in found)
    assert [r.agent_name for r in found] == sorted(r.agent_name for r in found)
