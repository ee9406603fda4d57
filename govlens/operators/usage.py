"""Usage, risk and latency analytics over the audit table.

Every operator reads a few narrow columns, aggregates map-side first, and groups by keys whose partial results are
small. Distinct counts are planned by Spark as two aggregation levels, (group, value) and then group, so a group with
a third of all rows is spread over its values instead of landing in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.functions.columns import json_strings
from govlens.operators.common import last_days, newest_days, period
from govlens.operators.hygiene import check_range

AsOf = datetime | str | None


def requests() -> Column:
    """Number of audit rows, that is of checks: a request with three guardrails counts three times."""
    return F.count(F.lit(1)).alias("total_requests")


def users() -> Column:
    return F.count_distinct("user_id").alias("unique_users")


def agents(name: str = "unique_agents") -> Column:
    return F.count_distinct("agent_id").alias(name)


def pii(name: str = "pii_incidents") -> Column:
    return F.count_if(F.col("has_pii")).alias(name)


def with_status(status: str, name: str) -> Column:
    return F.count_if(F.col("status") == status).alias(name)


def rate(part: str, whole: str) -> Column:
    """Percentage with two decimals, NULL on an empty group."""
    return F.round(F.try_divide(F.col(part) * F.lit(100.0), F.col(whole)), 2)


def department(unknown: str) -> Column:
    return F.coalesce("department", F.lit(unknown)).alias("department")


def usage_overall(audit: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Totals of the period, one row; zeros when it is empty."""
    return period(audit, as_of, days).agg(
        requests(),
        users(),
        agents(),
        pii("pii_detected_count"),
        with_status("blocked", "blocked_count"),
        with_status("passed", "passed_count"),
    )


def usage_by_department(audit: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Per department, most requests first."""
    return (
        period(audit, as_of, days)
        .groupBy(department("unknown"))
        .agg(
            agents("total_agents"),
            requests(),
            F.count_distinct("user_id").alias("total_users"),
            pii(),
            with_status("blocked", "blocked_requests"),
            F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_response_time_ms"),
        )
        .orderBy(F.desc("total_requests"), "department")
    )


def usage_by_agent(audit: DataFrame, as_of: AsOf = None, days: int = 7, top: int = 10) -> DataFrame:
    """The busiest agents."""
    return (
        period(audit, as_of, days)
        .groupBy("agent_id")
        .agg(
            requests(), users(), pii(), F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_response_time_ms")
        )
        .orderBy(F.desc("total_requests"), "agent_id")
        .limit(top)
    )


def usage_by_guardrail(audit: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Checks per guardrail type."""
    return period(audit, as_of, days).groupBy("guardrail_type").agg(F.count(F.lit(1)).alias("count"))


def department_leaderboard(audit: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Departments by usage, with their PII rate."""
    return _department_usage(audit, as_of, days, "unknown", "unique_agents")


def department_breakdown(audit: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """The dashboard's form of the leaderboard."""
    return _department_usage(audit, as_of, days, "Unknown", "agents_used")


def _department_usage(audit: DataFrame, as_of: AsOf, days: int, unknown: str, agents_name: str) -> DataFrame:
    return (
        last_days(audit, as_of, days)
        .groupBy(department(unknown))
        .agg(requests(), users(), agents(agents_name), pii())
        .withColumn("pii_rate", rate("pii_incidents", "total_requests"))
        .orderBy(F.desc("total_requests"), "department")
    )


def user_activity(audit: DataFrame, as_of: AsOf = None, days: int = 30, top: int = 50) -> DataFrame:
    """The most active users per department label."""
    return (
        last_days(audit, as_of, days)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id", department("Unknown"))
        .agg(requests(), pii(), agents("agents_used"), F.max("timestamp").alias("last_activity"))
        .orderBy(F.desc("total_requests"), "user_id", "department")
        .limit(top)
    )


def overview_metrics(audit: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Score-card totals, one row; rate and average are NULL when the period is empty."""
    return (
        last_days(audit, as_of, days)
        .agg(requests(), users(), agents(), pii(), F.round(F.avg("processing_time_ms"), 2).alias("avg_response_time_ms"))
        .withColumn("pii_rate_percent", rate("pii_incidents", "total_requests"))
    )


def requests_over_time(audit: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Checks per day."""
    return (
        last_days(audit, as_of, days)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(
            requests(), with_status("blocked", "blocked_requests"), with_status("passed", "passed_requests"), pii()
        )
        .orderBy("date")
    )


def hourly_heatmap(audit: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Checks per weekday (1 = Sunday) and hour."""
    return (
        last_days(audit, as_of, days)
        .groupBy(F.dayofweek("timestamp").alias("day_of_week"), F.hour("timestamp").alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("request_count"))
        .orderBy("day_of_week", "hour_of_day")
    )


def latency_percentiles(audit: DataFrame, as_of: AsOf = None, days: int = 30, accuracy: int = 10_000) -> DataFrame:
    """Approximate p50, p90 and p99 of the processing time per day, from mergeable sketches."""
    points = F.percentile_approx("processing_time_ms", [0.5, 0.9, 0.99], accuracy)
    return (
        last_days(audit, as_of, days)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.count(F.lit(1)).alias("request_count"), points.alias("p"))
        .select(
            "date",
            "request_count",
            F.col("p")[0].alias("p50_ms"),
            F.col("p")[1].alias("p90_ms"),
            F.col("p")[2].alias("p99_ms"),
        )
        .orderBy("date")
    )


def recent_pii_incidents(audit: DataFrame, top: int = 100, as_of: AsOf = None) -> DataFrame:
    """The latest rows with personal data.

    Where the table has day partitions, only as many of the newest days are read as hold ``top`` such rows. The rows are chosen on their narrow columns first. That list of at most ``top`` keys is broadcast back to the
    table, so the long text columns are read for the days of the chosen rows only.
    """
    # Written as a comparison: Spark prunes partitions at run time only when the other side has a comparison filter.
    check_range("top", top, 1, 10_000)
    found = audit.filter(F.col("has_pii").eqNullSafe(True))
    if "event_date" in audit.columns:
        found = newest_days(found, top, as_of)
    key = ["event_date", "timestamp", "request_id"] if "event_date" in audit.columns else ["timestamp", "request_id"]
    latest = [F.desc("timestamp"), F.asc("request_id")]
    newest = found.select(*key).orderBy(*latest).limit(top)
    return (
        found.join(F.broadcast(newest.distinct()), key, "left_semi")
        .select(
            "timestamp",
            "request_id",
            "agent_id",
            "user_id",
            "department",
            F.from_json("metadata", "pii_types array<string>")["pii_types"].alias("pii_types"),
            F.substring("original_prompt", 1, 100).alias("prompt_preview"),
            "redacted_prompt",
        )
        .orderBy(*latest)
        .limit(top)
    )


def pii_type_breakdown(audit: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    """Occurrences per personal-data type; rows without a type list drop out."""
    types = json_strings(F.get_json_object("metadata", "$.pii_types"))
    return (
        last_days(audit, as_of, days)
        .filter(F.col("has_pii"))
        .select(F.explode(types).alias("pii_type"))
        .groupBy("pii_type")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "pii_type")
    )


def top_agents_named(
    audit: DataFrame, registry: DataFrame, as_of: AsOf = None, days: int = 30, top: int = 10
) -> DataFrame:
    """The busiest agents with their registered name and department.

    Defined as audit LEFT JOIN registry, grouped by (agent, name, department), so an agent registered m times under
    the same name counts m-fold. Both sides are aggregated before the join (counts times m is the same number): the
    join sees one row per agent, whatever share of the audit rows an agent has.
    """
    stats = (
        last_days(audit, as_of, days)
        .groupBy("agent_id")
        .agg(F.count(F.lit(1)).alias("n"), users(), pii("n_pii"), F.avg("processing_time_ms").alias("avg_ms"))
    )
    names = registry.groupBy("agent_id", "agent_name", "department").agg(F.count(F.lit(1)).alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    return (
        stats.join(names, "agent_id", "left")
        .select(
            "agent_id",
            F.coalesce("agent_name", "agent_id").alias("agent_name"),
            department("Unknown"),
            (F.col("n") * copies).alias("total_requests"),
            "unique_users",
            (F.col("n_pii") * copies).alias("pii_incidents"),
            F.round("avg_ms", 2).alias("avg_response_time_ms"),
        )
        .orderBy(F.desc("total_requests"), "agent_id", "agent_name", "department")
        .limit(top)
    )


def top_agents_per_department(audit: DataFrame, as_of: AsOf = None, days: int = 7, top: int = 5) -> DataFrame:
    """The busiest agents of each department, as an array of (agent_id, total_requests).

    The ranking runs over one row per (department, agent); only ``top`` of them per department are collected.
    """
    counts = period(audit, as_of, days).groupBy(department("unknown"), "agent_id").agg(requests())
    window = Window.partitionBy("department").orderBy(F.desc("total_requests"), "agent_id")
    ranked = counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    entries = F.sort_array(F.collect_list(F.struct("rank", F.struct("agent_id", "total_requests").alias("agent"))))
    return ranked.groupBy("department").agg(F.transform(entries, lambda e: e["agent"]).alias("top_agents"))


def risk_band(rate_column: str = "pii_rate") -> Column:
    """red above 50 percent, yellow above 20, else green."""
    value = F.col(rate_column)
    return F.when(value > 50, "red").when(value > 20, "yellow").otherwise("green")


def pii_risk_bands(rates: DataFrame, rate_column: str = "pii_rate") -> DataFrame:
    """Add the band and the rate as shown, with one decimal."""
    return rates.withColumn("risk_band", risk_band(rate_column)).withColumn("rate_shown", F.round(rate_column, 1))
