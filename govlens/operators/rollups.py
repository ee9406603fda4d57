"""Usage reports over any period from stored daily parts, without reading audit rows again.

A part is one row per day, department, agent and guardrail type: counts, sum and number of the processing times, and two
mergeable sketches, of the users (HyperLogLog) and of the times (KLL). Sums and sketches of days add up to those of weeks
and months, so a report over 90 days reads some thousand narrow rows, however many checks there were. Counts, sums and
numbers of agents are exact. Numbers of users and percentiles are estimates with the errors below.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.operators.hygiene import check_range
from govlens.operators.usage import department, rate

# Size of the sketches. Relative standard error of a number of users: 1.04 / sqrt(2**12) = 1.6 %; up to some hundred
# users it is exact but for hash collisions.
LOG_USERS = 12
USER_ERROR = 1.04 / 2 ** (LOG_USERS / 2)
# Rank error of a percentile, with 99 % confidence: 2.296 / k**0.9723.
LATENCY_K = 800
RANK_ERROR = 2.296 / LATENCY_K**0.9723

PART_KEYS = ["event_date", "department", "agent_id", "guardrail_type"]
PERCENTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}


def daily_parts(audit: DataFrame) -> DataFrame:
    """The parts of audit rows. Every aggregate is partial first: a busy agent costs one row per task."""
    blocked, passed = (F.count_if(F.col("status") == s) for s in ("blocked", "passed"))
    return (
        audit.withColumn("event_date", F.to_date("timestamp"))
        .groupBy(*PART_KEYS)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if("has_pii").alias("pii"),
            blocked.alias("blocked"),
            passed.alias("passed"),
            F.sum("processing_time_ms").alias("ms_sum"),
            F.count("processing_time_ms").alias("ms_count"),
            F.hll_sketch_agg("user_id", LOG_USERS).alias("users"),
            F.kll_sketch_agg_double("processing_time_ms", LATENCY_K).alias("latency"),
        )
    )


def daily_users(audit: DataFrame) -> DataFrame:
    """Per day, user and department: checks, PII, last activity, and a sketch of the agents used."""
    return (
        audit.filter(F.col("user_id").isNotNull())
        .groupBy(F.to_date("timestamp").alias("event_date"), "user_id", "department")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if("has_pii").alias("pii"),
            F.max("timestamp").alias("last_activity"),
            F.hll_sketch_agg("agent_id", LOG_USERS).alias("agents"),
        )
    )


def of_days(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Parts of the days ``first`` to ``last``, both included: 1 to 90 days. Prunes day partitions."""
    days = (date.fromisoformat(str(last)) - date.fromisoformat(str(first))).days + 1
    check_range("days", days, 1, 90)
    return parts.filter(F.col("event_date").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))


def total(name: str, alias: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(alias)


def estimated(sketch: str, alias: str) -> Column:
    """Distinct values of sketches, united."""
    union = F.hll_union_agg(sketch)
    return F.coalesce(F.hll_sketch_estimate(union), F.lit(0)).alias(alias)


def average_ms() -> Column:
    return F.try_divide(F.sum("ms_sum"), F.sum("ms_count").cast("double"))


def overall(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Totals of a period, one row; zeros when it is empty."""
    return of_days(parts, first, last).agg(
        total("requests", "total_requests"),
        estimated("users", "unique_users"),
        F.count_distinct("agent_id").alias("unique_agents"),
        total("pii", "pii_detected_count"),
        total("blocked", "blocked_count"),
        total("passed", "passed_count"),
    )


def by_department(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Per department, most requests first."""
    return (
        of_days(parts, first, last)
        .groupBy(department("unknown"))
        .agg(
            F.count_distinct("agent_id").alias("total_agents"),
            total("requests", "total_requests"),
            estimated("users", "total_users"),
            total("pii", "pii_incidents"),
            total("blocked", "blocked_requests"),
            F.coalesce(average_ms(), F.lit(0.0)).alias("avg_response_time_ms"),
        )
        .orderBy(F.desc("total_requests"), "department")
    )


def by_agent(parts: DataFrame, first: date | str, last: date | str, top: int = 10) -> DataFrame:
    """The busiest agents."""
    return (
        of_days(parts, first, last)
        .groupBy("agent_id")
        .agg(
            total("requests", "total_requests"),
            estimated("users", "unique_users"),
            total("pii", "pii_incidents"),
            F.coalesce(average_ms(), F.lit(0.0)).alias("avg_response_time_ms"),
        )
        .orderBy(F.desc("total_requests"), "agent_id")
        .limit(top)
    )


def by_guardrail(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Checks per guardrail type."""
    return of_days(parts, first, last).groupBy("guardrail_type").agg(total("requests", "count"))


def leaderboard(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Departments by usage, with their PII rate."""
    return (
        of_days(parts, first, last)
        .groupBy(department("unknown"))
        .agg(
            total("requests", "total_requests"),
            estimated("users", "unique_users"),
            F.count_distinct("agent_id").alias("unique_agents"),
            total("pii", "pii_incidents"),
        )
        .withColumn("pii_rate", rate("pii_incidents", "total_requests"))
        .orderBy(F.desc("total_requests"), "department")
    )


def overview(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Score-card totals, one row; rate and average are NULL when the period is empty."""
    return (
        of_days(parts, first, last)
        .agg(
            total("requests", "total_requests"),
            estimated("users", "unique_users"),
            F.count_distinct("agent_id").alias("unique_agents"),
            total("pii", "pii_incidents"),
            F.round(average_ms(), 2).alias("avg_response_time_ms"),
        )
        .withColumn("pii_rate_percent", rate("pii_incidents", "total_requests"))
    )


def over_time(parts: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Checks per day."""
    return (
        of_days(parts, first, last)
        .groupBy(F.col("event_date").alias("date"))
        .agg(
            total("requests", "total_requests"),
            total("blocked", "blocked_requests"),
            total("passed", "passed_requests"),
            total("pii", "pii_incidents"),
        )
        .orderBy("date")
    )


def busiest_users(users: DataFrame, first: date | str, last: date | str, top: int = 50) -> DataFrame:
    """The most active users per department label, from ``daily_users``."""
    return (
        of_days(users, first, last)
        .groupBy("user_id", department("Unknown"))
        .agg(
            total("requests", "total_requests"),
            total("pii", "pii_incidents"),
            estimated("agents", "agents_used"),
            F.max("last_activity").alias("last_activity"),
        )
        .orderBy(F.desc("total_requests"), "user_id", "department")
        .limit(top)
    )


def percentiles(parts: DataFrame, first: date | str, last: date | str, by: dict[str, Column] | None = None) -> DataFrame:
    """Checks with a time, and p50, p90 and p99 of it, per group of ``by`` (name -> expression over parts); overall without.

    A percentile is a value whose rank is off by ``RANK_ERROR`` of the group's rows at most (99 %). NULL without times.
    """
    timed = of_days(parts, first, last).filter(F.col("ms_count") > 0)
    merged = timed.groupBy(*[c.alias(n) for n, c in (by or {}).items()]).agg(
        F.sum("ms_count").alias("timed_requests"), F.kll_merge_agg_double("latency").alias("_latency")
    )
    points = {n: F.when(F.col("timed_requests") > 0, F.kll_sketch_get_quantile_double("_latency", F.lit(p))) for n, p in PERCENTILES.items()}
    return merged.withColumns(points).withColumn("timed_requests", F.coalesce("timed_requests", F.lit(0))).drop("_latency")
