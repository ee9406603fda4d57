"""The usage report and the dashboard data: several analytics in one result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.operators import usage as U
from govlens.operators.common import days_before, moment, period
from govlens.operators.hygiene import check_range
from govlens.operators.registry import agents_with_stats

AsOf = datetime | str | None

MEASURES = {
    "total_requests": "long",
    "unique_users": "long",
    "unique_agents": "long",
    "pii_incidents": "long",
    "blocked_requests": "long",
    "passed_requests": "long",
    "avg_response_time_ms": "double",
}


def usage_sections(audit: DataFrame, as_of: AsOf = None, days: int = 7, top_agents: int = 10) -> DataFrame:
    """The four usage reports in one table: section (overall, department, agent, guardrail), key and measures.

    A measure that a section does not report is NULL. The sections are separate aggregations over the same narrow
    columns, run side by side: sharing one finer pre-aggregation (department, agent, user, guardrail) was slower,
    because it hardly reduces the rows when users are many.
    """
    check_range("days", days, 1, 90)

    def rows(section: str, report: DataFrame, key: Column, **measures: str) -> DataFrame:
        chosen = [
            (F.col(measures[name]) if name in measures else F.lit(None)).cast(kind).alias(name)
            for name, kind in MEASURES.items()
        ]
        return report.select(F.lit(section).alias("section"), key.cast("string").alias("key"), *chosen)

    same = lambda *names: {name: name for name in names}
    return (
        rows(
            "overall",
            U.usage_overall(audit, as_of, days),
            F.lit(None),
            pii_incidents="pii_detected_count",
            blocked_requests="blocked_count",
            passed_requests="passed_count",
            **same("total_requests", "unique_users", "unique_agents"),
        )
        .unionByName(
            rows(
                "department",
                U.usage_by_department(audit, as_of, days),
                F.col("department"),
                unique_users="total_users",
                unique_agents="total_agents",
                **same("total_requests", "pii_incidents", "blocked_requests", "avg_response_time_ms"),
            )
        )
        .unionByName(
            rows(
                "agent",
                U.usage_by_agent(audit, as_of, days, top_agents),
                F.col("agent_id"),
                **same("total_requests", "unique_users", "pii_incidents", "avg_response_time_ms"),
            )
        )
        .unionByName(
            rows(
                "guardrail",
                U.usage_by_guardrail(audit, as_of, days),
                F.col("guardrail_type"),
                total_requests="count",
            )
        )
    )


def usage_analytics(audit: DataFrame, as_of: AsOf = None, days: int = 7, top_agents: int = 10) -> DataFrame:
    """The usage report as one record: period, totals, departments, busiest agents, checks per guardrail.

    The arrays hold the rows of ``usage_sections``: one per department, with its five busiest agents, and guardrail type,
    and the top agents. Where departments are not a short list of names, read ``usage_sections`` and
    ``top_agents_per_department`` instead: they are the same report as rows.
    """
    busiest = U.top_agents_per_department(audit, as_of, days).select(
        F.lit("department").alias("section"), F.col("department").alias("key"), "top_agents"
    )
    sections = usage_sections(audit, as_of, days, top_agents).join(busiest, ["section", "key"], "left")

    def total(measure: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == "overall", F.col(measure))), F.lit(0)).alias(name)

    def entries(section: str, *fields: Column | str) -> Column:
        order = (-F.col("total_requests")).alias("order")
        row = F.when(F.col("section") == section, F.struct(order, "key", F.struct(*fields).alias("entry")))
        return F.transform(F.sort_array(F.collect_list(row)), lambda r: r["entry"])

    return sections.agg(
        total("total_requests", "total_requests"),
        total("unique_users", "unique_users"),
        total("unique_agents", "unique_agents"),
        total("pii_incidents", "pii_detected_count"),
        total("blocked_requests", "blocked_count"),
        total("passed_requests", "passed_count"),
        entries(
            "department",
            F.col("key").alias("department"),
            F.col("unique_agents").alias("total_agents"),
            "total_requests",
            F.col("unique_users").alias("total_users"),
            "pii_incidents",
            "blocked_requests",
            "avg_response_time_ms",
            "top_agents",
        ).alias("by_department"),
        entries(
            "agent",
            F.col("key").alias("agent_id"),
            "total_requests",
            "unique_users",
            "pii_incidents",
            "avg_response_time_ms",
        ).alias("by_agent"),
        F.map_from_entries(entries("guardrail", "key", "total_requests")).alias("by_guardrail"),
    ).select(days_before(as_of, days).alias("period_start"), moment(as_of).alias("period_end"), "*")


def dashboard_summary(registry: DataFrame, audit: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Registered agents, departments, requests of the period and PII rate, one row.

    The two one-row aggregates meet in a union, not in a join.
    """
    check_range("days", days, 1, 90)
    none = F.lit(None).cast("long")
    registered = registry.agg(
        F.count(F.lit(1)).alias("total_agents"), F.count_distinct("department").alias("active_departments")
    ).select("total_agents", "active_departments", none.alias("n"), none.alias("n_pii"))
    traffic = (
        period(audit, as_of, days)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("has_pii").alias("n_pii"))
        .select(none.alias("total_agents"), none.alias("active_departments"), "n", "n_pii")
    )
    one = registered.unionByName(traffic).agg(*[F.max(c).alias(c) for c in registered.columns])
    rate = F.try_divide(F.col("n_pii"), F.col("n")) * F.lit(100.0)
    return one.select(
        "total_agents",
        "active_departments",
        F.col("n").alias("total_requests_period"),
        F.coalesce(F.bround(rate, 2), F.lit(0.0)).alias("pii_incident_rate"),
    )


def dashboard_data(registry: DataFrame, audit: DataFrame, as_of: AsOf = None, days: int = 7) -> dict[str, DataFrame]:
    """Everything the dashboard shows."""
    return {
        "analytics": usage_analytics(audit, as_of, days),
        "leaderboard": U.department_leaderboard(audit, as_of),
        "agents": agents_with_stats(registry, audit),
        "summary": dashboard_summary(registry, audit, as_of, days),
    }
