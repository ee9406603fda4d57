"""Agent registry: registration, newest version, inventory, statistics per registered agent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.functions.columns import json_or_null, json_strings
from govlens.operators.common import first_per_key, moment, only
from govlens.operators.hygiene import apply_defaults
from govlens.schemas import AGENTS


def register_agents(registrations: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Registry rows for new agents: both times are ``as_of``, active, tags as JSON."""
    now = moment(as_of)
    filled = apply_defaults(registrations, "agent")
    optional = {c: F.lit(None).cast("string") for c in ("team", "description") if c not in filled.columns}
    return filled.withColumns(
        {
            **optional,
            "tags": json_or_null(F.col("tags")),
            "created_at": now,
            "updated_at": now,
            "is_active": F.lit(True),
        }
    ).select(*AGENTS.schema.fieldNames())


def latest_agents(registry: DataFrame) -> DataFrame:
    """The newest row per agent. The registry is append-only; run this first to keep joins from fanning out."""
    return first_per_key(registry, "agent_id", F.desc("updated_at"), F.desc("created_at"), F.asc("agent_name"))


def agent_registry(registry: DataFrame) -> DataFrame:
    """The registry as shown, by department and name."""
    return registry.select(
        "agent_id", "agent_name", "department", "team", "owner_email", "environment", "created_at", "is_active"
    ).orderBy("department", "agent_name")


def agents_with_stats(
    registry: DataFrame, audit: DataFrame, department: str | None = None, agent_id: str | None = None
) -> DataFrame:
    """Registered agents with their request and PII counts (0 without traffic).

    The audit side is aggregated to one row per agent before the join; with ``agent_id`` both sides are filtered.
    """
    stats = (
        only(audit, agent_id=agent_id)
        .groupBy("agent_id")
        .agg(F.count(F.lit(1)).alias("total_requests"), F.count_if("has_pii").alias("pii_incidents"))
    )
    return (
        only(registry, department=department, agent_id=agent_id)
        .join(stats, "agent_id", "left")
        .withColumns(
            {
                "tags": json_strings(F.col("tags")),
                "total_requests": F.coalesce("total_requests", F.lit(0)),
                "pii_incidents": F.coalesce("pii_incidents", F.lit(0)),
            }
        )
        .orderBy("department", "agent_name")
    )


def agent_performance(registry: DataFrame, audit: DataFrame) -> DataFrame:
    """Requests, incidents, users, average time and blocked requests of every registered agent."""
    stats = audit.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("has_pii").alias("pii_incidents"),
        F.count_distinct("user_id").alias("unique_users"),
        F.avg("processing_time_ms").alias("avg_response_time_ms"),
        F.count_if(F.col("status") == "blocked").alias("blocked_requests"),
    )
    counts = ["total_requests", "pii_incidents", "unique_users", "blocked_requests"]
    return (
        registry.select("agent_id", "agent_name", "department")
        .join(stats, "agent_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("avg_response_time_ms", F.coalesce("avg_response_time_ms", F.lit(0.0)))
        .orderBy("department", "agent_name")
    )
