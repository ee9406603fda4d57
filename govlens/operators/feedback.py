"""User feedback: rows, summaries, suggestions, and the rating of a session."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.functions.columns import json_or_null
from govlens.operators.common import identified, last_days, moment, newest_days, only
from govlens.operators.hygiene import apply_defaults, check_range
from govlens.schemas import FEEDBACK

# Fixed value: the note on an agent without feedback.
NO_FEEDBACK = "No feedback found for this agent"


def feedback_rows(
    submissions: DataFrame, as_of: datetime | str | None = None, batch_id: str = ""
) -> DataFrame:
    """Feedback rows. The id is a hash of all content, the batch and a number among equal rows.

    So no two rows share an id, and a repeated run gives the same ids. ``batch_id`` tells apart equal rows that arrive
    in different batches without a time of their own.
    """
    filled = apply_defaults(submissions, "feedback")
    optional = {
        c: F.lit(None).cast("string") for c in ("user_id", "comment", "suggestion") if c not in filled.columns
    }
    filled = filled.withColumns(optional)
    tags = json_or_null(F.col("tags"))
    when = F.coalesce("timestamp", moment(as_of)) if "timestamp" in filled.columns else moment(as_of)
    filled = filled.withColumns({"tags": tags, "timestamp": when})
    content = ("request_id", "agent_id", "user_id", "rating", "comment", "suggestion", "tags")
    return identified(
        filled, "feedback_id", batch_id, *content, F.unix_micros("timestamp")
    ).select(*FEEDBACK.schema.fieldNames())


def feedback_summary(
    feedback: DataFrame, as_of: datetime | str | None = None, days: int = 30, agent_id: str | None = None
) -> DataFrame:
    """Ratings per agent over the last days; agents without feedback have no row."""
    check_range("days", days, 1, 365)
    count = lambda rating: F.count_if(F.col("rating") == rating).alias(f"{rating}_count")
    return (
        last_days(only(feedback, agent_id=agent_id), as_of, days)
        .groupBy("agent_id")
        .agg(
            F.count(F.lit(1)).alias("total_feedback"),
            count("helpful"),
            count("not_helpful"),
            count("incorrect"),
            count("inappropriate"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        .withColumn("helpful_rate", F.bround(F.col("helpful_count") / F.col("total_feedback") * F.lit(100.0), 2))
    )


def feedback_of_agents(
    registry: DataFrame, feedback: DataFrame, as_of: datetime | str | None = None, days: int = 30
) -> DataFrame:
    """The summary for every registered agent; agents without feedback have zero counts and a message."""
    summary = feedback_summary(feedback, as_of, days)
    counts = [c for c in summary.columns if c not in ("agent_id", "helpful_rate")]
    return (
        registry.select("agent_id")
        .distinct()
        .join(summary, "agent_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("message", F.when(F.col("total_feedback") == 0, F.lit(NO_FEEDBACK)))
    )


def recent_suggestions(
    feedback: DataFrame, agent_id: str | None = None, limit: int = 20, as_of: datetime | str | None = None
) -> DataFrame:
    """The latest feedback with a suggestion; of a table with day partitions only the newest days that hold enough."""
    check_range("limit", limit, 1, 100)
    found = only(feedback, agent_id=agent_id).filter(F.col("suggestion").isNotNull())
    if "event_date" in feedback.columns:
        found = newest_days(found, limit, as_of)
    return (
        found.select("feedback_id", "request_id", "agent_id", "user_id", "rating", "comment", "suggestion", "timestamp")
        .orderBy(F.desc("timestamp"), "feedback_id")
        .limit(limit)
    )


def feedback_to_session(feedback: DataFrame, audit: DataFrame) -> DataFrame:
    """The latest rating of each session, over the requests that the session made.

    Feedback is first reduced to its latest rating per request, so a request with very many ratings joins as one
    row. Audit rows of one request repeat the same session; repeats do not change a maximum, so they are not removed
    by an extra shuffle.
    """
    newest = lambda: F.max(F.struct("timestamp", "feedback_id", "rating"))
    per_request = feedback.groupBy("request_id").agg(newest().alias("latest"))
    return (
        audit.filter(F.col("session_id").isNotNull())
        .select("request_id", "session_id")
        .join(per_request, "request_id")
        .groupBy("session_id")
        .agg(F.max("latest").alias("latest"))
        .select("session_id", F.col("latest.rating").alias("rating"), F.col("latest.timestamp").alias("rated_at"))
    )
