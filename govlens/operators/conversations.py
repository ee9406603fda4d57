"""Conversations: message rows, turn numbers, counters, nested views and the training export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens import schemas as S
from govlens.functions.columns import json_or_null
from govlens.operators.common import identified, join_dimension, last_days, moment, only, running_total, stored
from govlens.operators.hygiene import apply_defaults, check_range

# Messages per nested row. A longer session comes in several rows, numbered by ``part``.
PART_SIZE = 1_000
# Sequence numbers per range when turn numbers are counted.
TURN_RANGE = 1_024
EXPORT_LIMIT = 1_000


def _missing(df: DataFrame, **kinds: str) -> dict[str, Column]:
    return {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in df.columns}


def message_rows(messages: DataFrame, as_of: datetime | str | None = None, batch_id: str = "") -> DataFrame:
    """Message rows. The id is a hash of session, turn, role, time, content, the batch and a number among equal rows;
    no rating is known yet."""
    filled = messages.withColumns(
        _missing(
            messages, guardrail_result="string", processing_time_ms="double", has_pii="boolean", was_blocked="boolean"
        )
    )
    when = F.coalesce("timestamp", moment(as_of)) if "timestamp" in messages.columns else moment(as_of)
    filled = filled.withColumn("timestamp", when)
    identity = ["session_id", "turn_number", "role", F.unix_micros("timestamp"), "content"]
    return identified(filled, "message_id", batch_id, *identity).withColumns(
        {
            "has_pii": F.coalesce("has_pii", F.lit(False)),
            "was_blocked": F.coalesce("was_blocked", F.lit(False)),
            "feedback_rating": F.lit(None).cast("string"),
        }
    ).select(*S.MESSAGES.schema.fieldNames())


def conversation_rows(starts: DataFrame, as_of: datetime | str | None = None, batch_id: str = "") -> DataFrame:
    """Session-start rows: counters 0, status active.

    A missing session id is a hash of all that the start says, the batch and a number among equal starts: two starts
    never become one session. ``metadata`` is a map and becomes a JSON string.
    """
    filled = starts.withColumns(
        _missing(starts, session_id="string", user_id="string", department="string", metadata="map<string,string>")
    )
    when = F.coalesce("started_at", moment(as_of)) if "started_at" in starts.columns else moment(as_of)
    filled = filled.withColumn("started_at", when)
    said = ["session_id", "agent_id", "user_id", "department", F.unix_micros("started_at"), F.to_json("metadata")]
    return identified(filled, "_generated", batch_id, *said).withColumns(
        {
            "session_id": F.coalesce(F.nullif("session_id", F.lit("")), "_generated"),
            "ended_at": F.lit(None).cast("timestamp"),
            "message_count": F.lit(0).cast("long"),
            "total_pii_incidents": F.lit(0).cast("long"),
            "total_blocked": F.lit(0).cast("long"),
            "status": F.lit("active"),
            "metadata": json_or_null(F.col("metadata")),
        }
    ).select(*S.CONVERSATIONS.schema.fieldNames())


def turn_numbers(messages: DataFrame, order: str = "seq", per_range: int = TURN_RANGE) -> DataFrame:
    """Add ``turn_number``: it rises with each user message, and replies carry the number of the message before.

    ``order`` is the integer position of a message in its session. The count runs over ranges of positions, so a
    session with a third of all messages is spread over many tasks.
    """
    return running_total(
        messages,
        ["session_id"],
        {"_range": F.floor(F.col(order) / F.lit(per_range))},
        [order],
        (F.col("role") == "user").cast("long"),
        "turn_number",
    )


def session_counters(messages: DataFrame) -> DataFrame:
    """Messages, PII incidents and blocked messages per session."""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if("has_pii").alias("total_pii_incidents"),
        F.count_if("was_blocked").alias("total_blocked"),
    )


def conversation_stats(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their counters brought up to date; 0 for sessions without messages."""
    counters = ["message_count", "total_pii_incidents", "total_blocked"]
    return (
        conversations.drop(*counters)
        .join(session_counters(messages), "session_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    )


def end_conversations(
    conversations: DataFrame, ends: DataFrame, as_of: datetime | str | None = None
) -> DataFrame:
    """Set ended_at and status of ended sessions; the latest end event (session_id, status, ended_at) counts.

    An event without a time happens at ``as_of``.
    """
    when = F.coalesce("ended_at", moment(as_of)) if "ended_at" in ends.columns else moment(as_of)
    latest = (
        apply_defaults(ends, "end")
        .withColumn("ended_at", when)
        .groupBy("session_id")
        .agg(F.max(F.struct("ended_at", "status")).alias("_end"))
    )
    return (
        conversations.join(latest, "session_id", "left")
        .withColumns(
            {
                "ended_at": F.coalesce("_end.ended_at", "ended_at"),
                "status": F.coalesce("_end.status", "status"),
            }
        )
        .drop("_end")
    )


def nest_messages(
    sessions: DataFrame, messages: DataFrame, fields: dict[str, str], part_size: int = PART_SIZE
) -> DataFrame:
    """LEFT JOIN sessions with their messages as an ordered array; ``fields`` maps output to input names.

    Sessions with up to ``part_size`` messages give one row, part 0. Longer ones give one row per ``part_size``
    messages, so no array and no task grows with a session.

    A count over the session column alone finds the long sessions first; that list is stored, and small unless most
    sessions are long. Usually it is empty and the messages are shuffled once, by session. Otherwise the messages of
    long sessions are kept out of that shuffle: their positions come from ``running_total`` over (turn, minute)
    ranges, and they are gathered by (session, part).
    """
    order = ["turn_number", "timestamp", "message_id"]
    columns = list(dict.fromkeys(["session_id", *order, *fields.values()]))
    rows = messages.select(*columns)
    entry = F.struct(*order, F.struct(*[F.col(src).alias(dst) for dst, src in fields.items()]).alias("_entry"))
    empty = F.array().cast(f"array<{_entry_type(messages, fields)}>")

    def gather(df: DataFrame, keys: list[str]) -> DataFrame:
        ordered = F.sort_array(F.collect_list(entry))
        return df.groupBy(*keys).agg(F.transform(ordered, lambda row: row["_entry"]).alias("messages"))

    def attach(to: DataFrame, short_rows: DataFrame) -> DataFrame:
        nested = to.join(gather(short_rows, ["session_id"]), "session_id", "left")
        return nested.withColumns({"part": F.lit(0).cast("long"), "messages": F.coalesce("messages", empty)})

    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    long_ones = stored(counts.filter(F.col("_n") > part_size).select("session_id"), "long_sessions")
    if long_ones.isEmpty():
        return attach(sessions, rows)

    by_message = ["session_id", *order]
    short = attach(
        sessions.join(long_ones, "session_id", "left_anti"),
        join_dimension(rows, long_ones, "session_id", by_message, "left_anti"),
    )
    placed = running_total(
        join_dimension(rows, long_ones, "session_id", by_message, "left_semi"),
        ["session_id"],
        {
            "_turn": F.coalesce("turn_number", F.lit(-1)),
            "_minute": F.coalesce(F.unix_seconds(F.date_trunc("minute", "timestamp")), F.lit(-(2**62))),
        },
        order,
        F.lit(1),
        "_position",
    )
    parts = gather(
        placed.withColumn("part", F.floor((F.col("_position") - 1) / F.lit(part_size))), ["session_id", "part"]
    )
    their_sessions = sessions.join(long_ones, "session_id", "left_semi")
    long_rows = join_dimension(parts, their_sessions, "session_id", ["session_id", "part"], "inner")
    return short.unionByName(long_rows)


def _entry_type(messages: DataFrame, fields: dict[str, str]) -> str:
    kinds = dict(messages.dtypes)
    return "struct<" + ",".join(f"{dst}:{kinds[src]}" for dst, src in fields.items()) + ">"


VIEW_FIELDS = {
    name: name
    for name in (
        "message_id", "turn_number", "role", "content", "timestamp", "has_pii", "was_blocked", "feedback_rating",
    )
}
VIEW_COLUMNS = [
    "session_id", "agent_id", "user_id", "department", "started_at", "ended_at",
    "message_count", "total_pii_incidents", "total_blocked", "status",
]
TRANSCRIPT_FIELDS = {"role": "role", "content": "content", "blocked": "was_blocked", "has_pii": "has_pii"}
EXPORT_FIELDS = {"role": "role", "content": "content", "feedback": "feedback_rating"}


def conversation_view(
    conversations: DataFrame, messages: DataFrame, session_id: str | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """Conversations with their messages in order of turn and time."""
    sessions = only(conversations, session_id=session_id).select(*VIEW_COLUMNS)
    return nest_messages(sessions, only(messages, session_id=session_id), VIEW_FIELDS, part_size)


def session_transcript(
    conversations: DataFrame, messages: DataFrame, session_id: str | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """Role, content, blocked and has_pii of each session's messages in order."""
    sessions = only(conversations, session_id=session_id).select("session_id")
    return nest_messages(sessions, only(messages, session_id=session_id), TRANSCRIPT_FIELDS, part_size)


def training_export(
    conversations: DataFrame,
    messages: DataFrame,
    as_of: datetime | str | None = None,
    agent_id: str | None = None,
    days: int = 30,
    include_pii: bool = False,
    only_with_feedback: bool = False,
    min_messages: int = 2,
    limit: int | None = EXPORT_LIMIT,
    part_size: int = PART_SIZE,
    session_ratings: DataFrame | None = None,
) -> DataFrame:
    """The latest completed conversations as training examples.

    At most ``limit`` sessions are chosen, all that qualify with None. The list is stored, so that every later step sees
    the same choice. A limited list is broadcast to the messages: the message table is filtered where it is read and
    only the chosen sessions' rows are shuffled. Without a limit Spark decides by the list's size.

    ``only_with_feedback`` applies after the limit. A session has feedback when one of its messages has a rating, or
    when ``session_ratings`` (session_id, rating; see ``feedback_to_session``) lists it.
    """
    check_range("days", days, 1, 365)
    check_range("min_messages", min_messages, 1, 1000)
    if limit is not None:
        check_range("limit", limit, 1, 100_000)
    qualifying = only(last_days(conversations, as_of, days, "started_at"), agent_id=agent_id).filter(
        (F.col("message_count") >= min_messages) & (F.col("status") == "completed")
    )
    if not include_pii:
        qualifying = qualifying.filter(F.col("total_pii_incidents") == 0)
    stats = F.struct(
        "message_count",
        F.col("total_pii_incidents").alias("pii_incidents"),
        F.col("total_blocked").alias("blocked_count"),
    )
    chosen = qualifying if limit is None else qualifying.orderBy(F.desc("started_at"), "session_id").limit(limit)
    sessions = stored(chosen.select("session_id", "agent_id", "department", stats.alias("stats")), "export_sessions")

    def of_sessions(rows: DataFrame) -> DataFrame:
        wanted = sessions.select("session_id").distinct()
        return rows.join(wanted if limit is None else F.broadcast(wanted), "session_id", "left_semi")

    if only_with_feedback:
        rated = of_sessions(messages).filter(F.length("feedback_rating") > 0).select("session_id")
        if session_ratings is not None:
            listed = of_sessions(session_ratings).filter(F.length("rating") > 0).select("session_id")
            rated = rated.unionByName(listed)
        sessions = stored(sessions.join(rated.distinct(), "session_id", "left_semi"), "rated_sessions")
    return nest_messages(sessions, of_sessions(messages), EXPORT_FIELDS, part_size).select(
        "session_id", "agent_id", "department", "part", "messages", "stats"
    )
