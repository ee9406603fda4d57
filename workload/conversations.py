"""Conversation queries: W1, M1-M5."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators import conversations as C
from govlens.operators.common import estimated_bytes
from govlens.operators.feedback import feedback_to_session
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import layouts
from workload.registry import ORACLES, query, second, sql_second

MESSAGES = X.duckdb_with("turns", "messages")
ALL = X.duckdb_with("turns", "messages", "session_starts", "sessions")


@query("turn_number", MESSAGES + "SELECT message_id, seq, role, turn_number FROM messages")
def turn_number(spark, sf_dir):
    return C.turn_numbers(X.turns(spark, sf_dir)).select("message_id", "seq", "role", "turn_number")


@query(
    "conversation_stats",
    ALL + "SELECT session_id, status, message_count, total_pii_incidents, total_blocked FROM sessions",
)
def conversation_stats(spark, sf_dir):
    out = C.conversation_stats(X.session_starts(spark, sf_dir), X.turns(spark, sf_dir))
    return out.select("session_id", "status", "message_count", "total_pii_incidents", "total_blocked")


_SHOWN = (
    "concat(turn_number, ':', role, ':', has_pii, ':', was_blocked, ':', coalesce(feedback_rating, '-'), ':', content)"
)


@query(
    "conversation_view",
    ALL
    + f"""SELECT s.session_id, s.user_id, {sql_second("s.started_at")} AS started_at, s.status, s.message_count,
  coalesce(m.messages, '') AS messages FROM sessions s LEFT JOIN
  (SELECT session_id, string_agg({_SHOWN}, ' | ' ORDER BY turn_number, "timestamp", message_id) AS messages
   FROM messages GROUP BY 1) m ON s.session_id = m.session_id""",
)
def conversation_view(spark, sf_dir):
    return shown_view(C.conversation_view(X.conversations(spark, sf_dir), X.messages(spark, sf_dir)))


def shown_view(out):
    shown = F.transform(
        "messages",
        lambda m: F.concat_ws(
            ":",
            m["turn_number"].cast("string"),
            m["role"],
            m["has_pii"].cast("string"),
            m["was_blocked"].cast("string"),
            F.coalesce(m["feedback_rating"], F.lit("-")),
            m["content"],
        ),
    )
    return out.select(
        "session_id",
        "user_id",
        second("started_at").alias("started_at"),
        "status",
        "message_count",
        F.array_join(shown, " | ").alias("messages"),
    )


@query(
    "session_transcript",
    ALL
    + """SELECT s.session_id, coalesce(m.messages, '') AS messages FROM sessions s LEFT JOIN
  (SELECT session_id, string_agg(concat(role, ':', was_blocked, ':', has_pii, ':', content), ' | '
     ORDER BY turn_number, "timestamp", message_id) AS messages FROM messages GROUP BY 1) m
  ON s.session_id = m.session_id""",
)
def session_transcript(spark, sf_dir):
    out = C.session_transcript(X.conversations(spark, sf_dir), X.messages(spark, sf_dir))
    shown = F.transform(
        "messages",
        lambda m: F.concat_ws(
            ":", m["role"], m["blocked"].cast("string"), m["has_pii"].cast("string"), m["content"]
        ),
    )
    return out.select("session_id", F.array_join(shown, " | ").alias("messages"))


def export_sql(feedback_only: bool) -> str:
    where = "WHERE has_feedback" if feedback_only else ""
    return (
        ALL.rstrip()
        + f""", chosen AS (SELECT * FROM sessions WHERE started_at >= TIMESTAMP '{X.AS_OF}' - INTERVAL 30 DAY
  AND message_count >= 2 AND status = 'completed' AND total_pii_incidents = 0
  ORDER BY started_at DESC, session_id LIMIT 1000),
nested AS (SELECT session_id, string_agg(concat(role, ':', coalesce(feedback_rating, '-'), ':', content), ' | '
     ORDER BY turn_number, "timestamp", message_id) AS messages,
   coalesce(bool_or(length(feedback_rating) > 0), false) AS has_feedback FROM messages GROUP BY 1)
SELECT c.session_id, c.agent_id, c.department, coalesce(n.messages, '') AS messages, c.message_count,
  c.total_pii_incidents AS pii_incidents, c.total_blocked AS blocked_count
FROM chosen c LEFT JOIN nested n ON c.session_id = n.session_id {where}"""
    )


def shown_export(out):
    shown = F.transform(
        "messages", lambda m: F.concat_ws(":", m["role"], F.coalesce(m["feedback"], F.lit("-")), m["content"])
    )
    return out.select(
        "session_id",
        "agent_id",
        "department",
        F.array_join(shown, " | ").alias("messages"),
        "stats.message_count",
        "stats.pii_incidents",
        "stats.blocked_count",
    )


@query("training_export", export_sql(False))
def training_export(spark, sf_dir):
    return shown_export(C.training_export(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.AS_OF))


@query("training_export_with_feedback", export_sql(True))
def training_export_with_feedback(spark, sf_dir):
    return shown_export(
        C.training_export(
            X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.AS_OF, only_with_feedback=True
        )
    )


@query(
    "training_export_with_session_feedback",
    X.duckdb_with("turns", "messages", "session_starts", "sessions", "audit_logs", "feedback").rstrip()
    + f""", rated AS (SELECT DISTINCT a.session_id FROM audit_logs a JOIN feedback f ON a.request_id = f.request_id
  UNION SELECT session_id FROM messages WHERE length(feedback_rating) > 0),
chosen AS (SELECT * FROM sessions WHERE started_at >= TIMESTAMP '{X.AS_OF}' - INTERVAL 30 DAY
  AND message_count >= 2 AND status = 'completed' AND total_pii_incidents = 0
  ORDER BY started_at DESC, session_id LIMIT 1000)
SELECT session_id, agent_id, message_count FROM chosen WHERE session_id IN (SELECT session_id FROM rated)""",
)
def training_export_with_session_feedback(spark, sf_dir):
    """Feedback reaches sessions over the audit rows of the rated requests."""
    ratings = feedback_to_session(X.feedback(spark, sf_dir), X.audit_logs(spark, sf_dir))
    out = C.training_export(
        X.conversations(spark, sf_dir),
        X.messages(spark, sf_dir),
        X.AS_OF,
        only_with_feedback=True,
        session_ratings=ratings,
    )
    return out.select("session_id", "agent_id", "stats.message_count")


# End events: a conversation may end after each assistant message; the latest such event counts.
END_STATUS = "CASE WHEN was_blocked THEN 'error' WHEN feedback_rating IS NULL THEN 'abandoned' END"


@query(
    "end_conversations",
    ALL.rstrip()
    + f""", ends AS (SELECT session_id, coalesce({END_STATUS}, 'completed') AS status, "timestamp" AS ended_at,
  row_number() OVER (PARTITION BY session_id ORDER BY "timestamp" DESC) AS r FROM turns WHERE role = 'assistant')
SELECT s.session_id, coalesce(e.status, s.status) AS status, {sql_second("e.ended_at")} AS ended_at
FROM sessions s LEFT JOIN ends e ON s.session_id = e.session_id AND e.r = 1""",
)
def end_conversations(spark, sf_dir):
    ends = (
        X.turns(spark, sf_dir)
        .filter("role = 'assistant'")
        .selectExpr("session_id", f"{END_STATUS} AS status", "timestamp AS ended_at")
    )
    out = C.end_conversations(X.conversations(spark, sf_dir), ends)
    return out.select("session_id", "status", second("ended_at").alias("ended_at"))


def laid_out(spark, sf_dir):
    """Conversations and messages in matching buckets."""
    root = scratch_dir(spark, "sessions")
    prefix = "s" + root.rsplit("-", 1)[1]
    size = estimated_bytes(X.raw(spark, sf_dir, "conversations"))
    buckets = layouts.buckets_for(size, spark.sparkContext.defaultParallelism)
    return layouts.save_sessions(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), prefix, root, buckets)


@query("conversation_view_bucketed", ORACLES["conversation_view"])
def conversation_view_bucketed(spark, sf_dir):
    """The view from tables in buckets of sessions: no message is shuffled."""
    return shown_view(C.conversation_view(*laid_out(spark, sf_dir)))


@query("training_export_bucketed", ORACLES["training_export"])
def training_export_bucketed(spark, sf_dir):
    conversations, messages = laid_out(spark, sf_dir)
    return shown_export(C.training_export(conversations, messages, X.AS_OF))


@query("feedback_to_session_bucketed", X.duckdb_with("audit_logs", "feedback") + f"""SELECT session_id, rating,
  {sql_second("rated_at")} AS rated_at FROM (SELECT a.session_id, f.rating, f."timestamp" AS rated_at,
  row_number() OVER (PARTITION BY a.session_id ORDER BY f."timestamp" DESC, f.feedback_id DESC) AS n
  FROM (SELECT DISTINCT request_id, session_id FROM audit_logs) a JOIN feedback f ON a.request_id = f.request_id)
WHERE n = 1""")
def feedback_to_session_bucketed(spark, sf_dir):
    """Audit rows and feedback in buckets of requests: what is shuffled are the ratings of sessions."""
    root = scratch_dir(spark, "requests")
    audit, feedback = layouts.save_requests(
        X.audit_logs(spark, sf_dir), X.feedback(spark, sf_dir), "r" + root.rsplit("-", 1)[1], root,
        layouts.buckets_for(0, spark.sparkContext.defaultParallelism),
    )
    return feedback_to_session(feedback, audit).withColumn("rated_at", second("rated_at"))
