"""Streaming queries: T1-T6. Each runs its stream over the available files and returns what the sink holds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from govlens.plans import screening
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from govlens.streaming import jobs, stateful
from workload.access import AS_OF
from workload.policies import AUDIT_KINDS
from workload.registry import ORACLES, day, query, second, sql_day, sql_second
from workload.texts import injection_cte, pii_cte, sensitive_cte, toxic

AUDIT = X.duckdb_with("audit_logs")


def _finish(query_run) -> None:
    query_run.awaitTermination()


_SCORED = ", ".join(
    [
        X.DUCKDB["prompts"],
        pii_cte("j1", "prompts"),
        sensitive_cte("j2", "j1"),
        injection_cte("j3", "j2"),
        f"""judged AS (SELECT *, CASE WHEN has_pii THEN 'blocked' ELSE 'passed' END AS s_pii_detection,
  CASE WHEN sensitive_types <> '' THEN 'blocked' ELSE 'passed' END AS s_sensitive_request,
  CASE WHEN {toxic("prompt")} THEN 'flagged' ELSE 'passed' END AS s_toxicity,
  CASE WHEN n_types >= 3 THEN 'blocked' WHEN n_types > 0 THEN 'flagged' ELSE 'passed' END AS s_prompt_injection
  FROM j3)""",
    ]
)


SCREENED_SQL = f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT request_id, {sql_day('\"timestamp\"')} AS event_date, '{k}' AS guardrail_type, s_{k} AS status, "
    f"{'has_pii' if k == 'pii_detection' else 'false'} AS has_pii, "
    f"{'redacted_text' if k == 'pii_detection' else 'NULL::VARCHAR'} AS redacted_prompt FROM judged"
    for k in AUDIT_KINDS
)


def _stored_audit(spark, root):
    return tables.read_table(spark, root, "audit_logs").select(
        "request_id", day("event_date").alias("event_date"), "guardrail_type", "status", "has_pii", "redacted_prompt"
    )


@query("screen_to_table", SCREENED_SQL)
def screen_to_table(spark, sf_dir):
    """The batch twin of the screening stream."""
    root = scratch_dir(spark, "screen_to_table")
    screening.screen_to_table(screening.ask_for(X.prompts(spark, sf_dir), screening.ALL_GUARDRAILS), root)
    return _stored_audit(spark, root)


@query("stream_guardrails", SCREENED_SQL)
def stream_guardrails(spark, sf_dir):
    root = scratch_dir(spark, "stream_guardrails")
    arriving = screening.ask_for(X.stream(spark, sf_dir, "documents", X.PROMPTS), screening.ALL_GUARDRAILS)
    _finish(jobs.run_screening(arriving, root, f"{root}/checkpoint"))
    return _stored_audit(spark, root)


@query(
    "stream_daily_counts",
    AUDIT
    + f"""SELECT {sql_day("d")} AS date, count(*) AS total_requests,
  count(*) FILTER (status = 'blocked') AS blocked_requests, count(*) FILTER (status = 'passed') AS passed_requests,
  count(*) FILTER (has_pii) AS pii_incidents
FROM (SELECT *, date_trunc('day', "timestamp") AS d FROM audit_logs)
WHERE d + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM audit_logs) - INTERVAL 1 DAY GROUP BY 1""",
)
def stream_daily_counts(spark, sf_dir):
    """The closed days."""
    root = scratch_dir(spark, "stream_daily_counts")
    counts = jobs.daily_counts(X.stream(spark, sf_dir, "events", X.AUDIT_LOGS)).drop("approx_users")
    _finish(jobs.run_append(counts, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(counts.schema).parquet(f"{root}/out").withColumn("date", day("date"))


@query(
    "stream_daily_counts_current",
    AUDIT
    + f"""SELECT {sql_day('"timestamp"')} AS date, count(*) AS total_requests,
  count(*) FILTER (status = 'blocked') AS blocked_requests, count(*) FILTER (status = 'passed') AS passed_requests,
  count(*) FILTER (has_pii) AS pii_incidents FROM audit_logs GROUP BY 1""",
)
def stream_daily_counts_current(spark, sf_dir):
    """All days, the open ones with what has arrived."""
    root = scratch_dir(spark, "stream_daily_counts_current")
    counts = jobs.daily_counts(X.stream(spark, sf_dir, "events", X.AUDIT_LOGS))
    _finish(jobs.run_update(counts, f"{root}/out", f"{root}/checkpoint"))
    values = ["total_requests", "blocked_requests", "passed_requests", "pii_incidents"]
    return jobs.current(spark.read.parquet(f"{root}/out"), "date", values).withColumn("date", day("date"))


@query(
    "stream_conversation_stats",
    X.duckdb_with("turns")
    + """SELECT session_id, count(*) AS message_count, count(*) FILTER (has_pii) AS total_pii_incidents,
  count(*) FILTER (was_blocked) AS total_blocked FROM turns GROUP BY 1""",
)
def stream_conversation_stats(spark, sf_dir):
    root = scratch_dir(spark, "stream_conversation_stats")
    arriving = X.derive(X.stream(spark, sf_dir, "conversations").filter("role <> 'system'"), X.MESSAGES)
    _finish(jobs.run_update(jobs.session_counters(arriving), f"{root}/out", f"{root}/checkpoint"))
    return jobs.current(
        spark.read.parquet(f"{root}/out"), "session_id", ["message_count", "total_pii_incidents", "total_blocked"]
    )


@query("stream_dedup", AUDIT + "SELECT DISTINCT request_id, guardrail_type, status FROM audit_logs")
def stream_dedup(spark, sf_dir):
    """Every audit row arrives twice and is kept once."""
    root = scratch_dir(spark, "stream_dedup")
    twice = X.stream(spark, sf_dir, "events", X.AUDIT_LOGS).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = jobs.deduplicated(twice).select("request_id", "guardrail_type", "status")
    _finish(jobs.run_append(rows, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@query(
    "stream_sessions",
    AUDIT.rstrip()
    + f""", marked AS (SELECT user_id, "timestamp" AS t, CASE WHEN lag("timestamp") OVER w IS NULL
    OR "timestamp" > lag("timestamp") OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts
  FROM audit_logs WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp")),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t) AS n FROM marked)
SELECT user_id, {sql_second("min(t)")} AS started_at, {sql_second("max(t) + INTERVAL 30 MINUTE")} AS ends_at,
  count(*) AS n_events FROM numbered GROUP BY user_id, n
HAVING max(t) + INTERVAL 30 MINUTE <= (SELECT max("timestamp") FROM audit_logs) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark, sf_dir):
    """The sessions that ended by inactivity."""
    root = scratch_dir(spark, "stream_sessions")
    sessions = jobs.activity_sessions(X.stream(spark, sf_dir, "events", X.AUDIT_LOGS))
    _finish(jobs.run_append(sessions, f"{root}/out", f"{root}/checkpoint"))
    return (
        spark.read.schema(sessions.schema)
        .parquet(f"{root}/out")
        .withColumns({c: second(c) for c in ("started_at", "ends_at")})
    )


@query(
    "stream_abandoned",
    X.duckdb_with("turns")
    + f"""SELECT session_id, 'abandoned' AS status, {sql_second("t + INTERVAL 30 MINUTE")} AS ended_at
FROM (SELECT session_id, max("timestamp") AS t FROM turns GROUP BY 1)
WHERE t + INTERVAL 30 MINUTE <= (SELECT max("timestamp") FROM turns) - INTERVAL 1 HOUR""",
)
def stream_abandoned(spark, sf_dir):
    """Conversations that fell silent; messages of one conversation are a minute apart here."""
    root = scratch_dir(spark, "stream_abandoned")
    arriving = X.derive(X.stream(spark, sf_dir, "conversations").filter("role <> 'system'"), X.MESSAGES)
    ends = jobs.abandonments(arriving)
    _finish(jobs.run_append(ends, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(ends.schema).parquet(f"{root}/out").withColumn("ended_at", second("ended_at"))


@query(
    "stream_key_usage",
    X.duckdb_with("created_keys", "access_log")
    + f"""SELECT k.key_id, {sql_second("max(a.ts)")} AS last_used_at FROM access_log a
JOIN created_keys k ON a.presented_key = k.plain_key WHERE k.is_active AND k.expires_at >= a.ts GROUP BY 1""",
)
def stream_key_usage(spark, sf_dir):
    root = scratch_dir(spark, "stream_key_usage")
    usage = jobs.key_usage(X.stream(spark, sf_dir, "events", X.ACCESS), X.api_keys(spark, sf_dir))
    _finish(jobs.run_update(usage, f"{root}/out", f"{root}/checkpoint"))
    latest = jobs.current(spark.read.parquet(f"{root}/out"), "key_id", ["last_used_at"])
    return latest.withColumn("last_used_at", second("last_used_at"))


@query(
    "stream_abandoned_timers",
    X.duckdb_with("turns")
    + f"""SELECT session_id, 'abandoned' AS status, count(*) AS n_messages,
  {sql_second("max(\"timestamp\") + INTERVAL 2 SECOND")} AS ended_at FROM turns GROUP BY 1""",
)
def stream_abandoned_timers(spark, sf_dir):
    """Conversations that get no message for two seconds on the clock: all of them, also the last ones."""
    root = scratch_dir(spark, "stream_abandoned_timers")
    arriving = X.derive(X.stream(spark, sf_dir, "conversations").filter("role <> 'system'"), X.MESSAGES)
    ends = stateful.silent_sessions(arriving, timedelta(seconds=2))
    stateful.run_while_open(ends, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(ends.schema).parquet(f"{root}/out").withColumn("ended_at", second("ended_at"))


@query(
    "stream_turn_numbers",
    X.duckdb_with("turns", "messages")
    + """SELECT session_id, message_id, role, CAST(seq AS BIGINT) AS seq, turn_number FROM messages
WHERE "timestamp" <= (SELECT max("timestamp") FROM turns) - INTERVAL 1 HOUR""",
)
def stream_turn_numbers(spark, sf_dir):
    """The messages that the watermark has passed."""
    root = scratch_dir(spark, "stream_turn_numbers")
    arriving = X.derive(X.stream(spark, sf_dir, "conversations").filter("role <> 'system'"), X.MESSAGES)
    turns = stateful.streamed_turn_numbers(arriving)
    _finish(jobs.run_append(turns, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(turns.schema).parquet(f"{root}/out")


@query(
    "stream_access_as_of",
    AS_OF
    + """SELECT CAST(event_id AS VARCHAR) AS event_id, status, CASE WHEN status = 'valid' THEN key_id END AS key_id,
  CASE WHEN status = 'valid' THEN agent_id END AS agent_id FROM judged
WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM access_log) - 3600000""",
)
def stream_access_as_of(spark, sf_dir):
    """Accesses and changes of keys as two streams; the accesses that the watermark has passed."""
    root = scratch_dir(spark, "stream_access_as_of")
    made = X.stream(spark, sf_dir, "customer", X.API_KEYS).withColumn("key_hash", F.sha2("plain_key", 256))
    switches = X.derive(X.stream(spark, sf_dir, "events").filter(X.SWITCHED), X.SWITCHES)
    # The fixture's keys are known when they are switched, so a switch carries what its key is.
    keys = X.api_keys(spark, sf_dir).select("key_id", "key_hash", "agent_id", "expires_at", "created_at")
    switched = X.switched_keys(spark, sf_dir)
    changes = made.select(
        "key_hash", "key_id", "agent_id", F.col("created_at").alias("valid_from"), "expires_at", "is_active"
    ).join(switched, "key_id", "left").withColumn("is_active", F.col("is_active") | F.col("switched").isNotNull()).drop("switched")
    later = switches.join(keys, "key_id").filter("`at` >= created_at").select(
        "key_hash", "key_id", "agent_id", F.col("at").alias("valid_from"), "expires_at", "is_active"
    )
    judged = stateful.streamed_access(X.stream(spark, sf_dir, "events", X.ACCESS), changes.select(*later.columns).unionByName(later))
    _finish(jobs.run_append(judged, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(judged.schema).parquet(f"{root}/out").drop("ts")


@query("stream_daily_counts_compacted", ORACLES["stream_daily_counts_current"])
def stream_daily_counts_compacted(spark, sf_dir):
    """The current counts, after the batches of changes were merged into one."""
    root = scratch_dir(spark, "stream_daily_counts_compacted")
    counts = jobs.daily_counts(X.stream(spark, sf_dir, "events", X.AUDIT_LOGS))
    _finish(jobs.run_update(counts, f"{root}/out", f"{root}/checkpoint"))
    jobs.compact_changes(spark, f"{root}/out", "date")
    values = ["total_requests", "blocked_requests", "passed_requests", "pii_incidents"]
    return jobs.current(spark.read.parquet(f"{root}/out"), "date", values).withColumn("date", day("date"))


@query("stream_conversation_stats_expiring", ORACLES["stream_conversation_stats"])
def stream_conversation_stats_expiring(spark, sf_dir):
    """The counters of sessions whose state leaves after two idle days."""
    root = scratch_dir(spark, "stream_conversation_stats_expiring")
    arriving = X.derive(X.stream(spark, sf_dir, "conversations").filter("role <> 'system'"), X.MESSAGES)
    stateful.run_update_while_fed(stateful.expiring_counters(arriving), f"{root}/out", f"{root}/checkpoint")
    return jobs.current(
        spark.read.parquet(f"{root}/out"), "session_id", ["message_count", "total_pii_incidents", "total_blocked"]
    )
