"""Record and table queries: S1-S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions import columns as C
from govlens.operators import conversations as M
from govlens.operators import feedback as FB
from govlens.operators import hygiene as H
from govlens.operators import registry as R
from govlens.plans import replay, screening
from govlens.plans.screening import screen
from govlens.plans.training import export_training_data
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from workload.conversations import export_sql, shown_export
from workload.registry import day, joined, query, second, sql_day, sql_second


@query(
    "read_tables",
    X.duckdb_with("audit_logs")
    + f"""SELECT {sql_day('"timestamp"')} AS event_date, guardrail_type, count(*) AS n, count(user_id) AS with_user,
  CAST(sum(prompt_length) AS BIGINT) AS prompt_chars FROM audit_logs
WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-21 00:00:00'
GROUP BY 1, 2""",
)
def read_tables(spark, sf_dir):
    """Write the audit table by day, read it back with its fixed schema, and prune to some days."""
    root = scratch_dir(spark, "read_tables")
    tables.append(X.audit_logs(spark, sf_dir), root, "audit_logs")
    stored = tables.read_table(spark, root, "audit_logs").filter(
        F.col("event_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    )
    return stored.groupBy(day("event_date").alias("event_date"), "guardrail_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("user_id").alias("with_user"),
        F.sum("prompt_length").alias("prompt_chars"),
    )


@query(
    "append_audit",
    X.duckdb_with("audit_logs")
    + f"""SELECT {sql_day('"timestamp"')} AS event_date, 2 * count(*) AS n,
  CAST(2 * sum(CAST(has_pii AS INTEGER)) AS BIGINT) AS n_pii FROM audit_logs GROUP BY 1""",
)
def append_audit(spark, sf_dir):
    """Two batches add up; a repeated batch replaces its rows, also those of days that it no longer has."""
    root = scratch_dir(spark, "append_audit")
    rows = X.audit_logs(spark, sf_dir)
    tables.append(rows.withColumn("timestamp", F.expr("timestamp + INTERVAL 9 DAYS")), root, "audit_logs", "load-1")
    tables.append(rows, root, "audit_logs", "load-2", rebalance=False)
    tables.append(rows, root, "audit_logs", "load-1", rebalance=False)
    return (
        tables.read_table(spark, root, "audit_logs")
        .groupBy(day("event_date").alias("event_date"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("has_pii").alias("n_pii"))
    )


@query(
    "compact_audit",
    X.duckdb_with("audit_logs")
    + f"""SELECT {sql_day('"timestamp"')} AS event_date, 2 * count(*) AS n, CAST(2 * sum(prompt_length) AS BIGINT)
  AS prompt_chars, CASE WHEN "timestamp" < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END::BIGINT AS n_batches
FROM audit_logs GROUP BY 1, 4""",
)
def compact_audit(spark, sf_dir):
    """Two batches a day; the days before the 16th are merged, and no row is lost."""
    root = scratch_dir(spark, "compact_audit")
    rows = X.audit_logs(spark, sf_dir)
    for batch in ("load-1", "load-2"):
        tables.append(rows, root, "audit_logs", batch)
    tables.compact(spark, root, "audit_logs", "2024-01-16")
    stored = tables.read_table(spark, root, "audit_logs")
    return stored.groupBy(day("event_date").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("prompt_length").alias("prompt_chars"),
        F.count_distinct("batch_id").alias("n_batches"),
    )


RAW_REQUEST = {
    "request_id": "concat('req-', event_id)",
    "agent_id": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('agent-', event_id % 12) END",
    "asked": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'toxicity' ELSE 'pii_detection,toxicity' END",
}


@query(
    "apply_defaults",
    "WITH "
    + X.cte("raw", RAW_REQUEST, "events")
    + """SELECT request_id, coalesce(agent_id, 'default') AS agent_id, coalesce(asked, 'pii_detection') AS guardrails
FROM raw""",
)
def apply_defaults(spark, sf_dir):
    incoming = X.derive(X.raw(spark, sf_dir, "events"), RAW_REQUEST)
    incoming = incoming.withColumn("guardrails", F.split("asked", ",")).drop("asked")
    return H.apply_defaults(incoming, "request").withColumn("guardrails", joined("guardrails"))


# Audit rows with missing and invalid values.
DIRTY = dict(X.AUDIT_LOGS) | {
    "agent_id": "CASE WHEN event_id % 10 = 1 THEN NULL ELSE concat('agent-', event_id % 12) END",
    "status": (
        "CASE WHEN event_id % 15 = 2 THEN NULL WHEN event_id % 15 = 3 THEN 'unsure' "
        f"ELSE {X.AUDIT_LOGS['status']} END"
    ),
}
DIRTY_SQL = "WITH " + X.cte("dirty", DIRTY, "events") + """, checked AS (SELECT *, concat_ws(',',
  CASE WHEN agent_id IS NULL THEN 'missing:agent_id' END, CASE WHEN status IS NULL THEN 'missing:status' END,
  CASE WHEN status = 'unsure' THEN 'invalid:status' END) AS violations FROM dirty) """


@query(
    "required_quarantine",
    DIRTY_SQL
    + f"""SELECT request_id, {sql_second('"timestamp"')} AS at, agent_id, guardrail_type AS guardrail, status, has_pii,
  processing_time_ms, violations FROM checked WHERE violations <> ''""",
)
def required_quarantine(spark, sf_dir):
    _, rejected = H.split_valid(X.derive(X.raw(spark, sf_dir, "events"), DIRTY), "audit_logs")
    letters = H.dead_letters(rejected).withColumn("violations", joined("violations"))
    return letters.withColumn("at", second("timestamp")).drop("timestamp")


@query(
    "append_with_dead_letters",
    DIRTY_SQL
    + """SELECT 'stored' AS sink, count(*) AS n, count(DISTINCT request_id) AS n_requests FROM checked
WHERE violations = '' UNION ALL SELECT 'dead_letters', count(*), count(DISTINCT request_id) FROM checked
WHERE violations <> ''""",
)
def append_with_dead_letters(spark, sf_dir):
    """Every row ends up in one of the two sinks."""
    root = scratch_dir(spark, "dead_letters")
    rows = X.derive(X.raw(spark, sf_dir, "events"), DIRTY)
    tables.append_audit(rows.withColumn("agent_id", F.lit(None).cast("string")), root, "load-1")
    tables.append_audit(rows, root, "load-1")  # repeated after a repair: the first run's dead letters go
    stored = tables.read_table(spark, root, "audit_logs").select(F.lit("stored").alias("sink"), "request_id")
    letters = spark.read.parquet(tables.dead_letter_path(root, "audit_logs")).select(F.lit("dead_letters").alias("sink"), "request_id")
    return (
        stored.unionByName(letters)
        .groupBy("sink")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("n_requests"))
    )


@query(
    "accepted_rows",
    DIRTY_SQL
    + """SELECT guardrail_type, status, count(*) AS n, count(DISTINCT request_id) AS n_requests FROM checked
WHERE violations = '' GROUP BY 1, 2""",
)
def accepted_rows(spark, sf_dir):
    accepted, _ = H.split_valid(X.derive(X.raw(spark, sf_dir, "events"), DIRTY), "audit_logs")
    return accepted.groupBy("guardrail_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("n_requests")
    )


@query(
    "constraint_check",
    """SELECT concat('msg-', conv_id, '-', turn) AS message_id, concat_ws(',',
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'invalid:role' END,
  CASE WHEN turn NOT BETWEEN 1 AND 10000 THEN 'invalid:turn_number' END) AS violations FROM conversations""",
)
def constraint_check(spark, sf_dir):
    """Messages with a role other than user and assistant, or a position outside the valid range."""
    columns = {"message_id": X.MESSAGES["message_id"], "role": "role", "turn_number": "turn"}
    rows = X.derive(X.raw(spark, sf_dir, "conversations"), columns)
    return H.check(rows, "conversation_messages").select("message_id", joined("violations").alias("violations"))


@query(
    "json_columns",
    X.duckdb_with("agents")
    + """SELECT agent_id, coalesce(replace(replace(replace(tags, '["', ''), '"]', ''), '","', ','), '') AS decoded,
  tags AS encoded FROM agents""",
)
def json_columns(spark, sf_dir):
    decoded = X.agents(spark, sf_dir).withColumn("decoded", C.json_strings(F.col("tags")))
    return decoded.select(
        "agent_id", joined("decoded").alias("decoded"), C.json_or_null(F.col("decoded")).alias("encoded")
    )


@query(
    "register_agents",
    X.duckdb_with("agents")
    + """SELECT agent_id, agent_name, CASE WHEN environment = 'staging' THEN 'development' ELSE environment END
  AS environment, tags, '2024-01-31 00:00:00' AS created_at, '2024-01-31 00:00:00' AS updated_at, true AS is_active
FROM agents""",
)
def register_agents(spark, sf_dir):
    incoming = X.agents(spark, sf_dir).select(
        "agent_id",
        "agent_name",
        "department",
        "team",
        "owner_email",
        F.when(F.col("environment") != "staging", F.col("environment")).alias("environment"),
        F.from_json("tags", "array<string>").alias("tags"),
    )
    return R.register_agents(incoming, X.AS_OF).select(
        "agent_id",
        "agent_name",
        "environment",
        "tags",
        second("created_at").alias("created_at"),
        second("updated_at").alias("updated_at"),
        "is_active",
    )


# Each tenth submission arrives twice.
TWICE = "request_id LIKE '%7'"
TWICE_SQL = f"twice AS (SELECT * FROM feedback UNION ALL SELECT * FROM feedback WHERE {TWICE})"


@query(
    "feedback_rows",
    X.duckdb_with("feedback").rstrip()
    + f""", {TWICE_SQL}, same AS (SELECT * REPLACE (CASE WHEN length(feedback_id) % 2 = 0 THEN "timestamp"
  ELSE TIMESTAMP '{X.AS_OF}' END AS "timestamp") FROM twice),
hashed AS (SELECT *, sha256(concat_ws(':', 'load-1', request_id, agent_id, coalesce(user_id, ''), rating,
  coalesce(comment, ''), coalesce(suggestion, ''), coalesce(tags, ''), epoch_us("timestamp"))) AS h FROM same)
SELECT sha256(concat_ws(':', h, row_number() OVER (PARTITION BY h))) AS feedback_id, request_id, agent_id, user_id,
  rating, comment, suggestion, tags, {sql_second('"timestamp"')} AS at FROM hashed""",
)
def feedback_rows(spark, sf_dir):
    """Some submissions are equal, some have no time; every row has an id of its own."""
    given = X.feedback(spark, sf_dir)
    incoming = given.unionByName(given.filter(TWICE)).withColumn(
        "timestamp", F.when(F.length("feedback_id") % 2 == 0, F.col("timestamp"))
    )
    incoming = incoming.drop("feedback_id").withColumn("tags", F.from_json("tags", "array<string>"))
    return FB.feedback_rows(incoming, X.AS_OF, "load-1").withColumn("at", second("timestamp")).drop("timestamp")


@query(
    "message_rows",
    X.duckdb_with("turns", "messages").rstrip()
    + """, twice AS (SELECT * FROM messages UNION ALL SELECT * FROM messages WHERE seq = 1),
hashed AS (SELECT *, sha256(concat_ws(':', '', session_id, turn_number, role, epoch_us("timestamp"), content)) AS h
  FROM twice)
SELECT sha256(concat_ws(':', h, row_number() OVER (PARTITION BY h))) AS message_id,
  session_id, turn_number, role, content, has_pii, was_blocked, processing_time_ms, NULL::VARCHAR AS feedback_rating
FROM hashed""",
)
def message_rows(spark, sf_dir):
    """The first message of each conversation arrives twice, as two equal rows with ids of their own."""
    given = X.messages(spark, sf_dir)
    rows = M.message_rows(given.unionByName(given.filter("seq = 1")).drop("message_id", "feedback_rating"))
    return rows.drop("agent_id", "timestamp", "guardrail_result")


@query(
    "conversation_rows",
    X.duckdb_with("session_starts").rstrip()
    + f""", given AS (SELECT * REPLACE (CASE WHEN agent_id <> 'agent-1' THEN session_id END AS session_id,
  CASE WHEN agent_id = 'agent-1' THEN 'user-0' ELSE user_id END AS user_id,
  CASE WHEN agent_id = 'agent-1' THEN TIMESTAMP '{X.AS_OF}' ELSE started_at END AS started_at),
  concat('{{"channel":"', status, '"}}') AS metadata FROM session_starts),
hashed AS (SELECT *, sha256(concat_ws(':', '', coalesce(session_id, ''), agent_id, user_id, coalesce(department, ''),
  epoch_us(started_at), metadata)) AS h FROM given)
SELECT coalesce(session_id, sha256(concat_ws(':', h, row_number() OVER (PARTITION BY h)))) AS session_id, agent_id,
  user_id, department, {sql_second("started_at")} AS started_at,
  0::BIGINT AS message_count, 0::BIGINT AS total_pii_incidents, 0::BIGINT AS total_blocked, 'active' AS status,
  metadata FROM hashed""",
)
def conversation_rows(spark, sf_dir):
    """Starts of one agent come without session id and time, and from one user: many are equal, none merge."""
    anonymous = F.col("agent_id") == "agent-1"
    starts = X.session_starts(spark, sf_dir).withColumns(
        {
            "session_id": F.when(~anonymous, F.col("session_id")),
            "user_id": F.when(anonymous, "user-0").otherwise(F.col("user_id")),
            "started_at": F.when(~anonymous, F.col("started_at")),
            "metadata": F.create_map(F.lit("channel"), F.col("status")),
        }
    )
    rows = M.conversation_rows(starts, X.AS_OF).withColumn("started_at", second("started_at"))
    return rows.drop("ended_at")


EXPORT_SCHEMA = (
    "session_id string, agent_id string, department string, part long, "
    "messages array<struct<role:string, content:string, feedback:string>>, "
    "stats struct<message_count:long, pii_incidents:long, blocked_count:long>"
)


# Requests for guardrails that exist, that do not, and for none.
ASKED = (
    "CASE doc_id % 6 WHEN 0 THEN 'pii' WHEN 1 THEN '' WHEN 2 THEN 'toxicity,Toxicity' WHEN 3 THEN NULL "
    "ELSE 'pii_detection,toxicity' END"
)


@query(
    "request_quarantine",
    f"""WITH asked AS (SELECT concat('doc-', doc_id) AS request_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE text END AS prompt,
  {ASKED} AS guardrails FROM documents)
SELECT 'rejected' AS sink, request_id, concat_ws(',', CASE WHEN prompt IS NULL THEN 'missing:prompt' END,
  CASE WHEN guardrails IN ('pii', '', 'toxicity,Toxicity') THEN 'invalid:guardrails' END) AS violations, 1::BIGINT AS n
FROM asked WHERE prompt IS NULL OR guardrails IN ('pii', '', 'toxicity,Toxicity')
UNION ALL SELECT 'audit', request_id, '', CASE WHEN guardrails IS NULL THEN 1 ELSE 2 END
FROM asked WHERE prompt IS NOT NULL AND (guardrails IS NULL OR guardrails = 'pii_detection,toxicity')""",
)
def request_quarantine(spark, sf_dir):
    """Every request is in the audit table or among the rejected ones."""
    asked = F.split(F.expr(ASKED), ",")
    incoming = (
        X.raw(spark, sf_dir, "documents")
        .withColumn("guardrails", F.when(F.expr(ASKED) == "", F.array().cast("array<string>")).otherwise(asked))
        .withColumn("prompt", F.expr("CASE WHEN doc_id % 4 = 1 THEN NULL ELSE text END"))
        .selectExpr(
            "concat('doc-', doc_id) AS request_id", "'agent-1' AS agent_id", "prompt", "guardrails",
            f"{X.PROMPTS['timestamp']} AS timestamp",
        )
    )
    audit, rejected = screen(incoming)
    counted = audit.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        rejected.select(
            F.lit("rejected").alias("sink"), "request_id", joined("violations").alias("violations"), F.lit(1).cast("long").alias("n")
        )
        .unionByName(counted.select(F.lit("audit").alias("sink"), "request_id", F.lit("").alias("violations"), "n"))
    )


@query("training_export_jsonl", export_sql(False))
def training_export_jsonl(spark, sf_dir):
    """Export to JSON lines and read them back."""
    path = scratch_dir(spark, "training_export")
    export_training_data(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), path, X.AS_OF)
    return shown_export(spark.read.schema(EXPORT_SCHEMA).json(f"{path}/conversations"))


@query(
    "dead_letter_replay",
    DIRTY_SQL
    + f"""SELECT request_id, {sql_second('"timestamp"')} AS at, {sql_day('"timestamp"')} AS event_date,
  coalesce(agent_id, 'default') AS agent_id, user_id, department, guardrail_type,
  CASE WHEN coalesce(status, 'unsure') = 'unsure' THEN 'flagged' ELSE status END AS status, prompt_length, has_pii,
  processing_time_ms, metadata, original_prompt, redacted_prompt FROM dirty""",
)
def dead_letter_replay(spark, sf_dir):
    """Rejected rows are mended in two attempts; all rows end up as if they had been right from the start, once each."""
    root = scratch_dir(spark, "replay")
    tables.append_audit(X.derive(X.raw(spark, sf_dir, "events"), DIRTY), root, "load-1")
    unsure = F.coalesce(F.col("status"), F.lit("unsure")) == "unsure"
    first = {"agent_id": F.coalesce("agent_id", F.lit("default"))}
    both = first | {"status": F.when(unsure, "flagged").otherwise(F.col("status"))}
    for changes in (first, both, both):
        replay.replay_audit(spark, root, "load-1", lambda rows, changes=changes: rows.withColumns(changes))
    rows = tables.read_table(spark, root, "audit_logs")
    return rows.withColumns({"at": second("timestamp"), "event_date": day("event_date")}).drop(
        "timestamp", "session_id", "model_used", "batch_id"
    )


@query(
    "request_replay",
    f"""WITH asked AS (SELECT concat('doc-', doc_id) AS request_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE text END AS prompt,
  {ASKED} AS guardrails FROM documents)
SELECT 'rejected' AS sink, count(*) AS n, count(DISTINCT request_id) AS n_requests FROM asked WHERE prompt IS NULL
UNION ALL SELECT 'audit', CAST(sum(CASE WHEN guardrails = 'pii_detection,toxicity' THEN 2 ELSE 1 END) AS BIGINT),
  count(*) FROM asked WHERE prompt IS NOT NULL""",
)
def request_replay(spark, sf_dir):
    """Requests for guardrails that do not exist come back with the default; those without a prompt stay rejected."""
    root = scratch_dir(spark, "request_replay")
    asked = F.split(F.expr(ASKED), ",")
    incoming = (
        X.raw(spark, sf_dir, "documents")
        .withColumn("guardrails", F.when(F.expr(ASKED) == "", F.array().cast("array<string>")).otherwise(asked))
        .withColumn("prompt", F.expr("CASE WHEN doc_id % 4 = 1 THEN NULL ELSE text END"))
        .selectExpr("concat('doc-', doc_id) AS request_id", "'agent-1' AS agent_id", "prompt", "guardrails", f"{X.PROMPTS['timestamp']} AS timestamp")
    )
    screening.screen_to_table(incoming, root, "load-1")
    known = F.forall("guardrails", H.known_guardrail) & (F.size("guardrails") > 0)
    for _ in range(2):
        replay.replay_requests(
            spark, root, "load-1", lambda rows: rows.withColumn("guardrails", F.when(known, F.col("guardrails")))
        )
    audit = tables.read_table(spark, root, "audit_logs").select(F.lit("audit").alias("sink"), "request_id")
    rejected = replay.open_letters(spark, root, "requests", "load-1").select(F.lit("rejected").alias("sink"), "request_id")
    return audit.unionByName(rejected).groupBy("sink").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("n_requests")
    )
