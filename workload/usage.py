"""Analytics queries: A1-A17, J1-J3, F5, F6, W2, W3, M6."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators import feedback as FB
from govlens.operators import registry as R
from govlens.operators import usage as U
from govlens.plans import usage_report
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from workload.registry import ORACLES, day, joined, query, second, sql_day, sql_second

AS_OF = X.AS_OF
AT = f"TIMESTAMP '{AS_OF}'"
AUDIT = X.duckdb_with("audit_logs")
BOTH = X.duckdb_with("audit_logs", "agents")


def since(days: int) -> str:
    return f"\"timestamp\" >= {AT} - INTERVAL {days} DAY"


def within(days: int) -> str:
    return f"{since(days)} AND \"timestamp\" <= {AT}"


PII = "count(*) FILTER (has_pii)"
RATE = f"round({PII} * 100.0::DOUBLE / nullif(count(*), 0), 2)"


@query(
    "usage_overall",
    AUDIT
    + f"""SELECT count(*) AS total_requests, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT agent_id) AS unique_agents, {PII} AS pii_detected_count,
  count(*) FILTER (status = 'blocked') AS blocked_count, count(*) FILTER (status = 'passed') AS passed_count
FROM audit_logs WHERE {within(7)}""",
)
def usage_overall(spark, sf_dir):
    return U.usage_overall(X.audit_logs(spark, sf_dir), AS_OF, 7)


@query(
    "usage_by_department",
    AUDIT
    + f"""SELECT coalesce(department, 'unknown') AS department, count(DISTINCT agent_id) AS total_agents,
  count(*) AS total_requests, count(DISTINCT user_id) AS total_users, {PII} AS pii_incidents,
  count(*) FILTER (status = 'blocked') AS blocked_requests,
  round(coalesce(avg(processing_time_ms), 0), 6) AS avg_response_time_ms
FROM audit_logs WHERE {within(7)} GROUP BY 1""",
)
def usage_by_department(spark, sf_dir):
    out = U.usage_by_department(X.audit_logs(spark, sf_dir), AS_OF, 7)
    return out.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@query(
    "usage_by_agent",
    AUDIT
    + f"""SELECT agent_id, count(*) AS total_requests, count(DISTINCT user_id) AS unique_users, {PII} AS pii_incidents,
  round(coalesce(avg(processing_time_ms), 0), 6) AS avg_response_time_ms
FROM audit_logs WHERE {within(7)} GROUP BY 1 ORDER BY total_requests DESC, agent_id LIMIT 10""",
)
def usage_by_agent(spark, sf_dir):
    out = U.usage_by_agent(X.audit_logs(spark, sf_dir), AS_OF, 7)
    return out.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@query(
    "usage_by_guardrail",
    AUDIT + f"SELECT guardrail_type, count(*) AS count FROM audit_logs WHERE {within(7)} GROUP BY 1",
)
def usage_by_guardrail(spark, sf_dir):
    return U.usage_by_guardrail(X.audit_logs(spark, sf_dir), AS_OF, 7)


def _section(name: str, key: str, reported: set[str], tail: str) -> str:
    measures = {
        "total_requests": "count(*)",
        "unique_users": "count(DISTINCT user_id)",
        "unique_agents": "count(DISTINCT agent_id)",
        "pii_incidents": PII,
        "blocked_requests": "count(*) FILTER (status = 'blocked')",
        "passed_requests": "count(*) FILTER (status = 'passed')",
        "avg_response_time_ms": "round(coalesce(avg(processing_time_ms), 0), 6)",
    }
    chosen = ", ".join(f"{sql if m in reported else 'NULL'} AS {m}" for m, sql in measures.items())
    return f"(SELECT '{name}' AS section, {key} AS key, {chosen} FROM slice {tail})"


SECTIONS = (
    AUDIT.rstrip()
    + f", slice AS (SELECT * FROM audit_logs WHERE {within(7)}), sections AS ("
    + " UNION ALL ".join(
        [
            _section(
                "overall",
                "NULL::VARCHAR",
                {
                    "total_requests", "unique_users", "unique_agents", "pii_incidents", "blocked_requests",
                    "passed_requests",
                },
                "",
            ),
            _section(
                "department",
                "coalesce(department, 'unknown')",
                {
                    "total_requests", "unique_users", "unique_agents", "pii_incidents", "blocked_requests",
                    "avg_response_time_ms",
                },
                "GROUP BY 2",
            ),
            _section(
                "agent",
                "agent_id",
                {"total_requests", "unique_users", "pii_incidents", "avg_response_time_ms"},
                "GROUP BY 2 ORDER BY total_requests DESC, key LIMIT 10",
            ),
            _section("guardrail", "guardrail_type", {"total_requests"}, "GROUP BY 2"),
        ]
    )
    + ") "
)


@query("usage_sections", SECTIONS + "SELECT * FROM sections")
def usage_sections(spark, sf_dir):
    out = usage_report.usage_sections(X.audit_logs(spark, sf_dir), AS_OF, 7)
    return out.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


def _busiest(agents):
    shown = F.transform(agents, lambda a: F.concat_ws("=", a["agent_id"], a["total_requests"].cast("string")))
    return F.array_join(shown, "+")


@query(
    "usage_analytics",
    SECTIONS
    + f"""SELECT {sql_second(f"{AT} - INTERVAL 7 DAY")} AS period_start, {sql_second(AT)} AS period_end,
  (SELECT total_requests FROM sections WHERE section = 'overall') AS total_requests,
  (SELECT unique_users FROM sections WHERE section = 'overall') AS unique_users,
  (SELECT unique_agents FROM sections WHERE section = 'overall') AS unique_agents,
  (SELECT pii_incidents FROM sections WHERE section = 'overall') AS pii_detected_count,
  (SELECT blocked_requests FROM sections WHERE section = 'overall') AS blocked_count,
  (SELECT passed_requests FROM sections WHERE section = 'overall') AS passed_count,
  (SELECT string_agg(concat(key, ':', total_requests, ':', unique_users, ':', busiest), ','
     ORDER BY total_requests DESC, key) FROM sections LEFT JOIN
     (SELECT department, string_agg(concat(agent_id, '=', n), '+' ORDER BY n DESC, agent_id) AS busiest FROM
       (SELECT coalesce(department, 'unknown') AS department, agent_id, count(*) AS n,
          row_number() OVER (PARTITION BY coalesce(department, 'unknown') ORDER BY count(*) DESC, agent_id) AS r
        FROM audit_logs WHERE "timestamp" BETWEEN {AT} - INTERVAL 7 DAY AND {AT} GROUP BY 1, 2)
      WHERE r <= 5 GROUP BY 1) ON department = key
     WHERE section = 'department') AS by_department,
  (SELECT string_agg(concat(key, ':', total_requests), ',' ORDER BY total_requests DESC, key) FROM
     (SELECT * FROM sections WHERE section = 'agent' ORDER BY total_requests DESC, key LIMIT 10)) AS by_agent,
  (SELECT string_agg(concat(key, ':', total_requests), ',' ORDER BY key)
     FROM sections WHERE section = 'guardrail') AS by_guardrail""",
)
def usage_analytics(spark, sf_dir):
    out = usage_report.usage_analytics(X.audit_logs(spark, sf_dir), AS_OF, 7)
    show = lambda *parts: F.concat_ws(":", *[p.cast("string") for p in parts])
    return out.select(
        second("period_start").alias("period_start"),
        second("period_end").alias("period_end"),
        "total_requests",
        "unique_users",
        "unique_agents",
        "pii_detected_count",
        "blocked_count",
        "passed_count",
        joined(
            F.transform(
                "by_department",
                lambda d: show(d["department"], d["total_requests"], d["total_users"], _busiest(d["top_agents"])),
            )
        ).alias("by_department"),
        joined(F.transform("by_agent", lambda a: show(a["agent_id"], a["total_requests"]))).alias("by_agent"),
        joined(
            F.transform(
                F.array_sort(F.map_entries("by_guardrail")), lambda g: show(g["key"], g["value"])
            )
        ).alias("by_guardrail"),
    )


def _departments(unknown: str, agents: str) -> str:
    return (
        AUDIT
        + f"""SELECT coalesce(department, '{unknown}') AS department, count(*) AS total_requests,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT agent_id) AS {agents}, {PII} AS pii_incidents,
  {RATE} AS pii_rate FROM audit_logs WHERE {since(30)} GROUP BY 1"""
    )


@query("department_leaderboard", _departments("unknown", "unique_agents"))
def department_leaderboard(spark, sf_dir):
    return U.department_leaderboard(X.audit_logs(spark, sf_dir), AS_OF)


@query("department_breakdown", _departments("Unknown", "agents_used"))
def department_breakdown(spark, sf_dir):
    return U.department_breakdown(X.audit_logs(spark, sf_dir), AS_OF)


@query(
    "user_activity",
    AUDIT
    + f"""SELECT user_id, coalesce(department, 'Unknown') AS department, count(*) AS total_requests,
  {PII} AS pii_incidents, count(DISTINCT agent_id) AS agents_used, {sql_second('max("timestamp")')} AS last_activity
FROM audit_logs WHERE {since(30)} AND user_id IS NOT NULL GROUP BY 1, 2
ORDER BY total_requests DESC, user_id, department LIMIT 50""",
)
def user_activity(spark, sf_dir):
    out = U.user_activity(X.audit_logs(spark, sf_dir), AS_OF)
    return out.withColumn("last_activity", second("last_activity"))


@query(
    "overview_metrics",
    AUDIT
    + f"""SELECT count(*) AS total_requests, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT agent_id) AS unique_agents, {PII} AS pii_incidents,
  round(avg(processing_time_ms), 2) AS avg_response_time_ms, {RATE} AS pii_rate_percent
FROM audit_logs WHERE {since(7)}""",
)
def overview_metrics(spark, sf_dir):
    return U.overview_metrics(X.audit_logs(spark, sf_dir), AS_OF)


@query(
    "requests_over_time",
    AUDIT
    + f"""SELECT {sql_day('"timestamp"')} AS date, count(*) AS total_requests,
  count(*) FILTER (status = 'blocked') AS blocked_requests, count(*) FILTER (status = 'passed') AS passed_requests,
  {PII} AS pii_incidents FROM audit_logs WHERE {since(30)} GROUP BY 1""",
)
def requests_over_time(spark, sf_dir):
    return U.requests_over_time(X.audit_logs(spark, sf_dir), AS_OF).withColumn("date", day("date"))


@query(
    "hourly_heatmap",
    AUDIT
    + f"""SELECT CAST(dayofweek("timestamp") + 1 AS BIGINT) AS day_of_week,
  CAST(hour("timestamp") AS BIGINT) AS hour_of_day, count(*) AS request_count
FROM audit_logs WHERE {since(30)} GROUP BY 1, 2""",
)
def hourly_heatmap(spark, sf_dir):
    out = U.hourly_heatmap(X.audit_logs(spark, sf_dir), AS_OF)
    return out.withColumns({c: F.col(c).cast("long") for c in ("day_of_week", "hour_of_day")})


@query(
    "latency_percentiles",
    AUDIT
    + f"""SELECT {sql_day('"timestamp"')} AS date, count(*) AS request_count,
  quantile_disc(processing_time_ms, 0.5) AS p50_ms, quantile_disc(processing_time_ms, 0.9) AS p90_ms,
  quantile_disc(processing_time_ms, 0.99) AS p99_ms FROM audit_logs WHERE {since(30)} GROUP BY 1""",
)
def latency_percentiles(spark, sf_dir):
    return U.latency_percentiles(X.audit_logs(spark, sf_dir), AS_OF).withColumn("date", day("date"))


@query(
    "recent_pii_incidents",
    AUDIT
    + f"""SELECT {sql_second('"timestamp"')} AS at, request_id, agent_id, user_id, department,
  CASE WHEN metadata LIKE '%email%' THEN 'email,ssn' ELSE 'credit_card' END AS pii_types,
  substr(original_prompt, 1, 100) AS prompt_preview, redacted_prompt
FROM audit_logs WHERE has_pii ORDER BY "timestamp" DESC, request_id LIMIT 100""",
)
def recent_pii_incidents(spark, sf_dir):
    out = U.recent_pii_incidents(X.audit_logs(spark, sf_dir))
    return out.withColumn("pii_types", joined("pii_types")).withColumn("at", second("timestamp")).drop("timestamp")


@query(
    "pii_type_breakdown",
    AUDIT
    + f"""SELECT pii_type, count(*) AS occurrences FROM (SELECT unnest(from_json(metadata,
    '{{"pii_types": ["VARCHAR"]}}').pii_types) AS pii_type FROM audit_logs WHERE has_pii AND {since(30)}) GROUP BY 1""",
)
def pii_type_breakdown(spark, sf_dir):
    return U.pii_type_breakdown(X.audit_logs(spark, sf_dir), AS_OF)


@query(
    "top_agents_named",
    BOTH
    + f"""SELECT a.agent_id, coalesce(g.agent_name, a.agent_id) AS agent_name,
  coalesce(g.department, 'Unknown') AS department, count(*) AS total_requests,
  count(DISTINCT a.user_id) AS unique_users, count(*) FILTER (a.has_pii) AS pii_incidents,
  round(avg(a.processing_time_ms), 2) AS avg_response_time_ms
FROM audit_logs a LEFT JOIN agents g ON a.agent_id = g.agent_id WHERE a.{since(30)}
GROUP BY a.agent_id, g.agent_name, g.department
ORDER BY total_requests DESC, a.agent_id, agent_name, department LIMIT 10""",
)
def top_agents_named(spark, sf_dir):
    return U.top_agents_named(X.audit_logs(spark, sf_dir), X.agents(spark, sf_dir), AS_OF)


@query(
    "top_agents_per_department",
    AUDIT
    + f"""SELECT department, string_agg(concat(agent_id, ':', n), ',' ORDER BY r) AS top_agents FROM
  (SELECT *, row_number() OVER (PARTITION BY department ORDER BY n DESC, agent_id) AS r FROM
    (SELECT coalesce(department, 'unknown') AS department, agent_id, count(*) AS n FROM audit_logs
     WHERE {within(7)} GROUP BY 1, 2)) WHERE r <= 5 GROUP BY department""",
)
def top_agents_per_department(spark, sf_dir):
    out = U.top_agents_per_department(X.audit_logs(spark, sf_dir), AS_OF)
    entry = lambda a: F.concat_ws(":", a["agent_id"], a["total_requests"].cast("string"))
    return out.select("department", joined(F.transform("top_agents", entry)).alias("top_agents"))


@query(
    "pii_risk_band",
    AUDIT
    + f"""SELECT department, pii_rate, CASE WHEN pii_rate > 50 THEN 'red' WHEN pii_rate > 20 THEN 'yellow'
  ELSE 'green' END AS risk_band, round(pii_rate, 1) AS rate_shown FROM
  (SELECT coalesce(department, 'unknown') AS department, {RATE} AS pii_rate FROM audit_logs
   WHERE {since(30)} GROUP BY 1)""",
)
def pii_risk_band(spark, sf_dir):
    rates = U.department_leaderboard(X.audit_logs(spark, sf_dir), AS_OF).select("department", "pii_rate")
    return U.pii_risk_bands(rates)


@query(
    "dashboard_summary",
    BOTH
    + f"""SELECT (SELECT count(*) FROM agents) AS total_agents,
  (SELECT count(DISTINCT department) FROM agents) AS active_departments, count(*) AS total_requests_period,
  coalesce(round_even({PII} / nullif(count(*), 0) * 100.0::DOUBLE, 2), 0) AS pii_incident_rate
FROM audit_logs WHERE {within(7)}""",
)
def dashboard_summary(spark, sf_dir):
    return usage_report.dashboard_summary(X.agents(spark, sf_dir), X.audit_logs(spark, sf_dir), AS_OF, 7)


@query(
    "agent_registry",
    X.duckdb_with("agents")
    + f"""SELECT agent_id, agent_name, department, team, owner_email, environment,
  {sql_second("created_at")} AS created_at, is_active FROM agents""",
)
def agent_registry(spark, sf_dir):
    return R.agent_registry(X.agents(spark, sf_dir)).withColumn("created_at", second("created_at"))


@query(
    "agents_with_stats",
    BOTH
    + """, stats AS (SELECT agent_id, count(*) AS n, count(*) FILTER (has_pii) AS p FROM audit_logs GROUP BY 1)
SELECT g.agent_id, g.agent_name, g.department, coalesce(replace(replace(replace(g.tags, '["', ''), '"]', ''),
  '","', ','), '') AS tags, coalesce(n, 0) AS total_requests, coalesce(p, 0) AS pii_incidents
FROM agents g LEFT JOIN stats s ON g.agent_id = s.agent_id""",
)
def agents_with_stats(spark, sf_dir):
    out = R.agents_with_stats(X.agents(spark, sf_dir), X.audit_logs(spark, sf_dir))
    return out.select(
        "agent_id", "agent_name", "department", joined("tags").alias("tags"), "total_requests", "pii_incidents"
    )


@query(
    "agent_with_stats",
    BOTH
    + """SELECT g.agent_id, g.agent_name, (SELECT count(*) FROM audit_logs WHERE agent_id = 'agent-4') AS total_requests,
  (SELECT count(*) FROM audit_logs WHERE agent_id = 'agent-4' AND has_pii) AS pii_incidents
FROM agents g WHERE g.agent_id = 'agent-4'""",
)
def agent_with_stats(spark, sf_dir):
    out = R.agents_with_stats(X.agents(spark, sf_dir), X.audit_logs(spark, sf_dir), agent_id="agent-4")
    return out.select("agent_id", "agent_name", "total_requests", "pii_incidents")


@query(
    "agent_performance",
    BOTH
    + """, stats AS (SELECT agent_id, count(*) AS n, count(*) FILTER (has_pii) AS p, count(DISTINCT user_id) AS u,
  avg(processing_time_ms) AS ms, count(*) FILTER (status = 'blocked') AS b FROM audit_logs GROUP BY 1)
SELECT g.agent_id, g.agent_name, g.department, coalesce(n, 0) AS total_requests, coalesce(p, 0) AS pii_incidents,
  coalesce(u, 0) AS unique_users, round(coalesce(ms, 0), 6) AS avg_response_time_ms, coalesce(b, 0) AS blocked_requests
FROM agents g LEFT JOIN stats s ON g.agent_id = s.agent_id""",
)
def agent_performance(spark, sf_dir):
    out = R.agent_performance(X.agents(spark, sf_dir), X.audit_logs(spark, sf_dir))
    return out.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@query(
    "latest_agents",
    X.duckdb_with("agents")
    + f"""SELECT agent_id, {sql_second("max(updated_at)")} AS updated_at, is_active AND NOT even AS is_active FROM (
  SELECT agent_id, is_active, CAST(replace(agent_id, 'agent-', '') AS BIGINT) % 2 = 0 AS even,
    updated_at + CASE WHEN CAST(replace(agent_id, 'agent-', '') AS BIGINT) % 2 = 0 THEN INTERVAL 1 DAY
                 ELSE INTERVAL 0 DAY END AS updated_at FROM agents) GROUP BY agent_id, is_active, even""",
)
def latest_agents(spark, sf_dir):
    agents = X.agents(spark, sf_dir)
    even = F.regexp_extract("agent_id", r"(\d+)", 1).cast("long") % 2 == 0
    second_version = agents.filter(even).withColumns(
        {"updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY"), "is_active": F.lit(False)}
    )
    out = R.latest_agents(agents.unionByName(second_version))
    return out.select("agent_id", second("updated_at").alias("updated_at"), "is_active")


FEEDBACK = X.duckdb_with("feedback")


@query(
    "feedback_summary",
    FEEDBACK
    + f"""SELECT agent_id, count(*) AS total_feedback, count(*) FILTER (rating = 'helpful') AS helpful_count,
  count(*) FILTER (rating = 'not_helpful') AS not_helpful_count,
  count(*) FILTER (rating = 'incorrect') AS incorrect_count,
  count(*) FILTER (rating = 'inappropriate') AS inappropriate_count, count(DISTINCT user_id) AS unique_users,
  round_even(count(*) FILTER (rating = 'helpful') / count(*) * 100.0::DOUBLE, 2) AS helpful_rate
FROM feedback WHERE {since(30)} GROUP BY 1""",
)
def feedback_summary(spark, sf_dir):
    return FB.feedback_summary(X.feedback(spark, sf_dir), AS_OF)


@query(
    "feedback_of_agents",
    X.duckdb_with("agents", "feedback")
    + f"""SELECT g.agent_id, count(f.agent_id) AS total_feedback,
  count(*) FILTER (f.rating = 'helpful') AS helpful_count,
  CASE WHEN count(f.agent_id) = 0 THEN '{FB.NO_FEEDBACK}' END AS message
FROM (SELECT DISTINCT agent_id FROM agents) g LEFT JOIN (SELECT * FROM feedback WHERE {since(30)}) f
  ON g.agent_id = f.agent_id GROUP BY 1""",
)
def feedback_of_agents(spark, sf_dir):
    out = FB.feedback_of_agents(X.agents(spark, sf_dir), X.feedback(spark, sf_dir), AS_OF)
    return out.select("agent_id", "total_feedback", "helpful_count", "message")


@query(
    "recent_suggestions",
    FEEDBACK
    + f"""SELECT feedback_id, request_id, agent_id, user_id, rating, comment, suggestion,
  {sql_second('"timestamp"')} AS at FROM feedback WHERE suggestion IS NOT NULL
ORDER BY "timestamp" DESC, feedback_id LIMIT 20""",
)
def recent_suggestions(spark, sf_dir):
    out = FB.recent_suggestions(X.feedback(spark, sf_dir))
    return out.withColumn("at", second("timestamp")).drop("timestamp")


@query(
    "feedback_to_session",
    X.duckdb_with("audit_logs", "feedback")
    + f"""SELECT session_id, rating, {sql_second("rated_at")} AS rated_at FROM (
  SELECT a.session_id, f.rating, f."timestamp" AS rated_at,
    row_number() OVER (PARTITION BY a.session_id ORDER BY f."timestamp" DESC, f.feedback_id DESC) AS r
  FROM audit_logs a JOIN feedback f ON a.request_id = f.request_id WHERE a.session_id IS NOT NULL) WHERE r = 1""",
)
def feedback_to_session(spark, sf_dir):
    out = FB.feedback_to_session(X.feedback(spark, sf_dir), X.audit_logs(spark, sf_dir))
    return out.withColumn("rated_at", second("rated_at"))


@query("recent_pii_incidents_by_day", ORACLES["recent_pii_incidents"])
def recent_pii_incidents_by_day(spark, sf_dir):
    """The same rows from a table with day partitions: the days are searched from a later date on."""
    root = scratch_dir(spark, "recent_incidents")
    tables.append(X.audit_logs(spark, sf_dir), root, "audit_logs", "load-1")
    out = U.recent_pii_incidents(tables.read_table(spark, root, "audit_logs"), as_of="2024-02-20")
    return out.withColumn("pii_types", joined("pii_types")).withColumn("at", second("timestamp")).drop("timestamp")


@query("recent_suggestions_by_day", ORACLES["recent_suggestions"])
def recent_suggestions_by_day(spark, sf_dir):
    root = scratch_dir(spark, "recent_suggestions")
    tables.append(X.feedback(spark, sf_dir), root, "feedback", "load-1")
    out = FB.recent_suggestions(tables.read_table(spark, root, "feedback"), as_of=AS_OF)
    return out.withColumn("at", second("timestamp")).drop("timestamp")
