"""Reports from stored daily parts: A1, A2, A4, A6, A8-A10 and A12 over periods, and parts kept current by batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators import rollups as P
from govlens.plans import rollup
from govlens.session import scratch_dir
from govlens.sources import fixtures as X
from govlens.sources import tables
from workload.registry import day, query, second, sql_day, sql_second

AUDIT = X.duckdb_with("audit_logs")
FIRST, LAST = "2024-01-03", "2024-01-27"
DAYS = f"CAST(\"timestamp\" AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
PII = "count(*) FILTER (has_pii)"


def parts_of(spark, sf_dir, name: str = "usage_daily"):
    """The audit table is written in one batch, and its parts are stored."""
    root = scratch_dir(spark, "rollup")
    tables.append(X.audit_logs(spark, sf_dir), root, "audit_logs", "load-1")
    rollup.refresh(spark, root)
    return rollup.read_parts(spark, root, name)


def near(estimate: str, exact: str):
    """Whether an estimate is within three standard errors of the number that a scan of the rows counts."""
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.lit(3 * P.USER_ERROR) * F.col(exact)).alias("users_near")


def in_days(audit):
    return audit.filter(F.to_date("timestamp").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))


@query(
    "rollup_period",
    AUDIT
    + f"""SELECT count(*) AS total_requests, count(DISTINCT agent_id) AS unique_agents, {PII} AS pii_detected_count,
  count(*) FILTER (status = 'blocked') AS blocked_count, count(*) FILTER (status = 'passed') AS passed_count,
  true AS users_near FROM audit_logs WHERE {DAYS}""",
)
def rollup_period(spark, sf_dir):
    """One row from the parts, and one from a scan; they meet in a union."""
    found = P.overall(parts_of(spark, sf_dir), FIRST, LAST)
    exact = in_days(X.audit_logs(spark, sf_dir)).agg(F.count_distinct("user_id").alias("exact"))
    both = found.unionByName(exact, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(*[c for c in found.columns if c != "unique_users"], near("unique_users", "exact"))


@query(
    "rollup_departments",
    AUDIT
    + f"""SELECT coalesce(department, 'unknown') AS department, count(DISTINCT agent_id) AS total_agents,
  count(*) AS total_requests, {PII} AS pii_incidents, count(*) FILTER (status = 'blocked') AS blocked_requests,
  round(coalesce(avg(processing_time_ms), 0), 6) AS avg_response_time_ms, true AS users_near
FROM audit_logs WHERE {DAYS} GROUP BY 1""",
)
def rollup_departments(spark, sf_dir):
    found = P.by_department(parts_of(spark, sf_dir), FIRST, LAST)
    exact = in_days(X.audit_logs(spark, sf_dir)).groupBy(F.coalesce("department", F.lit("unknown")).alias("department"))
    both = found.join(exact.agg(F.count_distinct("user_id").alias("exact")), "department")
    rest = [c for c in found.columns if c not in ("total_users", "avg_response_time_ms")]
    return both.select(*rest, F.round("avg_response_time_ms", 6).alias("avg_response_time_ms"), near("total_users", "exact"))


@query(
    "rollup_leaderboard",
    AUDIT
    + f"""SELECT coalesce(department, 'unknown') AS department, count(*) AS total_requests,
  count(DISTINCT agent_id) AS unique_agents, {PII} AS pii_incidents,
  round({PII} * 100.0::DOUBLE / nullif(count(*), 0), 2) AS pii_rate FROM audit_logs WHERE {DAYS} GROUP BY 1""",
)
def rollup_leaderboard(spark, sf_dir):
    return P.leaderboard(parts_of(spark, sf_dir), FIRST, LAST).drop("unique_users")


@query(
    "rollup_overview",
    AUDIT
    + f"""SELECT count(*) AS total_requests, count(DISTINCT agent_id) AS unique_agents, {PII} AS pii_incidents,
  round(avg(processing_time_ms), 2) AS avg_response_time_ms,
  round({PII} * 100.0::DOUBLE / nullif(count(*), 0), 2) AS pii_rate_percent FROM audit_logs WHERE {DAYS}""",
)
def rollup_overview(spark, sf_dir):
    return P.overview(parts_of(spark, sf_dir), FIRST, LAST).drop("unique_users")


@query(
    "rollup_guardrails",
    AUDIT + f"""SELECT guardrail_type, count(*) AS "count" FROM audit_logs WHERE {DAYS} GROUP BY 1""",
)
def rollup_guardrails(spark, sf_dir):
    return P.by_guardrail(parts_of(spark, sf_dir), FIRST, LAST)


@query(
    "rollup_agents",
    AUDIT
    + f"""SELECT agent_id, count(*) AS total_requests, {PII} AS pii_incidents,
  round(coalesce(avg(processing_time_ms), 0), 6) AS avg_response_time_ms FROM audit_logs WHERE {DAYS}
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def rollup_agents(spark, sf_dir):
    found = P.by_agent(parts_of(spark, sf_dir), FIRST, LAST).drop("unique_users")
    return found.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@query(
    "rollup_users",
    AUDIT
    + f"""SELECT user_id, coalesce(department, 'Unknown') AS department, count(*) AS total_requests,
  {PII} AS pii_incidents, count(DISTINCT agent_id) AS agents_used, {sql_second('max("timestamp")')} AS last_activity
FROM audit_logs WHERE user_id IS NOT NULL AND {DAYS} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""",
)
def rollup_users(spark, sf_dir):
    """There are a dozen agents: a sketch of so few is exact."""
    found = P.busiest_users(parts_of(spark, sf_dir, "users_daily"), FIRST, LAST)
    return found.withColumn("last_activity", second("last_activity"))


@query(
    "rollup_percentiles",
    AUDIT
    + f"""SELECT coalesce(department, 'unknown') AS department, {sql_day("date_trunc('week', \"timestamp\")")} AS week,
  count(processing_time_ms) AS timed_requests, true AS ranks_near FROM audit_logs WHERE {DAYS} GROUP BY 1, 2""",
)
def rollup_percentiles(spark, sf_dir):
    """Weeks of departments: the rank of each percentile among the rows themselves is within twice the error."""
    groups = {"department": F.coalesce("department", F.lit("unknown")), "week": F.date_trunc("week", "event_date")}
    found = P.percentiles(parts_of(spark, sf_dir), FIRST, LAST, groups)
    audit = in_days(X.audit_logs(spark, sf_dir)).select(
        F.coalesce("department", F.lit("unknown")).alias("department"), F.date_trunc("week", "timestamp").alias("week"), "processing_time_ms"
    )
    below = {n: F.count_if(F.col("processing_time_ms") < F.col(n)) for n in P.PERCENTILES}
    upto = {n: F.count_if(F.col("processing_time_ms") <= F.col(n)) for n in P.PERCENTILES}
    error = 2 * P.RANK_ERROR
    within = F.lit(True)
    for name, p in P.PERCENTILES.items():
        n = F.first("timed_requests")
        within = within & (below[name] <= (p + error) * n) & (upto[name] >= (p - error) * n)
    ranks = audit.join(found, ["department", "week"]).groupBy("department", "week").agg(
        F.first("timed_requests").alias("timed_requests"), within.alias("ranks_near")
    )
    return ranks.withColumn("week", day("week"))


@query(
    "rollup_incremental",
    AUDIT
    + f"""SELECT {sql_day('"timestamp"')} AS date, CAST(sum(copies) AS BIGINT) AS total_requests,
  CAST(coalesce(sum(copies) FILTER (has_pii), 0) AS BIGINT) AS pii_incidents
FROM (SELECT *, CASE WHEN CAST(replace(request_id, 'req-', '') AS BIGINT) % 3 <> 0 THEN 1 ELSE 0 END
  + CASE WHEN "timestamp" >= TIMESTAMP '2024-01-11 00:00:00' THEN 1 ELSE 0 END AS copies FROM audit_logs)
WHERE copies > 0 GROUP BY 1""",
)
def rollup_incremental(spark, sf_dir):
    """A batch is loaded twice, then replaced by a part of its rows; a second one has the later days only."""
    root = scratch_dir(spark, "rollup_incremental")
    rows = X.audit_logs(spark, sf_dir)
    later = rows.filter(F.col("timestamp") >= F.lit("2024-01-11").cast("timestamp"))
    number = F.replace("request_id", F.lit("req-"), F.lit("")).cast("long")
    for batch, what in (("load-1", rows), ("load-1", rows), ("load-2", later), ("load-1", rows.filter(number % 3 != 0))):
        tables.append(what, root, "audit_logs", batch, rebalance=False)
        rollup.refresh(spark, root)
    found = P.over_time(rollup.read_parts(spark, root), "2024-01-01", "2024-03-30")
    return found.select(day("date").alias("date"), "total_requests", "pii_incidents")
