"""API-key queries: J5, K1-K5."""

from __future__ import annotations

from govlens.operators import access as A
from govlens.operators import access_history as H
from govlens.sources import fixtures as X
from workload.registry import query, second, sql_second

KEYS = X.duckdb_with("created_keys")
BOTH = X.duckdb_with("created_keys", "access_log")
MATCHED = (
    BOTH.rstrip()
    + """, matched AS (SELECT a.event_id, a.ts, k.key_id, k.agent_id, CASE WHEN k.key_id IS NULL THEN 'unknown'
  WHEN NOT k.is_active THEN 'inactive' WHEN k.expires_at < a.ts THEN 'expired' ELSE 'valid' END AS status
  FROM access_log a LEFT JOIN created_keys k ON sha256(a.presented_key) = sha256(k.plain_key)) """
)


@query(
    "hash_keys",
    KEYS
    + f"""SELECT key_id, agent_id, sha256(plain_key) AS key_hash, key_prefix, {sql_second("created_at")} AS created_at,
  {sql_second("created_at + INTERVAL 365 DAY")} AS expires_at, true AS is_active FROM created_keys""",
)
def hash_keys(spark, sf_dir):
    created = X.created_keys(spark, sf_dir).select("key_id", "agent_id", "plain_key", "created_at")
    out = A.hash_keys(created)
    return out.select(
        "key_id",
        "agent_id",
        "key_hash",
        "key_prefix",
        second("created_at").alias("created_at"),
        second("expires_at").alias("expires_at"),
        "is_active",
    )


@query("attribute_access", MATCHED + "SELECT event_id, key_id, agent_id FROM matched")
def attribute_access(spark, sf_dir):
    out = A.attribute_access(X.access_log(spark, sf_dir), X.api_keys(spark, sf_dir))
    return out.select("event_id", "key_id", "agent_id")


@query(
    "classify_access",
    MATCHED
    + """SELECT event_id, status, CASE WHEN status = 'valid' THEN key_id END AS key_id,
  CASE WHEN status = 'valid' THEN agent_id END AS agent_id FROM matched""",
)
def classify_access(spark, sf_dir):
    out = A.classify_access(X.access_log(spark, sf_dir), X.api_keys(spark, sf_dir))
    return out.select("event_id", "status", "key_id", "agent_id")


@query(
    "last_used",
    MATCHED
    + f"""SELECT k.key_id, {sql_second("u.at")} AS last_used_at FROM created_keys k LEFT JOIN
  (SELECT key_id, max(ts) AS at FROM matched WHERE status = 'valid' GROUP BY 1) u ON k.key_id = u.key_id""",
)
def last_used(spark, sf_dir):
    out = A.last_used(X.api_keys(spark, sf_dir), X.access_log(spark, sf_dir))
    return out.select("key_id", second("last_used_at").alias("last_used_at"))


@query(
    "agent_keys",
    KEYS
    + f"""SELECT agent_id, key_id, key_prefix, {sql_second("created_at")} AS created_at,
  {sql_second("expires_at")} AS expires_at, is_active FROM created_keys""",
)
def agent_keys(spark, sf_dir):
    out = A.agent_keys(X.api_keys(spark, sf_dir))
    return out.select(
        "agent_id",
        "key_id",
        "key_prefix",
        second("created_at").alias("created_at"),
        second("expires_at").alias("expires_at"),
        "is_active",
    )


@query(
    "revoke_keys",
    X.duckdb_with("audit_logs", "created_keys")
    + """SELECT k.key_id, k.is_active AND r.key_id IS NULL AS is_active FROM created_keys k LEFT JOIN
  (SELECT DISTINCT replace(user_id, 'user-', 'key-') AS key_id FROM audit_logs
   WHERE status = 'blocked' AND guardrail_type = 'output_guardrail' AND user_id IS NOT NULL) r
  ON k.key_id = r.key_id""",
)
def revoke_keys(spark, sf_dir):
    """Keys of users who received a blocked response are revoked."""
    blocked = X.audit_logs(spark, sf_dir).filter("status = 'blocked' AND guardrail_type = 'output_guardrail'")
    revoked = blocked.selectExpr("replace(user_id, 'user-', 'key-') AS key_id").dropna()
    return A.revoke_keys(X.api_keys(spark, sf_dir), revoked).select("key_id", "is_active")


HISTORY = X.duckdb_with("created_keys", "access_log", "key_switches", "key_changes")
AS_OF = (
    HISTORY.rstrip()
    + """, at_once AS (SELECT * FROM key_changes QUALIFY row_number() OVER (PARTITION BY key_id, valid_from
  ORDER BY is_active) = 1),
judged AS (SELECT a.event_id, a.ts, c.key_id, c.agent_id, CASE WHEN c.key_id IS NULL THEN 'unknown'
  WHEN NOT c.is_active THEN 'inactive' WHEN c.expires_at < a.ts THEN 'expired' ELSE 'valid' END AS status
  FROM access_log a ASOF LEFT JOIN at_once c ON a.presented_key = c.plain_key AND a.ts >= c.valid_from) """
)
JUDGED = """event_id, status, CASE WHEN status = 'valid' THEN key_id END AS key_id,
  CASE WHEN status = 'valid' THEN agent_id END AS agent_id FROM judged"""


def key_changes(spark, sf_dir):
    return H.key_changes(X.api_keys(spark, sf_dir), X.key_switches(spark, sf_dir))


@query(
    "key_changes",
    HISTORY
    + f"""SELECT key_id, agent_id, {sql_second("valid_from")} AS valid_from, {sql_second("expires_at")} AS expires_at,
  is_active FROM key_changes""",
)
def key_history(spark, sf_dir):
    """Keys made, revoked and restored: one row per change."""
    changes = key_changes(spark, sf_dir)
    return changes.select("key_id", "agent_id", second("valid_from").alias("valid_from"), second("expires_at").alias("expires_at"), "is_active")


@query("access_as_of", AS_OF + "SELECT " + JUDGED)
def access_as_of(spark, sf_dir):
    """Accesses by the state of the key when they happened; keys are revoked and restored in between."""
    out = H.access_as_of(X.access_log(spark, sf_dir), key_changes(spark, sf_dir))
    return out.select("event_id", "status", "key_id", "agent_id")


@query(
    "last_used_as_of",
    AS_OF
    + f"""SELECT k.key_id, {sql_second("u.at")} AS last_used_at FROM created_keys k LEFT JOIN
  (SELECT key_id, max(ts) AS at FROM judged WHERE status = 'valid' GROUP BY 1) u ON k.key_id = u.key_id""",
)
def last_used_as_of(spark, sf_dir):
    """Uses that were valid when they happened count, also of keys that were revoked since."""
    out = H.last_used_as_of(X.api_keys(spark, sf_dir), X.access_log(spark, sf_dir), key_changes(spark, sf_dir))
    return out.select("key_id", second("last_used_at").alias("last_used_at"))
