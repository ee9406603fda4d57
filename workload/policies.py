"""Policy queries: P1-P8."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions import patterns as P
from govlens.operators import policy
from govlens.operators.guardrails import detect
from govlens.plans import screening
from govlens.sources import fixtures as X
from workload.registry import joined, query, second, sql_second
from workload.texts import injection_cte, pii_cte, sensitive_cte, texts, toxic, with_texts

# Which guardrails a request asks for, by the length of its text; a NULL list takes the default.
ASKED = {
    0: "pii_detection,toxicity,prompt_injection,sensitive_request",
    1: "sensitive_request,hallucination",
    2: "toxicity,pii_detection",
    3: "prompt_injection",
    4: None,
}
ASKED_SQL = (
    "CASE length(prompt) % 5 "
    + " ".join(f"WHEN {n} THEN '{kinds}'" for n, kinds in ASKED.items() if kinds)
    + " ELSE 'pii_detection' END"
)

JUDGED = [
    pii_cte("j1", "texts"),
    sensitive_cte("j2", "j1"),
    injection_cte("j3", "j2"),
    f"j4 AS (SELECT *, {toxic('prompt')} AS is_toxic, {ASKED_SQL} AS asked FROM j3)",
    """judged AS (SELECT *, CASE WHEN has_pii THEN 'blocked' ELSE 'passed' END AS s_pii_detection,
  CASE WHEN sensitive_types <> '' THEN 'blocked' ELSE 'passed' END AS s_sensitive_request,
  CASE WHEN is_toxic THEN 'flagged' ELSE 'passed' END AS s_toxicity,
  CASE WHEN n_types >= 3 THEN 'blocked' WHEN n_types > 0 THEN 'flagged' ELSE 'passed' END AS s_prompt_injection
  FROM j4)""",
    """decided AS (SELECT *, CASE
  WHEN (contains(asked, 'pii_detection') AND s_pii_detection = 'blocked')
    OR (contains(asked, 'sensitive_request') AND s_sensitive_request = 'blocked')
    OR (contains(asked, 'prompt_injection') AND s_prompt_injection = 'blocked') THEN 'blocked'
  WHEN (contains(asked, 'toxicity') AND s_toxicity = 'flagged')
    OR (contains(asked, 'prompt_injection') AND s_prompt_injection = 'flagged') THEN 'flagged'
  ELSE 'passed' END AS overall_status FROM judged)""",
]


def _requests(spark, sf_dir):
    """All texts with their requested guardrails."""
    asked = F.when(F.length("prompt") % 5 == 0, F.lit(ASKED[0]))
    for n, kinds in list(ASKED.items())[1:]:
        asked = asked.when(F.length("prompt") % 5 == n, F.lit(kinds))
    return texts(spark, sf_dir).withColumn("guardrails", F.split(asked, ","))


@query(
    "status_per_guardrail",
    with_texts(*JUDGED)
    + """SELECT request_id, s_pii_detection AS pii, s_sensitive_request AS sensitive, s_toxicity AS toxicity,
  s_prompt_injection AS injection, 'passed' AS hallucination FROM judged""",
)
def status_per_guardrail(spark, sf_dir):
    return policy.statuses(detect(texts(spark, sf_dir))).select(
        "request_id",
        F.col("pii_detection_status").alias("pii"),
        F.col("sensitive_request_status").alias("sensitive"),
        F.col("toxicity_status").alias("toxicity"),
        F.col("prompt_injection_status").alias("injection"),
        policy.status("hallucination").alias("hallucination"),
    )


_CONFIDENCE = {
    "pii_detection": "CASE WHEN has_pii THEN 0.7 ELSE 0.0 END",
    "sensitive_request": "CASE WHEN sensitive_types <> '' THEN 1.0 ELSE 0.0 END",
    "toxicity": "CASE WHEN is_toxic THEN 0.5 ELSE 0.0 END",
    "prompt_injection": "round(least(n_types * 0.3::DOUBLE, 1.0::DOUBLE), 1)",
}


def _result_sql(kind: str, state: str, confidence: str) -> str:
    return (
        f"CASE WHEN contains(asked, '{kind}') THEN concat('{kind}=', {state}, '@', "
        f"printf('%.1f', CAST({confidence} AS DOUBLE))) END"
    )


# The results in the order each list of guardrails asks for them.
_ORDERED = "CASE length(prompt) % 5 " + " ".join(
    f"WHEN {n} THEN concat_ws(',', "
    + ", ".join(
        _result_sql(
            k,
            f"s_{k}" if k in _CONFIDENCE else "'passed'",
            _CONFIDENCE.get(k, "0.0"),
        )
        for k in (kinds or "pii_detection").split(",")
    )
    + ")"
    for n, kinds in ASKED.items()
) + " END"


@query(
    "check_input",
    with_texts(*JUDGED)
    + f"""SELECT request_id, overall_status, {_ORDERED} AS results,
  CASE WHEN overall_status = 'blocked' THEN
    CASE WHEN contains(asked, 'pii_detection') AND has_pii THEN redacted_text ELSE prompt END END AS safe_prompt
FROM decided""",
)
def check_input(spark, sf_dir):
    shown = F.transform(
        "results",
        lambda r: F.concat(
            r["guardrail_type"], F.lit("="), r["status"], F.lit("@"), F.format_string("%.1f", r["confidence"])
        ),
    )
    return policy.check_input(_requests(spark, sf_dir)).select(
        "request_id", "overall_status", joined(shown).alias("results"), "safe_prompt"
    )


AUDIT_KINDS = ["pii_detection", "sensitive_request", "toxicity", "prompt_injection"]


def _strings_json(joined_types: str) -> str:
    return (
        f"CASE WHEN {joined_types} = '' THEN '[]' ELSE "
        f"concat('[\"', replace({joined_types}, ',', '\",\"'), '\"]') END"
    )


_METADATA = {
    "pii_detection": (
        f"concat('{{\"pii_types\":', {_strings_json('pii_types')}, ',\"confidence\":', "
        "CASE WHEN has_pii THEN '0.7' ELSE '0.0' END, '}')"
    ),
    "sensitive_request": (
        "concat('{\"requests_sensitive_data\":', CASE WHEN sensitive_types <> '' THEN 'true' ELSE 'false' END, "
        f"',\"sensitive_types\":', {_strings_json('sensitive_types')}, '}}')"
    ),
    "toxicity": (
        "CASE WHEN is_toxic THEN "
        f"'{{\"is_toxic\":true,\"toxicity_score\":0.5,\"categories\":[\"{P.TOXIC_CATEGORY}\"]}}' "
        "ELSE '{\"is_toxic\":false,\"toxicity_score\":0.0,\"categories\":[]}' END"
    ),
    "prompt_injection": (
        "concat('{\"is_injection\":', CASE WHEN n_types > 0 THEN 'true' ELSE 'false' END, ',\"injection_score\":', "
        "CASE n_types WHEN 0 THEN '0.0' WHEN 1 THEN '0.3' WHEN 2 THEN '0.6' WHEN 3 THEN '0.8999999999999999' "
        f"ELSE '1.0' END, ',\"injection_types\":', {_strings_json('injection_types')}, '}}')"
    ),
}

AUDIT_SQL = " UNION ALL ".join(
    f"SELECT request_id, '{k}' AS guardrail_type, s_{k} AS status, CAST(length(prompt) AS BIGINT) AS prompt_length, "
    f"{'has_pii' if k == 'pii_detection' else 'false'} AS has_pii, {_METADATA[k]} AS metadata, "
    f"prompt AS original_prompt, {'redacted_text' if k == 'pii_detection' else 'NULL::VARCHAR'} AS redacted_prompt "
    f"FROM judged WHERE contains(asked, '{k}')"
    for k in AUDIT_KINDS
)


@query("audit_rows", with_texts(*JUDGED) + AUDIT_SQL)
def audit_rows(spark, sf_dir):
    scored = policy.score(_requests(spark, sf_dir).withColumn("timestamp", F.lit(X.AS_OF).cast("timestamp")))
    return policy.audit_rows(scored).select(
        "request_id",
        "guardrail_type",
        "status",
        "prompt_length",
        "has_pii",
        "metadata",
        "original_prompt",
        "redacted_prompt",
    )


@query(
    "masked_audit_rows",
    with_texts(*JUDGED)
    + " UNION ALL ".join(
        f"SELECT request_id, '{k}' AS guardrail_type, s_{k} AS status, "
        "CASE WHEN has_pii THEN redacted_text ELSE prompt END AS original_prompt "
        f"FROM judged WHERE contains(asked, '{k}')"
        for k in AUDIT_KINDS
    ),
)
def masked_audit_rows(spark, sf_dir):
    """No row holds raw personal data, whatever guardrails were asked for."""
    asked = _requests(spark, sf_dir).withColumn("timestamp", F.lit(X.AS_OF).cast("timestamp"))
    return policy.masked_audit_rows(asked).select("request_id", "guardrail_type", "status", "original_prompt")


@query(
    "input_check_result",
    with_texts(*JUDGED)
    + """SELECT request_id, overall_status = 'passed' AS passed, overall_status = 'blocked' AS blocked,
  contains(asked, 'pii_detection') AND has_pii AS has_pii,
  CASE WHEN contains(asked, 'pii_detection') THEN pii_types ELSE '' END AS pii_types,
  CASE WHEN overall_status = 'blocked' AND contains(asked, 'pii_detection') AND has_pii THEN redacted_text
       ELSE prompt END AS safe_prompt
FROM decided""",
)
def input_check_result(spark, sf_dir):
    view = policy.input_check_result(policy.decide(policy.score(_requests(spark, sf_dir))))
    return view.withColumn("pii_types", joined("pii_types")).drop("original_prompt")


OUTPUT = [sensitive_cte("o1", "texts"), f"o2 AS (SELECT *, {toxic('prompt')} AS is_toxic FROM o1)"]


def _responses(spark, sf_dir):
    return texts(spark, sf_dir).selectExpr(
        "request_id", "'agent-1' AS agent_id", "prompt AS agent_response", "TIMESTAMP '2024-01-31 00:00:00' AS timestamp"
    )


@query(
    "check_output",
    with_texts(*OUTPUT)
    + f"""SELECT request_id, sensitive_types = '' AS is_safe, sensitive_types <> '' AS blocked,
  sensitive_types AS violations,
  CASE WHEN sensitive_types <> '' THEN
    'Agent response requests sensitive data: ' || replace(sensitive_types, ',', ', ') END AS blocked_reason,
  CASE WHEN sensitive_types <> '' THEN '{policy.UNSAFE_RESPONSE}' END AS safe_response
FROM o2""",
)
def check_output(spark, sf_dir):
    out = policy.check_output(_responses(spark, sf_dir))
    return out.withColumn("violations", joined("violations")).drop("agent_id")


@query(
    "output_audit_rows",
    with_texts(*OUTPUT)
    + f"""SELECT request_id, 'output_guardrail' AS guardrail_type,
  CASE WHEN sensitive_types = '' THEN 'passed' ELSE 'blocked' END AS status,
  CAST(length(prompt) AS BIGINT) AS prompt_length, false AS has_pii,
  concat('{{"check_type":"output_guardrail","violations":', {_strings_json("sensitive_types")},
    ',"sensitive_types":', {_strings_json("sensitive_types")}, ',"toxicity_detected":',
    CASE WHEN is_toxic THEN 'true' ELSE 'false' END, '}}') AS metadata,
  CASE WHEN sensitive_types <> '' THEN substr(prompt, 1, 500) END AS redacted_prompt
FROM o2""",
)
def output_audit_rows(spark, sf_dir):
    rows = policy.output_audit_rows(policy.score_output(_responses(spark, sf_dir)))
    return rows.select(
        "request_id", "guardrail_type", "status", "prompt_length", "has_pii", "metadata", "redacted_prompt"
    )


# Turns of the conversations: a user message and the assistant reply that directly follows.
PAIRS = [
    X.DUCKDB["turns"],
    X.DUCKDB["messages"],
    """paired AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(content) OVER w END AS agent_response,
    CASE WHEN lead(role) OVER w = 'assistant' THEN lead(processing_time_ms) OVER w END AS response_ms
  FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY seq))""",
    """exchanges AS (SELECT session_id, turn_number, "timestamp", content AS user_message, agent_response, response_ms
  FROM paired WHERE role = 'user')""",
    pii_cte("e1", "exchanges", "user_message"),
    sensitive_cte("e2", "e1", "agent_response"),
]
PAIRS_SQL = "WITH " + ", ".join(PAIRS) + " "


def _exchanges(spark, sf_dir):
    return policy.pair_turns(X.messages(spark, sf_dir))


@query(
    "redact_and_pass",
    PAIRS_SQL
    + f"""SELECT session_id, turn_number, coalesce(redacted_text, user_message) AS safe_prompt,
  CASE WHEN coalesce(sensitive_types, '') <> '' THEN '{policy.APOLOGY}' ELSE agent_response END AS message,
  false AS was_input_blocked, coalesce(sensitive_types, '') <> '' AS was_output_blocked, pii_types AS input_pii_detected,
  coalesce(sensitive_types, '') AS output_violations
FROM e2""",
)
def redact_and_pass(spark, sf_dir):
    return policy.redact_and_pass(_exchanges(spark, sf_dir)).select(
        "session_id",
        "turn_number",
        "safe_prompt",
        "message",
        "was_input_blocked",
        "was_output_blocked",
        joined("input_pii_detected").alias("input_pii_detected"),
        joined("output_violations").alias("output_violations"),
    )


@query(
    "redact_and_pass_audit",
    PAIRS_SQL
    + f"""SELECT session_id, 'pii_detection' AS guardrail_type, 'flagged' AS status,
  CAST(length(user_message) AS BIGINT) AS prompt_length, true AS has_pii, user_message AS original_prompt,
  redacted_text AS redacted_prompt, {sql_second('"timestamp"')} AS at
FROM e2 WHERE has_pii
UNION ALL
SELECT session_id, 'sensitive_request', 'blocked', CAST(length(agent_response) AS BIGINT), false, user_message,
  substr(agent_response, 1, 500), {sql_second('"timestamp"')}
FROM e2 WHERE sensitive_types <> ''""",
)
def redact_and_pass_audit(spark, sf_dir):
    rows = policy.redact_and_pass_audit(policy.redact_and_pass(_exchanges(spark, sf_dir)))
    return rows.select(
        "session_id",
        "guardrail_type",
        "status",
        "prompt_length",
        "has_pii",
        "original_prompt",
        "redacted_prompt",
        second("timestamp").alias("at"),
    )


@query(
    "block_and_log",
    PAIRS_SQL
    + f"""SELECT session_id, turn_number, 'user' AS role, user_message AS content, has_pii, has_pii AS was_blocked,
  NULL::DOUBLE AS processing_time_ms FROM e2
UNION ALL
SELECT session_id, turn_number, 'assistant', CASE WHEN has_pii THEN '{policy.BLOCKED_INPUT_REPLY}'
    WHEN sensitive_types <> '' THEN '{policy.BLOCKED_OUTPUT_REPLY}' ELSE agent_response END,
  false, has_pii OR coalesce(sensitive_types, '') <> '', CASE WHEN NOT has_pii THEN response_ms END
FROM e2 WHERE has_pii OR agent_response IS NOT NULL""",
)
def block_and_log(spark, sf_dir):
    return policy.block_and_log(_exchanges(spark, sf_dir)).drop("agent_id", "timestamp")


_SCREENED = [
    X.DUCKDB["prompts"],
    pii_cte("s1", "prompts"),
]


@query(
    "screened_departments",
    "WITH "
    + ", ".join(_SCREENED)
    + """, rows AS (SELECT department, has_pii AND k = 0 AS has_pii, agent_id FROM s1, range(4) r(k)
  WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY)
SELECT coalesce(department, 'unknown') AS department, count(*) AS total_requests, 0::BIGINT AS unique_users,
  count(DISTINCT agent_id) AS unique_agents, count(*) FILTER (has_pii) AS pii_incidents,
  round(count(*) FILTER (has_pii) * 100.0::DOUBLE / count(*), 2) AS pii_rate
FROM rows GROUP BY 1""",
)
def screened_departments(spark, sf_dir):
    """The flagship: documents -> four guardrails -> audit rows -> department leaderboard."""
    asked = screening.ask_for(X.prompts(spark, sf_dir), screening.ALL_GUARDRAILS)
    return screening.screened_departments(asked, X.AS_OF)


@query(
    "screened_pii_types",
    "WITH "
    + ", ".join(_SCREENED)
    + """SELECT pii_type, count(*) AS occurrences FROM
  (SELECT unnest(string_split(pii_types, ',')) AS pii_type FROM s1 WHERE has_pii
   AND "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) GROUP BY 1""",
)
def screened_pii_types(spark, sf_dir):
    asked = screening.ask_for(X.prompts(spark, sf_dir), screening.ALL_GUARDRAILS)
    return screening.screened_pii_types(asked, X.AS_OF)
