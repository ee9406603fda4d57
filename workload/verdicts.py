"""Queries over stored model answers: G15-G19, G22."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions import columns as C
from govlens.functions import patterns as P
from govlens.operators import verdicts as V
from govlens.sources import fixtures as X
from workload.registry import joined, query
from workload.texts import injection_cte, pii_cte, sensitive_cte, toxic

FENCE = "```"

# Stored answers, derived per document: fenced with and without a language, bare, out of range, malformed, missing.
PII_ANSWER = (
    "CASE doc_id % 7 "
    f"WHEN 0 THEN concat('{FENCE}json ', '{{\"has_pii\": true, \"pii_types\": [\"email\"], \"details\": \"d', doc_id, "
    f"'\"}} {FENCE} done') "
    f"WHEN 1 THEN '{FENCE} {{\"has_pii\": false}} {FENCE} trailing text' "
    "WHEN 2 THEN '{\"has_pii\": true, \"confidence\": 1.7}' "
    "WHEN 3 THEN 'oops' "
    "WHEN 4 THEN '{\"has_pii\": true, \"pii_types\": [\"name\", \"dob\"], \"redacted_text\": \"x\", \"confidence\": 0.25}' "
    "WHEN 5 THEN '{\"has_pii\": null}' END"
)
TOXICITY_ANSWER = (
    "CASE doc_id % 5 "
    f"WHEN 0 THEN '{FENCE}json {{\"is_toxic\": true, \"toxicity_score\": 0.9, \"categories\": [\"threat\"]}} {FENCE}' "
    "WHEN 1 THEN '{}' "
    "WHEN 2 THEN '{\"is_toxic\": true, \"toxicity_score\": -1}' "
    "WHEN 3 THEN '{\"is_toxic\": true' END"
)
INJECTION_ANSWER = (
    "CASE doc_id % 4 "
    "WHEN 0 THEN '{\"is_injection\": true, \"injection_score\": 0.75, \"injection_types\": [\"encoding_attack\"]}' "
    "WHEN 1 THEN '{\"is_injection\": false}' "
    "WHEN 2 THEN '{\"is_injection\": true, \"injection_types\": \"jailbreak\"}' END"
)
SENSITIVE_ANSWER = (
    "CASE doc_id % 4 "
    "WHEN 0 THEN '{\"requests_sensitive_data\": true, \"sensitive_types\": [\"cvv\"], \"details\": \"asks\"}' "
    "WHEN 1 THEN '{}' "
    "WHEN 2 THEN '[1]' END"
)


def _answers(spark, sf_dir, expression):
    return X.raw(spark, sf_dir, "documents").selectExpr("concat('doc-', doc_id) AS request_id", f"{expression} AS answer")


def _with(expression: str, *more: str) -> str:
    answers = f"answers AS (SELECT concat('doc-', doc_id) AS request_id, doc_id, {expression} AS answer FROM documents)"
    return "WITH " + ", ".join([X.DUCKDB["prompts"], answers, *more]) + " "


@query(
    "strip_code_fence",
    _with(PII_ANSWER)
    + f"""SELECT request_id, trim(CASE
  WHEN contains(answer, '{FENCE}json') THEN split_part(split_part(answer, '{FENCE}json', 2), '{FENCE}', 1)
  WHEN contains(answer, '{FENCE}') THEN split_part(answer, '{FENCE}', 2) ELSE answer END) AS body
FROM answers""",
)
def strip_code_fence(spark, sf_dir):
    answers = _answers(spark, sf_dir, PII_ANSWER)
    return answers.select("request_id", C.strip_code_fence(F.col("answer")).alias("body"))


@query(
    "ingest_pii_verdict",
    _with(PII_ANSWER, pii_cte("rules", "prompts"))
    + f"""SELECT r.request_id,
  CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true ELSE has_pii END AS has_pii,
  CASE doc_id % 7 WHEN 0 THEN 'email' WHEN 1 THEN '' WHEN 4 THEN 'name,dob' ELSE pii_types END AS pii_types,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 4 THEN 'x' ELSE redacted_text END AS redacted_text,
  CASE doc_id % 7 WHEN 0 THEN concat('d', doc_id) WHEN 1 THEN NULL WHEN 4 THEN NULL
    ELSE CASE WHEN has_pii THEN '{P.RULE_MATCH["pii"]}' ELSE '{P.NO_MATCH["pii"]}' END END AS details,
  CAST(CASE doc_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 4 THEN 0.25
    ELSE CASE WHEN has_pii THEN 0.7 ELSE 0.0 END END AS DOUBLE) AS confidence
FROM rules r JOIN answers a ON r.request_id = a.request_id""",
)
def ingest_pii_verdict(spark, sf_dir):
    out = V.ingest_pii(X.prompts(spark, sf_dir), _answers(spark, sf_dir, PII_ANSWER))
    return out.select(
        "request_id",
        "pii.has_pii",
        joined("pii.pii_types").alias("pii_types"),
        "pii.redacted_text",
        "pii.details",
        "pii.confidence",
    )


@query(
    "ingest_toxicity_verdict",
    _with(TOXICITY_ANSWER)
    + f"""SELECT p.request_id,
  CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE {toxic("prompt")} END AS is_toxic,
  CAST(CASE doc_id % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.0
    ELSE CASE WHEN {toxic("prompt")} THEN 0.5 ELSE 0.0 END END AS DOUBLE) AS toxicity_score,
  CASE doc_id % 5 WHEN 0 THEN 'threat' WHEN 1 THEN ''
    ELSE CASE WHEN {toxic("prompt")} THEN '{P.TOXIC_CATEGORY}' ELSE '' END END AS categories
FROM prompts p JOIN answers a ON p.request_id = a.request_id""",
)
def ingest_toxicity_verdict(spark, sf_dir):
    out = V.ingest_toxicity(X.prompts(spark, sf_dir), _answers(spark, sf_dir, TOXICITY_ANSWER))
    return out.select(
        "request_id",
        "toxicity.is_toxic",
        "toxicity.toxicity_score",
        joined("toxicity.categories").alias("categories"),
    )


@query(
    "ingest_injection_verdict",
    _with(INJECTION_ANSWER, injection_cte("rules", "prompts"))
    + """SELECT r.request_id,
  CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE n_types > 0 END AS is_injection,
  CAST(CASE doc_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.0 ELSE least(n_types * 0.3, 1.0) END AS DOUBLE)
    AS injection_score,
  CASE doc_id % 4 WHEN 0 THEN 'encoding_attack' WHEN 1 THEN '' ELSE injection_types END AS injection_types
FROM rules r JOIN answers a ON r.request_id = a.request_id""",
)
def ingest_injection_verdict(spark, sf_dir):
    out = V.ingest_injection(X.prompts(spark, sf_dir), _answers(spark, sf_dir, INJECTION_ANSWER))
    return out.select(
        "request_id",
        "injection.is_injection",
        "injection.injection_score",
        joined("injection.injection_types").alias("injection_types"),
    )


@query(
    "ingest_sensitive_verdict",
    _with(SENSITIVE_ANSWER, sensitive_cte("rules", "prompts"))
    + f"""SELECT r.request_id,
  CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE sensitive_types <> '' END AS requests_sensitive_data,
  CASE doc_id % 4 WHEN 0 THEN 'cvv' WHEN 1 THEN '' ELSE sensitive_types END AS sensitive_types,
  CASE doc_id % 4 WHEN 0 THEN 'asks' WHEN 1 THEN NULL ELSE
    CASE WHEN sensitive_types <> '' THEN '{P.SENSITIVE_MATCH_PREFIX}' || replace(sensitive_types, ',', ', ')
         ELSE '{P.NO_MATCH["sensitive"]}' END END AS details
FROM rules r JOIN answers a ON r.request_id = a.request_id""",
)
def ingest_sensitive_verdict(spark, sf_dir):
    out = V.ingest_sensitive(X.prompts(spark, sf_dir), _answers(spark, sf_dir, SENSITIVE_ANSWER))
    return out.select(
        "request_id",
        "sensitive.requests_sensitive_data",
        joined("sensitive.sensitive_types").alias("sensitive_types"),
        "sensitive.details",
    )


@query(
    "safety_ratings",
    """SELECT concat('doc-', doc_id) AS request_id,
  CASE WHEN toxic = 1 THEN 0.8::DOUBLE WHEN doc_id % 3 = 0 THEN 0.9::DOUBLE END AS toxicity_score,
  CASE WHEN toxic = 1 AND quality = 1 THEN 'harm_category_hate_speech,harm_category_harassment'
       WHEN toxic = 1 OR doc_id % 3 = 0 THEN 'content_policy_violation' END AS categories,
  CASE WHEN toxic = 1 THEN 'Content blocked by safety filters: SAFETY'
       WHEN doc_id % 3 = 0 THEN 'Content blocked by safety filters: Response was Blocked' END AS details,
  CASE WHEN toxic = 1 AND quality = 1 THEN 0.6::DOUBLE END AS harassment_score
FROM labels""",
)
def safety_ratings(spark, sf_dir):
    """A labelled toxic document counts as blocked by the provider; one in three others as refused with an error."""
    calls = X.raw(spark, sf_dir, "labels").selectExpr(
        "concat('doc-', doc_id) AS request_id",
        "CASE WHEN toxic = 1 THEN 'SAFETY' END AS block_reason",
        "CASE WHEN quality = 1 THEN array("
        "named_struct('category', 'HarmCategory.HARM_CATEGORY_HATE_SPEECH', 'probability', 'HarmProbability.HIGH'),"
        "named_struct('category', 'HarmCategory.HARM_CATEGORY_HARASSMENT', 'probability', 'HarmProbability.MEDIUM'),"
        "named_struct('category', 'HarmCategory.HARM_CATEGORY_DANGEROUS', 'probability', 'HarmProbability.LOW')) "
        "END AS ratings",
        "CASE WHEN doc_id % 3 = 0 THEN 'Response was Blocked' WHEN doc_id % 3 = 1 THEN 'timeout' END AS error",
    )
    signal = V.safety_signal(F.col("block_reason"), F.col("ratings"), F.col("error"))
    return calls.withColumn("v", signal).select(
        "request_id",
        "v.toxicity_score",
        joined("v.categories").alias("categories"),
        "v.details",
        F.try_element_at("v.category_scores", F.lit("harm_category_harassment")).alias("harassment_score"),
    )


USAGE = {
    "request_id": "concat('req-', event_id % 2500)",
    "prompt_tokens": "CASE WHEN event_type <> 'view' THEN event_id % 400 END",
    "completion_tokens": "CASE WHEN event_type <> 'view' THEN user_id % 60 END",
    "total_tokens": "CASE WHEN event_type <> 'view' THEN event_id % 400 + user_id % 60 END",
}


@query(
    "token_usage_rollup",
    "WITH "
    + X.cte("usage", USAGE, "events")
    + """, sums AS (SELECT request_id, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS p,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS c, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS t
  FROM usage GROUP BY request_id)
SELECT request_id, CASE WHEN t > 0 THEN p END AS prompt_tokens, CASE WHEN t > 0 THEN c END AS completion_tokens,
  CASE WHEN t > 0 THEN t END AS total_tokens,
  CASE WHEN t > 0 THEN round(p / 1000000.0::DOUBLE * 0.075::DOUBLE + c / 1000000.0::DOUBLE * 0.30::DOUBLE, 12) END
    AS estimated_cost
FROM sums""",
)
def token_usage_rollup(spark, sf_dir):
    usage = X.derive(X.raw(spark, sf_dir, "events"), USAGE)
    return V.token_usage(usage).select(
        "request_id",
        "token_usage.prompt_tokens",
        "token_usage.completion_tokens",
        "token_usage.total_tokens",
        F.round("token_usage.estimated_cost", 12).alias("estimated_cost"),
    )
