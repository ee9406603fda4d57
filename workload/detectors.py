"""Detector queries: G1-G14, G20, G21."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.functions import columns as C
from govlens.functions import detectors as D
from govlens.functions import patterns as P
from govlens.operators import guardrails as G
from govlens.sources import fixtures as X
from workload.registry import joined, query, sql_list
from workload.texts import injection_cte, matches, pii_cte, pii_flag, sensitive_cte, texts, toxic, with_texts


def _register_pii(kind: str, pattern: str, replacement: str) -> None:
    sql = with_texts() + (
        f"SELECT request_id, {pii_flag(kind, 'prompt')} AS hit, "
        f"regexp_replace(prompt, '{pattern}', '{replacement}', 'g') AS redacted FROM texts"
    )

    @query(f"pii_{'ip' if kind == 'ip_address' else kind}", sql)
    def run(spark, sf_dir):
        source = F.col("prompt")
        flagged = texts(spark, sf_dir).withColumn("hit", D.pii_flags(source)[kind])
        return flagged.select("request_id", "hit", D.redact(source, kind, F.col("hit")).alias("redacted"))


for _kind, _pattern, _replacement in P.PII_PATTERNS:
    _register_pii(_kind, _pattern, _replacement)


@query(
    "detect_pii",
    with_texts(pii_cte("found", "texts"))
    + f"""SELECT request_id, has_pii, pii_types, redacted_text,
       CASE WHEN has_pii THEN '{P.RULE_MATCH["pii"]}' ELSE '{P.NO_MATCH["pii"]}' END AS details,
       CASE WHEN has_pii THEN {P.PII_CONFIDENCE}::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM found""",
)
def detect_pii(spark, sf_dir):
    return G.detect_pii(texts(spark, sf_dir)).select(
        "request_id",
        "pii.has_pii",
        joined("pii.pii_types").alias("pii_types"),
        "pii.redacted_text",
        "pii.details",
        "pii.confidence",
    )


def _register_sensitive(kind: str, name: str, group: list[str]) -> None:
    any_of = " OR ".join(matches("lower(prompt)", p) for p in group)

    @query(f"sensitive_{name}", with_texts() + f"SELECT request_id, ({any_of}) AS hit FROM texts")
    def run(spark, sf_dir):
        lowered = texts(spark, sf_dir).withColumn("lowered", F.lower("prompt"))
        return lowered.select("request_id", D.sensitive_flags(F.col("lowered"))[kind].alias("hit"))


for _kind, _group in P.SENSITIVE_PATTERNS:
    _register_sensitive(_kind, "bank" if _kind == "bank_account" else _kind, _group)


@query(
    "detect_sensitive_request",
    with_texts(sensitive_cte("found", "texts"))
    + f"""SELECT request_id, sensitive_types <> '' AS requests_sensitive_data, sensitive_types,
       CASE WHEN sensitive_types <> '' THEN '{P.SENSITIVE_MATCH_PREFIX}' || replace(sensitive_types, ',', ', ')
            ELSE '{P.NO_MATCH["sensitive"]}' END AS details
FROM found""",
)
def detect_sensitive_request(spark, sf_dir):
    return G.detect_sensitive_request(texts(spark, sf_dir)).select(
        "request_id",
        "sensitive.requests_sensitive_data",
        joined("sensitive.sensitive_types").alias("sensitive_types"),
        "sensitive.details",
    )


@query(
    "injection_patterns",
    with_texts()
    + "SELECT pattern, type, count(*) AS hits FROM ("
    + " UNION ALL ".join(
        f"SELECT request_id, '{pattern}' AS pattern, '{kind}' AS type FROM texts "
        f"WHERE {matches('lower(prompt)', pattern)}"
        for pattern, kind in P.INJECTION_PATTERNS
    )
    + ") GROUP BY pattern, type",
)
def injection_patterns(spark, sf_dir):
    """Which patterns occur, and on how many texts."""
    return G.pattern_counts(texts(spark, sf_dir))


@query(
    "detect_injection",
    with_texts(injection_cte("found", "texts"))
    + f"""SELECT request_id, n_types > 0 AS is_injection, least(n_types * 0.3::DOUBLE, 1.0::DOUBLE) AS injection_score,
       injection_types, suspicious_patterns,
       CASE WHEN n_types > 0 THEN '{P.RULE_MATCH["injection"]}' ELSE '{P.NO_MATCH["injection"]}' END AS details
FROM found""",
)
def detect_injection(spark, sf_dir):
    return G.detect_injection(texts(spark, sf_dir)).select(
        "request_id",
        "injection.is_injection",
        "injection.injection_score",
        joined("injection.injection_types").alias("injection_types"),
        F.array_join("injection.suspicious_patterns", " ~ ").alias("suspicious_patterns"),
        "injection.details",
    )


@query(
    "detect_toxicity",
    with_texts()
    + f"""SELECT request_id, {toxic("prompt")} AS is_toxic,
       CASE WHEN {toxic("prompt")} THEN {P.TOXIC_SCORE}::DOUBLE ELSE 0.0::DOUBLE END AS toxicity_score,
       {sql_list((P.TOXIC_CATEGORY, toxic("prompt")))} AS categories,
       CASE WHEN {toxic("prompt")} THEN '{P.RULE_MATCH["toxicity"]}' ELSE '{P.NO_MATCH["toxicity"]}' END AS details
FROM texts""",
)
def detect_toxicity(spark, sf_dir):
    return G.detect_toxicity(texts(spark, sf_dir)).select(
        "request_id",
        "toxicity.is_toxic",
        "toxicity.toxicity_score",
        joined("toxicity.categories").alias("categories"),
        "toxicity.details",
    )


@query(
    "token_estimate",
    with_texts() + "SELECT request_id, CAST(length(prompt) // 4 AS BIGINT) AS tokens FROM texts",
)
def token_estimate(spark, sf_dir):
    return texts(spark, sf_dir).select("request_id", C.token_estimate(F.col("prompt")).alias("tokens"))


@query(
    "token_cost",
    """WITH u AS (SELECT event_id, 20 + event_id % 400 AS prompt_tokens, 5 + user_id % 60 AS completion_tokens
           FROM events)
SELECT event_id, round(prompt_tokens / 1000000.0::DOUBLE * 0.075::DOUBLE
       + completion_tokens / 1000000.0::DOUBLE * 0.30::DOUBLE, 12) AS cost FROM u""",
)
def token_cost(spark, sf_dir):
    used = X.raw(spark, sf_dir, "events").selectExpr(
        "event_id", "20 + event_id % 400 AS prompt_tokens", "5 + user_id % 60 AS completion_tokens"
    )
    return used.select(
        "event_id", F.round(C.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")), 12).alias("cost")
    )
