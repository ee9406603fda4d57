"""Stored model answers: which are used and which fall back to the rules."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from govlens.operators import verdicts as V
from govlens.operators.guardrails import VERDICT
from govlens.operators.policy import decide

FENCE = "```"


def pii(spark, answer, prompt="plain"):
    requests = spark.createDataFrame([("r", prompt)], "request_id string, prompt string")
    answers = spark.createDataFrame([("r", answer)], "request_id string, answer string")
    return V.ingest_pii(requests, answers).collect()[0].pii


def test_fenced_answer_defaults_confidence(spark):
    found = pii(spark, f'{FENCE}json\n{{"has_pii": true, "pii_types": ["email"]}}\n{FENCE}')
    assert (found.has_pii, found.pii_types, found.confidence, found.details) == (True, ["email"], 1.0, None)
    found = pii(spark, f'{FENCE}\n{{"has_pii": false}}\n{FENCE} more', "a@b.com")
    assert (found.has_pii, found.confidence) == (False, 0.0)


FALLBACKS = [
    "oops",
    "",
    None,
    "[]",
    "3",
    '{"has_pii": true} trailing',
    '{"has_pii": true}, {"has_pii": true}',
    '{"has_pii": true}]',
    '{"has_pii": true}}',
    '{"has_pii": null}',
    '{"has_pii": "maybe"}',
    '{"has_pii": 2}',
    '{"has_pii": true, "confidence": 1.7}',
    '{"has_pii": true, "confidence": -0.1}',
    '{"has_pii": true, "confidence": null}',
    '{"has_pii": true, "confidence": "high"}',
    '{"has_pii": true, "pii_types": null}',
    '{"has_pii": true, "pii_types": ["a", null]}',
    '{"has_pii": true, "pii_types": ["a", 1]}',
    '{"has_pii": true, "pii_types": "email"}',
    '{"has_pii": true, "redacted_text": 5}',
]


@pytest.mark.parametrize("answer", FALLBACKS)
def test_unusable_answers_fall_back(spark, answer):
    found = pii(spark, answer, "mail a@b.com")
    assert (found.pii_types, found.redacted_text, found.confidence) == (["email"], "mail [REDACTED_EMAIL]", 0.7)


ACCEPTED = [
    ('{"has_pii": "yes"}', True, 1.0),
    ('{"has_pii": 0}', False, 0.0),
    ('{"has_pii": 1, "confidence": "0.5"}', True, 0.5),
    ('{"confidence": 1}', False, 1.0),
    ("{}", False, 0.0),
    ('  {"has_pii": true, "redacted_text": null, "other": [1]} ', True, 1.0),
]


@pytest.mark.parametrize(("answer", "has_pii", "confidence"), ACCEPTED)
def test_usable_answers(spark, answer, has_pii, confidence):
    found = pii(spark, answer, "mail a@b.com")
    assert (found.has_pii, found.confidence) == (has_pii, confidence)
    assert found.pii_types == []


def test_request_without_answer_uses_rules(spark):
    requests = spark.createDataFrame([("r", "a@b.com"), ("s", "x")], "request_id string, prompt string")
    answers = spark.createDataFrame([("s", '{"has_pii": true}')], "request_id string, answer string")
    found = {r.request_id: r.pii for r in V.ingest_pii(requests, answers).collect()}
    assert found["r"].pii_types == ["email"] and found["r"].confidence == 0.7
    assert found["s"].has_pii and found["s"].confidence == 1.0


def test_toxicity_answer_and_signal(spark):
    requests = spark.createDataFrame(
        [("a", "I hate it", None), ("b", "I hate it", "SAFETY"), ("c", "I hate it", None)],
        "request_id string, prompt string, block string",
    )
    score = '{"is_toxic": true, "toxicity_score": 0.75, "category_scores": {"threat": 1, "b": 0.5}}'
    answers = spark.createDataFrame(
        [("a", score), ("b", score), ("c", '{"category_scores": {"x": "y"}}')], "request_id string, answer string"
    )
    signal = V.safety_signal(F.col("block"), F.lit(None), F.lit(None).cast("string"))
    found = {r.request_id: r.toxicity for r in V.ingest_toxicity(requests, answers, signal=signal).collect()}
    assert found["a"].toxicity_score == 0.75 and found["a"].category_scores == {"threat": 1.0, "b": 0.5}
    assert found["b"].toxicity_score == 0.8 and found["b"].categories == ["content_policy_violation"]
    assert found["c"].toxicity_score == 0.5


def test_safety_signal(spark):
    def signal(block, ratings, error):
        rows = spark.createDataFrame(
            [(block, ratings, error)],
            "block string, ratings array<struct<category:string,probability:string>>, error string",
        )
        return rows.select(V.safety_signal(F.col("block"), F.col("ratings"), F.col("error"))).collect()[0][0]

    found = signal(
        "OTHER",
        [("H.HATE", "P.HIGH"), ("H.SEX", "P.LOW"), ("H.HATE", "P.MEDIUM"), ("H.HARASS", "P.MEDIUM")],
        None,
    )
    assert found.categories == ["hate", "hate", "harass"]
    assert found.category_scores == {"hate": 0.6, "harass": 0.6}
    assert found.details == "Content blocked by safety filters: OTHER"
    assert signal(None, None, "violates SAFETY rules").toxicity_score == 0.9
    assert signal(None, [("H.HATE", "P.HIGH")], "timeout") is None
    assert signal("", None, None) is None


def test_token_usage(spark):
    usage = spark.createDataFrame(
        [("a", 1_000_000, 0, 1_000_000), ("a", 0, 1_000_000, 1_000_000), ("b", None, None, None), ("c", 0, 0, 0)],
        "request_id string, prompt_tokens long, completion_tokens long, total_tokens long",
    )
    found = {r.request_id: r.token_usage for r in V.token_usage(usage).collect()}
    assert found["a"].total_tokens == 2_000_000 and found["a"].estimated_cost == pytest.approx(0.375)
    assert found["b"] is None and found["c"] is None


def test_answers_can_be_generated_by_json_dumps(spark):
    answer = json.dumps({"has_pii": True, "pii_types": ["café"], "confidence": 0.25, "details": "x \"y\""})
    found = pii(spark, answer)
    assert (found.pii_types, found.confidence, found.details) == (["café"], 0.25, 'x "y"')


def test_decisions_on_ingested_verdicts(spark):
    """Four stored answers per request, then the same policy as on rule verdicts."""
    requests = spark.createDataFrame(
        [("a", "fine text"), ("b", "mail a@b.com")], "request_id string, prompt string"
    ).withColumn("guardrails", F.array(*[F.lit(k) for k in VERDICT]))
    answers = {
        V.ingest_pii: [("a", '{"has_pii": true, "redacted_text": ""}'), ("b", "oops")],
        V.ingest_toxicity: [("a", '{"is_toxic": true, "toxicity_score": 0.7}'), ("b", "{}")],
        V.ingest_injection: [("a", '{"is_injection": true, "injection_score": 0.69}'), ("b", "{}")],
        V.ingest_sensitive: [("a", "{}"), ("b", "{}")],
    }
    out = requests
    for ingest, rows in answers.items():
        out = ingest(out, spark.createDataFrame(rows, "request_id string, answer string"))
    found = {r.request_id: r for r in decide(out.withColumn("agent_id", F.lit("x"))).collect()}
    assert {x.guardrail_type: x.status for x in found["a"].results} == {
        "pii_detection": "blocked",
        "sensitive_request": "passed",
        "toxicity": "blocked",
        "prompt_injection": "flagged",
    }
    assert found["a"].safe_prompt == "fine text"
    assert found["b"].overall_status == "blocked" and found["b"].safe_prompt == "mail [REDACTED_EMAIL]"


def test_repeated_answers_count_once(spark):
    """The latest answer counts; a request stays one row."""
    requests = spark.createDataFrame([("r", "plain"), ("s", "plain")], "request_id string, prompt string")
    yes, no = '{"has_pii": true, "pii_types": ["email"]}', '{"has_pii": false}'
    rows = [("r", yes, 2), ("r", no, 1), ("s", yes, 1), ("s", no, 2), ("s", no, 2)]
    answers = spark.createDataFrame(rows, "request_id string, answer string, timestamp long")
    found = V.ingest_pii(requests, answers).orderBy("request_id").collect()
    assert [(r.request_id, r.pii.has_pii) for r in found] == [("r", True), ("s", False)]
    untimed = V.ingest_pii(requests, answers.drop("timestamp"))
    assert untimed.count() == 2
