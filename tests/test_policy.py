"""Decisions, audit rows and the two conversation policies."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from govlens.operators import policy
from govlens.plans.screening import screen

ALL = ["pii_detection", "toxicity", "prompt_injection", "sensitive_request"]
NOW = datetime(2024, 1, 2, 3, 4, 5)


def requests(spark, *rows):
    data = [(f"r{i}", prompt, guardrails, NOW) for i, (prompt, guardrails) in enumerate(rows)]
    return spark.createDataFrame(
        data, "request_id string, prompt string, guardrails array<string>, timestamp timestamp"
    )


def test_check_input_folds_to_the_most_severe_status(spark):
    found = (
        policy.check_input(
            requests(
                spark,
                ("fine", ALL),
                ("you idiot", ALL),
                ("you idiot, my SSN is 123-45-6789", ALL),
                ("your pin", ["sensitive_request"]),
                ("my SSN is 123-45-6789", ["toxicity"]),
                ("my SSN is 123-45-6789", None),
            )
        )
        .orderBy("request_id")
        .collect()
    )
    assert [r.overall_status for r in found] == ["passed", "flagged", "blocked", "blocked", "passed", "blocked"]
    assert [r.safe_prompt for r in found] == [
        None, None, "you idiot, my SSN is [REDACTED_SSN]", "your pin", None, "my SSN is [REDACTED_SSN]",
    ]
    assert [x.guardrail_type for x in found[0].results] == ALL
    assert found[0].agent_id == "default"
    assert [x.guardrail_type for x in found[5].results] == ["pii_detection"]


def test_results_follow_the_requested_order_and_repeat(spark):
    asked = ["hallucination", "toxicity", "pii_detection", "toxicity"]
    row = policy.check_input(requests(spark, ("you idiot a@b.com", asked))).collect()[0]
    assert [(x.guardrail_type, x.status, x.confidence) for x in row.results] == [
        ("hallucination", "passed", 0.0),
        ("toxicity", "flagged", 0.5),
        ("pii_detection", "blocked", 0.7),
        ("toxicity", "flagged", 0.5),
    ]
    assert "coming soon" in json.loads(row.results[0].details)["message"]
    details = json.loads(row.results[2].details)
    assert details["pii_types"] == ["email"] and details["has_pii"] is True


def test_audit_rows(spark):
    scored = policy.score(requests(spark, ("you idiot a@b.com \U0001f600", [*ALL, "hallucination"]), ("x", ["toxicity"])))
    found = policy.audit_rows(scored).collect()
    assert len(found) == 5
    by_kind = {r.guardrail_type: r for r in found if r.request_id == "r0"}
    assert by_kind["pii_detection"].has_pii and not by_kind["toxicity"].has_pii
    assert by_kind["pii_detection"].prompt_length == 19
    assert by_kind["pii_detection"].redacted_prompt == "you idiot [REDACTED_EMAIL] \U0001f600"
    assert by_kind["toxicity"].redacted_prompt is None
    assert json.loads(by_kind["pii_detection"].metadata) == {"pii_types": ["email"], "confidence": 0.7}
    assert json.loads(by_kind["toxicity"].metadata) == {
        "is_toxic": True, "toxicity_score": 0.5, "categories": ["potential_toxicity"],
    }
    assert set(json.loads(by_kind["prompt_injection"].metadata)) == {
        "is_injection", "injection_score", "injection_types",
    }


def test_masked_audit_rows_hold_no_raw_text(spark):
    """Neither in rows about other guardrails, nor where nobody asked for personal data."""
    asked = requests(spark, ("you idiot a@b.com", ALL), ("My SSN is 123-45-6789, you idiot", ["toxicity"]), ("fine", ALL))
    found = policy.masked_audit_rows(asked).collect()
    assert len(found) == 2 * len(ALL) + 1
    for r in found:
        assert "a@b.com" not in str(r) and "123-45-6789" not in str(r)
    assert {r.original_prompt for r in found} == {"you idiot [REDACTED_EMAIL]", "My SSN is [REDACTED_SSN], you idiot", "fine"}


def test_unknown_guardrails_do_not_pass(spark):
    found = policy.check_input(requests(spark, ("x", ["pii"]), ("x", []), ("x", ["toxicity", None]), ("x", ALL)))
    statuses = [r.overall_status for r in found.orderBy("request_id").collect()]
    assert statuses == ["blocked", "blocked", "blocked", "passed"]


def test_every_request_is_audited_or_rejected(spark):
    asked = requests(spark, ("My SSN is 123-45-6789", ["pii"]), ("x", []), (None, ALL), ("x", ["toxicity"]), ("y", None))
    audit, rejected = screen(asked)
    assert {r.request_id for r in audit.collect()} == {"r3", "r4"}
    assert {r.request_id: r.violations for r in rejected.collect()} == {
        "r0": ["invalid:guardrails"],
        "r1": ["invalid:guardrails"],
        "r2": ["missing:prompt"],
    }


def test_client_view(spark):
    decided = policy.decide(
        policy.score(requests(spark, ("a@b.com", ["toxicity"]), ("a@b.com", ALL), ("kill", ["toxicity"])))
    )
    found = policy.input_check_result(decided).orderBy("request_id").collect()
    assert [(r.passed, r.blocked, r.has_pii, r.pii_types, r.safe_prompt) for r in found] == [
        (True, False, False, [], "a@b.com"),
        (False, True, True, ["email"], "[REDACTED_EMAIL]"),
        (False, False, False, [], "kill"),
    ]


def test_check_output(spark):
    rows = spark.createDataFrame(
        [("a", "x", "Please provide your cvv and password"), ("b", "x", "I kill"), ("c", "x", "ok")],
        "request_id string, agent_id string, agent_response string",
    )
    found = {r.request_id: r for r in policy.check_output(rows).collect()}
    assert found["a"].violations == ["credit_card", "password"]
    assert found["a"].blocked_reason == "Agent response requests sensitive data: credit_card, password"
    assert found["a"].safe_response == policy.UNSAFE_RESPONSE
    assert found["b"].is_safe and found["b"].blocked_reason is None and found["b"].safe_response is None
    assert found["c"].is_safe and found["c"].violations == []


def test_toxic_output_from_a_stored_verdict_blocks(spark):
    rows = spark.createDataFrame([("a",)], "request_id string").select(
        "*",
        F.struct(
            F.lit(True).alias("requests_sensitive_data"),
            F.array(F.lit("ssn")).alias("sensitive_types"),
            F.lit("").alias("details"),
        ).alias("sensitive"),
        F.struct(
            F.lit(True).alias("is_toxic"),
            F.lit(0.7).alias("toxicity_score"),
            F.array(F.lit("threat"), F.lit("hate")).alias("categories"),
        ).alias("toxicity"),
    )
    row = policy.judge_output(rows).collect()[0]
    assert row.violations == ["ssn", "toxic:threat", "toxic:hate"]
    assert row.blocked_reason == (
        "Agent response requests sensitive data: ssn; Toxic content detected: threat, hate"
    )


def test_output_audit_rows_keep_a_preview_of_unsafe_responses(spark):
    long = "your password " + "y" * 600
    rows = spark.createDataFrame(
        [("a", "x", long, "q", NOW), ("b", "x", "fine", None, NOW)],
        "request_id string, agent_id string, agent_response string, original_prompt string, timestamp timestamp",
    )
    found = {r.request_id: r for r in policy.output_audit_rows(policy.score_output(rows)).collect()}
    assert found["a"].status == "blocked" and found["a"].redacted_prompt == long[:500]
    assert found["a"].prompt_length == len(long) and found["a"].original_prompt == "q"
    assert json.loads(found["a"].metadata) == {
        "check_type": "output_guardrail", "violations": ["password"], "sensitive_types": ["password"],
        "toxicity_detected": False,
    }
    assert found["b"].status == "passed" and found["b"].redacted_prompt is None


@pytest.fixture(scope="module")
def exchanges(spark):
    messages = [
        ("s", 1, 0, "user", "My SSN is 123-45-6789", None),
        ("s", 1, 1, "assistant", "Noted", 5.0),
        ("s", 2, 2, "user", "hello", None),
        ("s", 2, 3, "assistant", "Please give your credit card number", 6.0),
        ("s", 2, 4, "assistant", "second answer", 7.0),
        ("s", 3, 5, "user", "unanswered", None),
        ("s", 4, 6, "user", "bye", None),
        ("s", 4, 7, "assistant", "Goodbye", 8.0),
    ]
    rows = spark.createDataFrame(
        messages,
        "session_id string, turn_number long, seq long, role string, content string, processing_time_ms double",
    ).withColumns({"agent_id": F.lit("a"), "user_id": F.lit("u"), "timestamp": F.lit(NOW)})
    return policy.pair_turns(rows)


def test_pair_turns(exchanges):
    found = {r.turn_number: r for r in exchanges.collect()}
    assert {n: r.agent_response for n, r in found.items()} == {
        1: "Noted", 2: "Please give your credit card number", 3: None, 4: "Goodbye",
    }
    assert found[1].processing_time_ms == 5.0


def test_redact_and_pass(exchanges):
    handled = policy.redact_and_pass(exchanges)
    found = {r.turn_number: r for r in handled.collect()}
    assert found[1].safe_prompt == "My SSN is [REDACTED_SSN]" and found[1].message == "Noted"
    assert found[2].message == policy.APOLOGY and found[2].was_output_blocked
    assert not any(r.was_input_blocked for r in found.values())
    audit = {r.guardrail_type: r for r in policy.redact_and_pass_audit(handled).collect()}
    assert set(audit) == {"pii_detection", "sensitive_request"}
    assert audit["pii_detection"].status == "flagged" and audit["pii_detection"].department == "support"
    assert json.loads(audit["sensitive_request"].metadata)["violations"] == ["credit_card"]
    history = policy.redact_and_pass_messages(handled).collect()
    assert {(r.turn_number, r.role): r.was_blocked for r in history}[(2, "assistant")]
    assert len(history) == 7


def test_block_and_log(exchanges):
    found = {(r.turn_number, r.role): r for r in policy.block_and_log(exchanges).collect()}
    assert found[(1, "user")].was_blocked and found[(1, "user")].has_pii
    assert found[(1, "assistant")].content == policy.BLOCKED_INPUT_REPLY
    assert found[(1, "assistant")].processing_time_ms is None
    assert found[(2, "assistant")].content == policy.BLOCKED_OUTPUT_REPLY
    assert found[(2, "assistant")].processing_time_ms == 6.0 and found[(2, "assistant")].was_blocked
    assert found[(4, "assistant")].content == "Goodbye" and not found[(4, "assistant")].was_blocked
    assert (3, "assistant") not in found and len(found) == 7
