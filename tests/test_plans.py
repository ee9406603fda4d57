"""What the plans of the scanning jobs must look like."""

from __future__ import annotations

import pytest

from govlens.operators import policy
from govlens.operators.guardrails import detect, detect_pii
from govlens.plans import screening
from govlens.sources import fixtures as X

# Above this size the JVM leaves a method to its interpreter.
COMPILABLE = 8_000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def requests(spark, sf_dir):
    rows = X.derive(X.raw(spark, sf_dir, "documents"), X.PROMPTS)
    return screening.ask_for(rows, screening.ALL_GUARDRAILS)


def jobs(requests):
    return {
        "detect": detect(requests),
        "audit": policy.audit_rows(policy.score(requests)),
        "input": policy.check_input(requests),
        "output": policy.check_output(requests.selectExpr("request_id", "agent_id", "prompt AS agent_response")),
    }


def test_conversation_audit_runs_each_pattern_once(spark, sf_dir):
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    handled = policy.redact_and_pass(policy.pair_turns(X.messages(spark, sf_dir)))
    assert patterns(policy.redact_and_pass_audit(handled)) == patterns(handled)


def test_pii_report_runs_each_pattern_once(spark, sf_dir):
    asked = screening.ask_for(X.prompts(spark, sf_dir), screening.ALL_GUARDRAILS)
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert patterns(screening.screened_pii_types(asked, X.AS_OF)) == patterns(detect_pii(asked))


def test_generated_methods_can_be_compiled(requests):
    for name, df in jobs(requests).items():
        stages = df._jdf.queryExecution().debug().codegenToSeq()
        assert stages.size() > 0
        for i in range(stages.size()):
            assert stages.apply(i)._3().maxMethodCodeSize() < COMPILABLE, name


def test_scanning_does_not_shuffle(requests):
    for df in jobs(requests).values():
        assert "Exchange" not in plan_of(df)


def test_each_pattern_runs_once(requests):
    """Flags are columns of their own: a regex occurs in one projection, however many fields read its flag."""
    plan = plan_of(policy.audit_rows(policy.score(requests)))
    for pattern in ("reveal", "jailbreak", "social security", "pretend"):
        lines = [line for line in plan.splitlines() if "RLIKE(_lowered" in line and pattern in line]
        assert len(lines) == 1, pattern


def test_report_on_has_pii_only_runs_the_pii_patterns(spark, sf_dir):
    """Verdicts a report does not read are pruned from the scan."""
    asked = screening.ask_for(X.derive(X.raw(spark, sf_dir, "documents"), X.PROMPTS), screening.ALL_GUARDRAILS)
    plan = plan_of(screening.screened_departments(asked, X.AS_OF))
    assert "RLIKE(_text" in plan and "jailbreak" not in plan and "social security" not in plan
