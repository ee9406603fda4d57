"""From raw prompts to the audit table, and on to the risk report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from govlens.functions.columns import strings
from govlens.operators.common import last_days
from govlens.operators.guardrails import detect_pii
from govlens.operators.hygiene import apply_defaults, broken_constraints, constraints, missing_fields, payload
from govlens.operators.policy import audit_rows, score
from govlens.operators.usage import department_leaderboard
from govlens.sources.tables import EVENT_DATE, append, dead_letter_path, write_batch

ALL_GUARDRAILS = ["pii_detection", "sensitive_request", "toxicity", "prompt_injection"]
REQUEST_FIELDS = ["request_id", "timestamp", "agent_id", "prompt"]


def ask_for(requests: DataFrame, guardrails: list[str]) -> DataFrame:
    """Request the same guardrails on every row."""
    return requests.withColumn("guardrails", strings(*guardrails))


def screen(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows of the valid requests, and the rejected requests with their ``violations``.

    A request is rejected if it lacks a required field, or asks for no guardrail or for one that does not exist: it must
    neither vanish nor pass unchecked.
    """
    valid, rejected = _split(requests)
    return audit_rows(score(valid)), rejected


def _split(requests: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    checked = apply_defaults(requests, "request").withColumn(
        "violations", F.concat(missing_fields(REQUEST_FIELDS), broken_constraints(constraints("requests")))
    )
    if seen is not None:
        checked = checked.observe(seen, F.count_if(F.size("violations") > 0).alias("rejected"))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def rejected_summary(rejected: DataFrame) -> DataFrame:
    """What is kept of a rejected request: a summary, the reasons, and the request itself."""
    return rejected.select("request_id", "timestamp", "agent_id", "violations", payload(rejected))


def screen_to_table(requests: DataFrame, root: str, batch_id: str | None = None, rebalance: bool = True) -> None:
    """Screen prompts into the audit table below ``root``; rejected requests go to its dead letters.

    A repeated run with the same ``batch_id`` replaces its rows. With ``rebalance`` the requests are brought together
    by day before they are scored: a prompt is shuffled once, and not once per audit row. Leave it out when the input
    is laid out by day already.
    """
    by_day = requests.withColumn(EVENT_DATE, F.to_date("timestamp")).hint("rebalance", EVENT_DATE)
    screen_batch(by_day if rebalance else requests, requests, root, batch_id or uuid.uuid4().hex)


def screen_batch(laid_out: DataFrame, requests: DataFrame, root: str, batch_id: str) -> None:
    """Write the audit rows of a batch of requests, and its rejected requests if there are any.

    The rejected ones are counted while the others are written: a second look at the requests, which scores nothing, is
    only taken when there are some. ``laid_out`` are the same requests, spread as the write wants them.
    """
    seen = Observation()
    valid, _ = _split(laid_out, seen)
    append(audit_rows(score(valid)), root, "audit_logs", batch_id, rebalance=False)
    _, rejected = _split(requests)
    letters = rejected_summary(rejected)
    write_batch(letters if seen.get["rejected"] else letters.limit(0), dead_letter_path(root, "requests"), batch_id)


def screened_departments(requests: DataFrame, as_of: str) -> DataFrame:
    """Screen prompts and rank departments by PII rate. One scan and one narrow stage before the aggregation."""
    rows, _ = screen(requests)
    return department_leaderboard(rows, as_of)


def screened_pii_types(requests: DataFrame, as_of: str) -> DataFrame:
    """Screen prompts and count the personal-data types found in the last 30 days.

    Only the detector that the report needs runs. The types are exploded with the empty lists, which go afterwards: a
    filter before the explode would run every pattern a second time.
    """
    valid, _ = _split(requests)
    asked = last_days(valid, as_of, 30).filter(F.array_contains("guardrails", "pii_detection"))
    types = detect_pii(asked).select(F.explode_outer("pii.pii_types").alias("pii_type"))
    return (
        types.filter(F.col("pii_type").isNotNull())
        .groupBy("pii_type")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "pii_type")
    )
