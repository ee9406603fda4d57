"""Policy: from detector verdicts to decisions, audit rows and client results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens import schemas as S
from govlens.functions.columns import strings
from govlens.functions.patterns import BLOCK_THRESHOLD
from govlens.operators.guardrails import VERDICT, detect
from govlens.operators.hygiene import apply_defaults, constraints

# Texts of the policies.
UNSAFE_RESPONSE = "[BLOCKED: Response violated content policy]"
APOLOGY = "I apologize, but I cannot assist with that request. How else can I help you today?"
BLOCKED_INPUT_REPLY = "I detected sensitive information. Please rephrase without personal data."
BLOCKED_OUTPUT_REPLY = "I cannot provide that information."
HALLUCINATION_MESSAGE = "hallucination coming soon - requires output context"
SUPPORT_AGENT = "support-agent-001"
SUPPORT_DEPARTMENT = "support"
AUDIT_PREVIEW = 500

MODEL = "rules-v1"
SEVERITY = ["passed", "flagged", "blocked"]


def status(kind: str) -> Column:
    """passed / flagged / blocked for one guardrail type, from its verdict column."""
    passed, flagged, blocked = (F.lit(s) for s in SEVERITY)
    if kind == "pii_detection":
        return F.when(F.col("pii.has_pii"), blocked).otherwise(passed)
    if kind == "sensitive_request":
        return F.when(F.col("sensitive.requests_sensitive_data"), blocked).otherwise(passed)
    if kind == "toxicity":
        hit, score = F.col("toxicity.is_toxic"), F.col("toxicity.toxicity_score")
    elif kind == "prompt_injection":
        hit, score = F.col("injection.is_injection"), F.col("injection.injection_score")
    else:
        return passed
    return F.when(hit & (score >= BLOCK_THRESHOLD), blocked).when(hit, flagged).otherwise(passed)


def confidence(kind: str) -> Column:
    """The confidence reported with a guardrail's status."""
    return {
        "pii_detection": F.col("pii.confidence"),
        "sensitive_request": F.when(F.col("sensitive.requests_sensitive_data"), F.lit(1.0)).otherwise(F.lit(0.0)),
        "toxicity": F.col("toxicity.toxicity_score"),
        "prompt_injection": F.col("injection.injection_score"),
        "hallucination": F.lit(0.0),
    }[kind]


def details(kind: str) -> Column:
    """The details of a guardrail result, as a JSON string."""
    fields = {
        "pii_detection": ["pii.has_pii", "pii.pii_types"],
        "sensitive_request": ["sensitive.requests_sensitive_data", "sensitive.sensitive_types"],
        "toxicity": [
            "toxicity.is_toxic",
            "toxicity.toxicity_score",
            "toxicity.categories",
            "toxicity.category_scores",
        ],
        "prompt_injection": [
            "injection.is_injection",
            "injection.injection_score",
            "injection.injection_types",
            "injection.suspicious_patterns",
        ],
    }
    if kind == "hallucination":
        return F.to_json(F.struct(F.lit(HALLUCINATION_MESSAGE).alias("message")))
    explanation = F.col(f"{VERDICT[kind]}.details").alias("explanation")
    return F.to_json(F.struct(*fields[kind], explanation))


def audit_metadata(kind: str) -> Column:
    """The metadata JSON of a guardrail's audit row."""
    fields = {
        "pii_detection": ["pii.pii_types", "pii.confidence"],
        "sensitive_request": ["sensitive.requests_sensitive_data", "sensitive.sensitive_types"],
        "toxicity": ["toxicity.is_toxic", "toxicity.toxicity_score", "toxicity.categories"],
        "prompt_injection": ["injection.is_injection", "injection.injection_score", "injection.injection_types"],
    }
    return F.to_json(F.struct(*fields[kind]))


def score(requests: DataFrame, text: str = "prompt", also: tuple[str, ...] = ()) -> DataFrame:
    """Fill defaults and run the detectors each request asks for, and those in ``also``. Adds the verdict columns."""
    filled = apply_defaults(requests, "request")
    if not also:
        return detect(filled, text, wanted="guardrails")
    wanted = filled.withColumn("_wanted", F.array_union("guardrails", strings(*also)))
    return detect(wanted, text, wanted="_wanted").drop("_wanted")


def statuses(scored: DataFrame) -> DataFrame:
    """Add ``<type>_status`` per guardrail type."""
    return scored.withColumns({f"{kind}_status": status(kind) for kind in VERDICT})


def overall_status(guardrails: str = "guardrails") -> Column:
    """The most severe status among the requested guardrails, from the ``<type>_status`` columns.

    A request that asks for no guardrail, or for one that does not exist, is blocked: it has not been checked.
    """

    def rank(kind: str) -> Column:
        current = F.col(f"{kind}_status")
        level = F.when(current == "blocked", 2).when(current == "flagged", 1).otherwise(0)
        return F.when(F.array_contains(guardrails, kind), level).otherwise(0)

    worst = F.greatest(*[rank(kind) for kind in VERDICT])
    worst = F.when(constraints("requests")["guardrails"], worst).otherwise(2)
    return F.when(worst == 2, "blocked").when(worst == 1, "flagged").otherwise("passed")


def decide(scored: DataFrame, text: str = "prompt") -> DataFrame:
    """Decide on scored requests: results in the requested order, overall status and safe prompt.

    Works on any verdict columns, those of the detectors as well as those ingested from stored answers.
    """
    ranked = statuses(scored)
    ranked = ranked.withColumn("overall_status", overall_status())
    for kind in S.GUARDRAILS:
        result = F.struct(
            F.lit(kind).alias("guardrail_type"),
            (F.col(f"{kind}_status") if kind in VERDICT else F.lit("passed")).alias("status"),
            confidence(kind).alias("confidence"),
            details(kind).alias("details"),
        )
        ranked = ranked.withColumn(f"_result_{kind}", result)

    def pick(kind: Column) -> Column:
        return reduce(
            lambda chain, k: chain.when(kind == k, F.col(f"_result_{k}")),
            S.GUARDRAILS[1:],
            F.when(kind == S.GUARDRAILS[0], F.col(f"_result_{S.GUARDRAILS[0]}")),
        )

    redacted = F.col("pii.redacted_text")
    redacted = F.when(
        F.array_contains("guardrails", "pii_detection") & F.col("pii.has_pii") & (F.length(redacted) > 0), redacted
    )
    return (
        ranked.withColumn("results", F.transform("guardrails", pick))
        .withColumn("original_prompt", F.col(text))
        .withColumn("safe_prompt", F.when(F.col("overall_status") == "blocked", F.coalesce(redacted, F.col(text))))
        .drop(*[f"_result_{k}" for k in S.GUARDRAILS], *[f"{k}_status" for k in VERDICT])
    )


def check_input(requests: DataFrame, text: str = "prompt") -> DataFrame:
    """Check each request against the guardrails it asks for."""
    return decide(score(requests, text), text).select(
        "request_id", "agent_id", "overall_status", "results", "original_prompt", "safe_prompt"
    )


def _optional(df: DataFrame, name: str, kind: str = "string", default: Column | None = None) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return (value if default is None else F.coalesce(value, default)).alias(name)


def audit_rows(scored: DataFrame, text: str = "prompt", model: str = MODEL, mask: bool = False) -> DataFrame:
    """One audit row per request and requested guardrail, from scored requests (``timestamp`` column needed).

    The guardrail list is exploded, not the verdicts: each output row picks its fields by type, so the stage stays
    narrow and inside generated code. With ``mask`` no row holds the raw text of a request with personal data, whatever
    guardrail the row is about; score with ``also=("pii_detection",)`` so that every request is searched.
    """
    rows = scored.withColumn("guardrail_type", F.explode("guardrails")).filter(
        F.col("guardrail_type").isin(list(VERDICT))
    )

    def by_type(pick) -> Column:
        kinds = list(VERDICT)
        chain = F.when(F.col("guardrail_type") == kinds[0], pick(kinds[0]))
        for kind in kinds[1:]:
            chain = chain.when(F.col("guardrail_type") == kind, pick(kind))
        return chain

    is_pii = F.col("guardrail_type") == "pii_detection"
    return rows.select(
        "request_id",
        "timestamp",
        "agent_id",
        _optional(rows, "user_id"),
        _optional(rows, "department"),
        _optional(rows, "session_id"),
        "guardrail_type",
        by_type(status).alias("status"),
        F.length(text).cast("long").alias("prompt_length"),
        (is_pii & F.col("pii.has_pii")).alias("has_pii"),
        _optional(rows, "processing_time_ms", "double", F.lit(0.0)),
        F.lit(model).alias("model_used"),
        by_type(audit_metadata).alias("metadata"),
        (F.when(F.col("pii.has_pii"), F.col("pii.redacted_text")).otherwise(F.col(text)) if mask else F.col(text)).alias(
            "original_prompt"
        ),
        F.when(is_pii, F.col("pii.redacted_text")).alias("redacted_prompt"),
    )


def masked_audit_rows(requests: DataFrame, text: str = "prompt") -> DataFrame:
    """Audit rows of requests without raw personal data: it is searched and redacted even where nobody asked for it."""
    return audit_rows(score(requests, text, also=("pii_detection",)), text, mask=True)


def input_check_result(decided: DataFrame) -> DataFrame:
    """The client view of decided requests (see ``decide``). PII counts only where it was asked for."""
    asked = F.array_contains("guardrails", "pii_detection")
    return decided.select(
        "request_id",
        (F.col("overall_status") == "passed").alias("passed"),
        (F.col("overall_status") == "blocked").alias("blocked"),
        (asked & F.col("pii.has_pii")).alias("has_pii"),
        F.when(asked, F.col("pii.pii_types")).otherwise(strings()).alias("pii_types"),
        F.coalesce(F.nullif("safe_prompt", F.lit("")), F.col("original_prompt")).alias("safe_prompt"),
        "original_prompt",
    )


def judge_output(scored: DataFrame) -> DataFrame:
    """Add is_safe, violations and blocked_reason to responses with sensitive and toxicity verdicts."""
    asks = F.col("sensitive.requests_sensitive_data")
    toxic = F.col("toxicity.is_toxic") & (F.col("toxicity.toxicity_score") >= BLOCK_THRESHOLD)
    return (
        scored.withColumn("is_safe", ~(asks | toxic))
        .withColumn(
            "violations",
            F.concat(
                F.when(asks, F.col("sensitive.sensitive_types")).otherwise(strings()),
                F.when(
                    toxic, F.transform("toxicity.categories", lambda c: F.concat(F.lit("toxic:"), c))
                ).otherwise(strings()),
            ),
        )
        .withColumn(
            "blocked_reason",
            F.when(
                ~F.col("is_safe"),
                F.concat_ws(
                    "; ",
                    F.when(
                        asks,
                        F.concat(
                            F.lit("Agent response requests sensitive data: "),
                            F.array_join("sensitive.sensitive_types", ", "),
                        ),
                    ),
                    F.when(
                        toxic,
                        F.concat(F.lit("Toxic content detected: "), F.array_join("toxicity.categories", ", ")),
                    ),
                ),
            ),
        )
    )


def score_output(responses: DataFrame, text: str = "agent_response") -> DataFrame:
    """Run the two output detectors and judge. Adds verdicts, is_safe, violations and blocked_reason."""
    return judge_output(detect(responses, text, ["sensitive_request", "toxicity"]))


def check_output(responses: DataFrame) -> DataFrame:
    """Check agent responses before they are shown to users."""
    return score_output(responses).select(
        "request_id",
        "agent_id",
        "is_safe",
        (~F.col("is_safe")).alias("blocked"),
        "violations",
        "blocked_reason",
        F.when(~F.col("is_safe"), F.lit(UNSAFE_RESPONSE)).alias("safe_response"),
    )


def output_audit_rows(judged: DataFrame, text: str = "agent_response", model: str = MODEL) -> DataFrame:
    """One audit row per checked response, from ``score_output`` (``timestamp`` column needed)."""
    return judged.select(
        "request_id",
        "timestamp",
        "agent_id",
        _optional(judged, "user_id"),
        _optional(judged, "department"),
        _optional(judged, "session_id"),
        F.lit(S.OUTPUT_GUARDRAIL).alias("guardrail_type"),
        F.when(F.col("is_safe"), "passed").otherwise("blocked").alias("status"),
        F.length(text).cast("long").alias("prompt_length"),
        F.lit(False).alias("has_pii"),
        _optional(judged, "processing_time_ms", "double", F.lit(0.0)),
        F.lit(model).alias("model_used"),
        F.to_json(
            F.struct(
                F.lit(S.OUTPUT_GUARDRAIL).alias("check_type"),
                "violations",
                "sensitive.sensitive_types",
                F.col("toxicity.is_toxic").alias("toxicity_detected"),
            )
        ).alias("metadata"),
        _optional(judged, "original_prompt"),
        F.when(~F.col("is_safe"), F.substring(text, 1, AUDIT_PREVIEW)).alias("redacted_prompt"),
    )


def pair_turns(messages: DataFrame, order: str = "seq") -> DataFrame:
    """User messages with the assistant reply that directly follows, one row per turn.

    A turn number covers one user message and what follows it, so the window runs over (session, turn) and a long
    session spreads over many groups. Only the first two messages of a turn matter; Spark drops the others before the
    shuffle (window group limit), so a turn with very many replies does not travel whole.
    """
    window = Window.partitionBy("session_id", "turn_number").orderBy(order)
    messages = messages.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= 2).drop("_rank")
    follows = F.lead("role").over(window) == "assistant"
    paired = messages.withColumns(
        {
            "agent_response": F.when(follows, F.lead("content").over(window)),
            "response_ms": F.when(follows, F.lead("processing_time_ms").over(window)),
        }
    )
    return paired.filter(F.col("role") == "user").select(
        F.sha2(F.concat_ws(":", "session_id", "turn_number"), 256).alias("request_id"),
        "session_id",
        "agent_id",
        _optional(messages, "user_id"),
        "turn_number",
        "timestamp",
        F.col("content").alias("user_message"),
        "agent_response",
        F.col("response_ms").alias("processing_time_ms"),
    )


def _exchange_verdicts(exchanges: DataFrame) -> DataFrame:
    """PII verdict of the user message, sensitive-request verdict of the response."""
    return detect(detect(exchanges, "user_message", ["pii_detection"]), "agent_response", ["sensitive_request"])


def redact_and_pass(exchanges: DataFrame) -> DataFrame:
    """Redact personal data and never block the input; replace a response that asks for sensitive data."""
    judged = _exchange_verdicts(exchanges)
    unsafe = F.col("sensitive.requests_sensitive_data")
    return judged.select(
        "*",
        F.coalesce("pii.redacted_text", "user_message").alias("safe_prompt"),
        F.when(unsafe, F.lit(APOLOGY)).otherwise(F.col("agent_response")).alias("message"),
        F.lit(False).alias("was_input_blocked"),
        unsafe.alias("was_output_blocked"),
        F.col("pii.pii_types").alias("input_pii_detected"),
        F.col("sensitive.sensitive_types").alias("output_violations"),
    )


def redact_and_pass_audit(handled: DataFrame, model: str = MODEL) -> DataFrame:
    """Audit rows of ``redact_and_pass``: flagged personal data and blocked responses, nothing else.

    Both rows of a turn come out of one pass over ``handled``. Turns without either go after the explode: a filter on
    the verdicts before it would run their patterns a second time.
    """
    def row(kind: str, state: str, text: str, metadata: Column, redacted: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("guardrail_type"),
            F.lit(state).alias("status"),
            F.length(text).cast("long").alias("prompt_length"),
            F.lit(kind == "pii_detection").alias("has_pii"),
            metadata.alias("metadata"),
            redacted.alias("redacted_prompt"),
        )

    preview = F.substring("agent_response", 1, AUDIT_PREVIEW)
    flagged = row(
        "pii_detection",
        "flagged",
        "user_message",
        F.to_json(F.struct(F.col("input_pii_detected").alias("pii_types"))),
        F.col("pii.redacted_text"),
    )
    blocked = row(
        "sensitive_request",
        "blocked",
        "agent_response",
        F.to_json(
            F.struct(
                F.lit(S.OUTPUT_GUARDRAIL).alias("check_type"),
                F.col("output_violations").alias("violations"),
                preview.alias("original_response"),
            )
        ),
        preview,
    )
    events = F.array(F.when(F.col("pii.has_pii"), flagged), F.when(F.col("was_output_blocked"), blocked))
    return (
        handled.withColumn("e", F.explode(events))
        .filter(F.col("e").isNotNull())
        .select(
            "request_id",
            "timestamp",
            F.lit(SUPPORT_AGENT).alias("agent_id"),
            "user_id",
            F.lit(SUPPORT_DEPARTMENT).alias("department"),
            "session_id",
            "e.guardrail_type",
            "e.status",
            "e.prompt_length",
            "e.has_pii",
            F.lit(0.0).alias("processing_time_ms"),
            F.lit(model).alias("model_used"),
            "e.metadata",
            F.col("user_message").alias("original_prompt"),
            "e.redacted_prompt",
        )
    )


def _message_pair(df: DataFrame, user: Column, assistant: Column) -> DataFrame:
    return (
        df.select("session_id", "agent_id", "turn_number", "timestamp", F.explode(F.array(user, assistant)).alias("m"))
        .select("session_id", "agent_id", "turn_number", "timestamp", "m.*")
        .filter(F.col("content").isNotNull())
    )


def _message(role: str, content: Column, has_pii: Column, blocked: Column, elapsed: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        content.alias("content"),
        has_pii.alias("has_pii"),
        blocked.alias("was_blocked"),
        elapsed.alias("processing_time_ms"),
    )


def redact_and_pass_messages(handled: DataFrame) -> DataFrame:
    """The messages that ``redact_and_pass`` keeps in the session history."""
    none = F.lit(None).cast("double")
    return _message_pair(
        handled,
        _message("user", F.col("user_message"), F.col("pii.has_pii"), F.lit(False), none),
        _message("assistant", F.col("message"), F.lit(False), F.col("was_output_blocked"), none),
    )


def block_and_log(exchanges: DataFrame) -> DataFrame:
    """Block input with personal data, block unsafe responses, and log both messages of every turn.

    A flagged status does not block. The response of a blocked input is not used.
    """
    scored = detect(exchanges, "user_message", ["pii_detection"])
    judged = score_output(scored)
    blocked_in = F.col("pii.has_pii")
    blocked_out = ~F.col("is_safe")
    reply = (
        F.when(blocked_in, F.lit(BLOCKED_INPUT_REPLY))
        .when(blocked_out, F.lit(BLOCKED_OUTPUT_REPLY))
        .otherwise(F.col("agent_response"))
    )
    none = F.lit(None).cast("double")
    elapsed = F.when(~blocked_in, F.col("processing_time_ms"))
    return _message_pair(
        judged,
        _message("user", F.col("user_message"), blocked_in, blocked_in, none),
        _message("assistant", reply, F.lit(False), blocked_in | blocked_out, elapsed),
    )
