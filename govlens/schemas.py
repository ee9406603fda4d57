"""The six governance tables and the value sets of their columns (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

GUARDRAILS = ["pii_detection", "sensitive_request", "toxicity", "hallucination", "prompt_injection"]
OUTPUT_GUARDRAIL = "output_guardrail"
STATUSES = ["passed", "blocked", "flagged"]
RATINGS = ["helpful", "not_helpful", "incorrect", "inappropriate"]
ROLES = ["user", "assistant"]
END_STATUSES = ["completed", "abandoned", "error"]
SESSION_STATUSES = ["active", *END_STATUSES]
MAX_TURN = 10_000

DEFAULT_AGENT = "default"
DEFAULT_GUARDRAILS = ["pii_detection"]
DEFAULT_ENVIRONMENT = "development"
DEFAULT_END_STATUS = "completed"
DEFAULT_KEY_DAYS = 365

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in columns])


@dataclass(frozen=True)
class Table:
    """A table: its columns, and the event time that its day partitions derive from (None: not partitioned)."""

    name: str
    schema: T.StructType
    event_time: str | None = None

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


AUDIT_LOGS = Table(
    "audit_logs",
    _schema(
        ("request_id", _S, True),
        ("timestamp", _TS, True),
        ("agent_id", _S, True),
        ("user_id", _S, False),
        ("department", _S, False),
        ("session_id", _S, False),
        ("guardrail_type", _S, True),
        ("status", _S, True),
        ("prompt_length", _L, True),
        ("has_pii", _B, True),
        ("processing_time_ms", _D, True),
        ("model_used", _S, True),
        ("metadata", _S, False),
        ("original_prompt", _S, False),
        ("redacted_prompt", _S, False),
    ),
    event_time="timestamp",
)

AGENTS = Table(
    "agents",
    _schema(
        ("agent_id", _S, True),
        ("agent_name", _S, True),
        ("department", _S, True),
        ("team", _S, False),
        ("description", _S, False),
        ("owner_email", _S, True),
        ("environment", _S, True),
        ("tags", _S, False),
        ("created_at", _TS, True),
        ("updated_at", _TS, True),
        ("is_active", _B, True),
    ),
)

FEEDBACK = Table(
    "feedback",
    _schema(
        ("feedback_id", _S, True),
        ("request_id", _S, True),
        ("agent_id", _S, True),
        ("user_id", _S, False),
        ("rating", _S, True),
        ("comment", _S, False),
        ("suggestion", _S, False),
        ("tags", _S, False),
        ("timestamp", _TS, True),
    ),
    event_time="timestamp",
)

CONVERSATIONS = Table(
    "conversations",
    _schema(
        ("session_id", _S, True),
        ("agent_id", _S, True),
        ("user_id", _S, False),
        ("department", _S, False),
        ("started_at", _TS, True),
        ("ended_at", _TS, False),
        ("message_count", _L, True),
        ("total_pii_incidents", _L, True),
        ("total_blocked", _L, True),
        ("status", _S, True),
        ("metadata", _S, False),
    ),
    event_time="started_at",
)

MESSAGES = Table(
    "conversation_messages",
    _schema(
        ("message_id", _S, True),
        ("session_id", _S, True),
        ("agent_id", _S, True),
        ("turn_number", _L, True),
        ("role", _S, True),
        ("content", _S, True),
        ("timestamp", _TS, True),
        ("has_pii", _B, True),
        ("was_blocked", _B, True),
        ("guardrail_result", _S, False),
        ("feedback_rating", _S, False),
        ("processing_time_ms", _D, False),
    ),
    event_time="timestamp",
)

API_KEYS = Table(
    "api_keys",
    _schema(
        ("key_id", _S, True),
        ("agent_id", _S, True),
        ("key_hash", _S, True),
        ("key_prefix", _S, True),
        ("description", _S, False),
        ("created_at", _TS, True),
        ("expires_at", _TS, True),
        ("last_used_at", _TS, False),
        ("is_active", _B, True),
    ),
)

TABLES = {t.name: t for t in (AUDIT_LOGS, AGENTS, FEEDBACK, CONVERSATIONS, MESSAGES, API_KEYS)}
