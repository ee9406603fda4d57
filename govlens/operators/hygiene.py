"""Record hygiene: defaults, required fields, value constraints, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens import schemas as S
from govlens.functions.columns import labels_where, strings


def defaults(record: str) -> dict[str, Column]:
    """Default values of an input record: 'request', 'agent', 'feedback', 'end' or 'key'."""
    return {
        "request": {"agent_id": F.lit(S.DEFAULT_AGENT), "guardrails": strings(*S.DEFAULT_GUARDRAILS)},
        "agent": {"environment": F.lit(S.DEFAULT_ENVIRONMENT), "tags": strings()},
        "feedback": {"tags": strings()},
        "end": {"status": F.lit(S.DEFAULT_END_STATUS)},
        "key": {"expires_days": F.lit(S.DEFAULT_KEY_DAYS)},
    }[record]


def apply_defaults(df: DataFrame, record: str) -> DataFrame:
    """Fill missing values, and add columns that the input does not have."""
    filled = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults(record).items()
    }
    return df.withColumns(filled)


def known_guardrail(name: Column) -> Column:
    return F.coalesce(name.isin(S.GUARDRAILS), F.lit(False))


def constraints(table: str) -> dict[str, Column]:
    """Column -> condition that its values in a valid row fulfil. NULL passes here: ``missing_fields`` covers that."""
    one_of = lambda name, values: F.col(name).isin(values)
    unit = lambda name: F.col(name).between(0.0, 1.0)
    return {
        "audit_logs": {
            "guardrail_type": one_of("guardrail_type", [*S.GUARDRAILS, S.OUTPUT_GUARDRAIL]),
            "status": one_of("status", S.STATUSES),
        },
        "feedback": {"rating": one_of("rating", S.RATINGS)},
        "conversations": {"status": one_of("status", S.SESSION_STATUSES)},
        "conversation_messages": {
            "role": one_of("role", S.ROLES),
            "turn_number": F.col("turn_number").between(1, S.MAX_TURN),
        },
        "agents": {},
        "api_keys": {},
        "end": {"status": one_of("status", S.END_STATUSES)},
        "requests": {"guardrails": (F.size("guardrails") > 0) & F.forall("guardrails", known_guardrail)},
        "results": {"status": one_of("status", S.STATUSES), "confidence": unit("confidence")},
    }[table]


def missing_fields(required: list[str]) -> Column:
    """Names of the required fields that are NULL, as array<string>."""
    return labels_where([(f"missing:{name}", F.col(name).isNull()) for name in required])


def broken_constraints(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, as array<string>."""
    return labels_where([(f"invalid:{name}", F.coalesce(~ok, F.lit(False))) for name, ok in rules.items()])


def check(df: DataFrame, table: str) -> DataFrame:
    """Add ``violations``: missing required fields, then broken value constraints, of the columns ``df`` has."""
    required = S.TABLES[table].required if table in S.TABLES else []
    missing = missing_fields([name for name in required if name in df.columns])
    broken = broken_constraints({name: ok for name, ok in constraints(table).items() if name in df.columns})
    return df.withColumn("violations", F.concat(missing, broken))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows the table accepts, and the rows it rejects with their ``violations``."""
    checked = check(df, table)
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return good, checked.filter(F.size("violations") > 0)


def payload(rejected: DataFrame) -> Column:
    """All columns of a rejected row but the reasons, with their types, as one VARIANT."""
    return F.to_variant_object(F.struct(*[c for c in rejected.columns if c != "violations"])).alias("payload")


def dead_letters(rejected: DataFrame, whole: bool = False) -> DataFrame:
    """The seven-field summary that is kept of a rejected audit row, with the reason; ``whole`` adds the row itself."""
    return rejected.select(
        "request_id",
        "timestamp",
        "agent_id",
        F.col("guardrail_type").alias("guardrail"),
        "status",
        "has_pii",
        "processing_time_ms",
        "violations",
        *([payload(rejected)] if whole else []),
    )


def restored(letters: DataFrame, schema: T.StructType) -> DataFrame:
    """The rejected rows of dead letters, with the columns of ``schema``; a field that the row did not have is NULL."""
    return letters.select(
        *[F.try_variant_get("payload", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    )


def check_range(name: str, value: int, low: int, high: int) -> int:
    """Validate a parameter range on the driver."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value
