"""Guardrail detection over a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions import detectors as D
from govlens.functions import patterns as P
from govlens.functions.columns import is_true

# Verdict column per guardrail type.
VERDICT = {
    "pii_detection": "pii",
    "sensitive_request": "sensitive",
    "toxicity": "toxicity",
    "prompt_injection": "injection",
}


def _flags(kind: str, text: Column, lowered: Column) -> dict[str, Column]:
    if kind == "pii_detection":
        return D.pii_flags(text)
    if kind == "sensitive_request":
        return D.sensitive_flags(lowered)
    if kind == "prompt_injection":
        return D.injection_flags(lowered)
    return {"keyword": D.toxicity_flag(lowered)}


def _verdict(kind: str, flags: dict[str, Column]) -> Column:
    if kind == "pii_detection":
        return D.pii_verdict(flags, F.col("_redacted"))
    if kind == "sensitive_request":
        return D.sensitive_verdict(flags)
    if kind == "prompt_injection":
        return D.injection_verdict(flags)
    return D.toxicity_verdict(flags["keyword"])


def detect(
    df: DataFrame,
    text: str = "prompt",
    kinds: list[str] | None = None,
    wanted: str | None = None,
    custom: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Add one verdict struct per guardrail type (see ``VERDICT`` for the column names).

    ``wanted`` names an array<string> column with the guardrails each row asks for: detectors a row does not ask
    for are skipped and give a negative verdict. ``custom`` adds detectors of your own, name -> (text -> struct);
    each becomes a column of that name.

    One narrow stage: the text is lower-cased once, every pattern is a flag column, and the verdicts read flags only.
    """
    kinds = list(VERDICT) if kinds is None else kinds
    source = F.col("_text")
    out = df.withColumn("_text", F.coalesce(text, F.lit("")))
    if wanted is not None:
        out = out.withColumns({f"_want_{k}": is_true(F.array_contains(wanted, k)) for k in kinds})
    if any(k != "pii_detection" for k in kinds):
        out = out.withColumn("_lowered", F.lower(source))
    flag_names: dict[str, dict[str, str]] = {}
    flag_columns: dict[str, Column] = {}
    for kind in kinds:
        flag_names[kind] = {}
        for i, (label, flag) in enumerate(_flags(kind, source, F.col("_lowered")).items()):
            name = f"_{VERDICT[kind]}_{i}"
            flag_names[kind][label] = name
            if wanted is not None:
                flag = F.col(f"_want_{kind}") & flag
            flag_columns[name] = flag
    out = out.withColumns(flag_columns)
    if "pii_detection" in kinds:
        # One step per type, each on the text that the step before left.
        out = out.withColumn("_redacted", source)
        for label, name in flag_names["pii_detection"].items():
            out = out.withColumn("_redacted", D.redact(F.col("_redacted"), label, F.col(name)))
    verdicts = {
        VERDICT[kind]: _verdict(kind, {label: F.col(name) for label, name in flag_names[kind].items()})
        for kind in kinds
    }
    for name, build in (custom or {}).items():
        verdicts[name] = build(F.col(text))
    out = out.withColumns(verdicts)
    helpers = ["_text", "_lowered", "_redacted", *flag_columns, *[f"_want_{k}" for k in kinds]]
    return out.drop(*helpers)


def detect_pii(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Personal data: adds ``pii``."""
    return detect(df, text, ["pii_detection"])


def detect_sensitive_request(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Requests for sensitive data: adds ``sensitive``."""
    return detect(df, text, ["sensitive_request"])


def detect_injection(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Prompt injection: adds ``injection``."""
    return detect(df, text, ["prompt_injection"])


def detect_toxicity(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Toxic wording: adds ``toxicity``."""
    return detect(df, text, ["toxicity"])


def pattern_counts(df: DataFrame, text: str = "prompt") -> DataFrame:
    """On how many texts each injection pattern occurs: (pattern, type, hits), patterns without a hit left out.

    One counter per pattern in a single pass; nothing is exploded before the aggregation.
    """
    kinds = dict(P.INJECTION_PATTERNS)
    lowered = df.select(F.lower(F.coalesce(text, F.lit(""))).alias("_lowered"))
    counters = [
        F.struct(F.lit(p).alias("pattern"), F.lit(kinds[p]).alias("type"), F.count_if(flag).alias("hits"))
        for p, flag in D.injection_flags(F.col("_lowered")).items()
    ]
    return lowered.agg(F.array(*counters).alias("c")).select(F.inline("c")).filter(F.col("hits") > 0)
