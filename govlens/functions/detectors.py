"""Rule detectors as native column expressions.

Each detector comes in two steps: *flags* (one boolean per pattern, the expensive part) and a *verdict* struct built
from flag columns. ``operators.guardrails.detect`` puts the two steps into separate projections, so that every
regex runs once per row however often its flag is used. The flag functions expect text without NULLs (``detect``
reads NULL as the empty text, which no pattern matches): expressions that cannot be NULL compile to half the code, and
the whole stage stays small enough for the JVM to compile it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlens.functions import patterns as P
from govlens.functions.columns import labels_where, strings

PII_TYPES = [kind for kind, _, _ in P.PII_PATTERNS]
SENSITIVE_TYPES = [kind for kind, _ in P.SENSITIVE_PATTERNS]
INJECTION_TYPES = sorted({kind for _, kind in P.INJECTION_PATTERNS})


def _any(flags: list[Column]) -> Column:
    return reduce(or_, flags)


def _has(text: Column, *literals: str) -> Column:
    return reduce(and_, [text.contains(literal) for literal in literals])


def pii_flags(text: Column) -> dict[str, Column]:
    """One flag per personal-data type, on the text as it is."""
    digits = text.rlike(P.DIGIT_GATE)
    flags = {}
    for kind, pattern, _ in P.PII_PATTERNS:
        if kind == "email":
            flags[kind] = text.contains("@") & text.rlike(P.EMAIL_JAVA)
        else:
            flags[kind] = digits & text.rlike(P.java_regex(pattern))
    return flags


def redact(text: Column, kind: str, flag: Column) -> Column:
    """Replace what one personal-data type matches, where its flag is set."""
    pattern, replacement = next((p, r) for k, p, r in P.PII_PATTERNS if k == kind)
    if kind == "email":
        replaced = F.regexp_replace(text, F.lit(P.EMAIL_JAVA), F.lit(f"$1{replacement}"))
    else:
        replaced = F.regexp_replace(text, F.lit(P.java_regex(pattern)), F.lit(replacement))
    return F.when(flag, replaced).otherwise(text)


def pii_verdict(flags: dict[str, Column], redacted: Column) -> Column:
    """struct<has_pii, pii_types, redacted_text, details, confidence>; redacted_text is NULL on clean text.

    ``redacted`` is the text after ``redact`` for every type in turn.
    """
    found = _any(list(flags.values()))
    return F.struct(
        found.alias("has_pii"),
        labels_where(flags.items()).alias("pii_types"),
        F.when(found, redacted).alias("redacted_text"),
        F.when(found, F.lit(P.RULE_MATCH["pii"])).otherwise(F.lit(P.NO_MATCH["pii"])).alias("details"),
        F.when(found, F.lit(P.PII_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def sensitive_flags(lowered: Column) -> dict[str, Column]:
    """One flag per kind of sensitive data that the lower-cased text asks for."""
    return {
        kind: _any([_has(lowered, literal) for literal in P.SENSITIVE_LITERALS[kind]])
        & _any([lowered.rlike(P.java_regex(pattern)) for pattern in group])
        for kind, group in P.SENSITIVE_PATTERNS
    }


def sensitive_verdict(flags: dict[str, Column]) -> Column:
    """struct<requests_sensitive_data, sensitive_types, details>."""
    found = _any(list(flags.values()))
    types = labels_where(flags.items())
    return F.struct(
        found.alias("requests_sensitive_data"),
        types.alias("sensitive_types"),
        F.when(found, F.concat(F.lit(P.SENSITIVE_MATCH_PREFIX), F.array_join(types, ", ")))
        .otherwise(F.lit(P.NO_MATCH["sensitive"]))
        .alias("details"),
    )


def injection_flags(lowered: Column) -> dict[str, Column]:
    """One flag per injection pattern, keyed by the pattern's text."""
    return {
        pattern: _has(lowered, *literals) & lowered.rlike(P.java_regex(pattern))
        for (pattern, _), literals in zip(P.INJECTION_PATTERNS, P.INJECTION_LITERALS, strict=True)
    }


def injection_verdict(flags: dict[str, Column]) -> Column:
    """struct<is_injection, injection_score, injection_types, details, suspicious_patterns>, types sorted."""
    found = _any(list(flags.values()))
    by_type = {
        kind: _any([flags[pattern] for pattern, of in P.INJECTION_PATTERNS if of == kind]) for kind in INJECTION_TYPES
    }
    n_types = reduce(lambda a, b: a + b, [flag.cast("int") for flag in by_type.values()])
    return F.struct(
        found.alias("is_injection"),
        F.least(n_types * F.lit(P.INJECTION_SCORE_PER_TYPE), F.lit(1.0)).alias("injection_score"),
        labels_where(by_type.items()).alias("injection_types"),
        F.when(found, F.lit(P.RULE_MATCH["injection"])).otherwise(F.lit(P.NO_MATCH["injection"])).alias("details"),
        labels_where(flags.items()).alias("suspicious_patterns"),
    )


def toxicity_flag(lowered: Column) -> Column:
    """Whether the lower-cased text contains a toxic keyword, also inside a longer word."""
    return _any([lowered.contains(word) for word in P.TOXIC_KEYWORDS])


def toxicity_verdict(flag: Column) -> Column:
    """struct<is_toxic, toxicity_score, categories, details, category_scores>."""
    return F.struct(
        flag.alias("is_toxic"),
        F.when(flag, F.lit(P.TOXIC_SCORE)).otherwise(F.lit(0.0)).alias("toxicity_score"),
        F.when(flag, strings(P.TOXIC_CATEGORY)).otherwise(strings()).alias("categories"),
        F.when(flag, F.lit(P.RULE_MATCH["toxicity"])).otherwise(F.lit(P.NO_MATCH["toxicity"])).alias("details"),
        F.create_map().cast("map<string,double>").alias("category_scores"),
    )
