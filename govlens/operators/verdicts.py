"""Verdicts from stored model answers, with the rule detectors as the fallback.

An answer is used when it is one JSON object whose fields have usable types and ranges. Otherwise, also when there is
no answer, the row gets the rule verdict; the rule patterns run on those rows only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.functions.columns import is_true, strings, strip_code_fence, token_cost
from govlens.operators.guardrails import VERDICT, detect

# Scores and labels of provider block signals.
BLOCKED_SCORE = 0.8
REFUSED_SCORE = 0.9
RATING_SCORES = {"HIGH": 0.8, "MEDIUM": 0.6}
BLOCKED_CATEGORY = "content_policy_violation"
BLOCKED_PREFIX = "Content blocked by safety filters: "
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]

_NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def parse_answer(answer: Column) -> Column:
    """The answer as VARIANT, NULL unless it is exactly one JSON object.

    The parser ignores what follows the first value. Inside an array and inside an object the same text must parse
    too, which leaves no room for a trailing part.
    """
    text = strip_code_fence(answer)
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    value = F.try_variant_get(in_object, "$.v", "variant")
    return F.when(in_array.isNotNull() & F.schema_of_variant(value).startswith("OBJECT"), value)


def _field(answer: Column, name: str) -> Column:
    return F.try_variant_get(answer, f"$.{name}", "variant")


def _kind(answer: Column, name: str) -> Column:
    """Type name of a field, NULL when the field is absent."""
    return F.schema_of_variant(_field(answer, name))


def _get(answer: Column, name: str, of: str) -> Column:
    return F.try_variant_get(answer, f"$.{name}", of)


def _bool(answer: Column, name: str) -> tuple[Column, Column]:
    """(value with default false, whether the field is absent or usable)."""
    kind, word = _kind(answer, name), F.lower(_get(answer, name, "string"))
    number = F.when(kind.rlike(_NUMERIC), _get(answer, name, "double"))
    value = (
        F.when(kind == "BOOLEAN", _get(answer, name, "boolean"))
        .when(kind.rlike(_NUMERIC), number == 1.0)
        .when(kind == "STRING", word.isin(TRUE_WORDS))
        .otherwise(F.lit(False))
    )
    usable = (
        kind.isNull()
        | (kind == "BOOLEAN")
        | is_true(number.isin([0.0, 1.0]))
        | ((kind == "STRING") & word.isin([*TRUE_WORDS, *FALSE_WORDS]))
    )
    return is_true(value), is_true(usable)


def _truthy(answer: Column, name: str) -> Column:
    """Whether the raw field counts as true, as a condition on it would."""
    kind = _kind(answer, name)
    return is_true(
        F.when(kind == "BOOLEAN", _get(answer, name, "boolean"))
        .when(kind.rlike(_NUMERIC), _get(answer, name, "double") != 0.0)
        .when(kind == "STRING", F.length(_get(answer, name, "string")) > 0)
    )


def _unit(answer: Column, name: str, default: Column) -> tuple[Column, Column]:
    """(number with default, whether the field is absent or a number in [0, 1])."""
    kind, value = _kind(answer, name), _get(answer, name, "double")
    usable = kind.isNull() | (
        (kind.rlike(_NUMERIC) | kind.isin("STRING", "BOOLEAN")) & is_true(value.between(0.0, 1.0))
    )
    return F.coalesce(value, default), is_true(usable)


def _strings(answer: Column, name: str) -> tuple[Column, Column]:
    kind, value = _kind(answer, name), _get(answer, name, "array<string>")
    no_null = ~F.exists(value, lambda item: item.isNull())
    usable = kind.isNull() | (kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & is_true(no_null))
    return F.coalesce(value, strings()), is_true(usable)


def _text(answer: Column, name: str, default: Column) -> tuple[Column, Column]:
    """(text, whether usable); an explicit null stays NULL."""
    kind = _kind(answer, name)
    value = F.when(kind.isNull(), default).otherwise(_get(answer, name, "string"))
    return value, is_true(kind.isNull() | kind.isin("STRING", "VOID"))


def _scores(answer: Column, name: str) -> tuple[Column, Column]:
    kind, value = _kind(answer, name), _get(answer, name, "map<string,double>")
    complete = ~F.exists(F.map_values(value), lambda score: score.isNull())
    usable = kind.isNull() | (kind.startswith("OBJECT") & is_true(complete))
    return F.coalesce(value, F.create_map().cast("map<string,double>")), is_true(usable)


def answer_fields(kind: str, answer: Column) -> dict[str, tuple[Column, Column]]:
    """Verdict field -> (value, usable) for a guardrail type, from the parsed answer."""
    null = F.lit(None).cast("string")
    empty = F.lit("")
    if kind == "pii_detection":
        default = F.when(_truthy(answer, "has_pii"), F.lit(1.0)).otherwise(F.lit(0.0))
        return {
            "has_pii": _bool(answer, "has_pii"),
            "pii_types": _strings(answer, "pii_types"),
            "redacted_text": _text(answer, "redacted_text", null),
            "details": _text(answer, "details", null),
            "confidence": _unit(answer, "confidence", default),
        }
    if kind == "toxicity":
        return {
            "is_toxic": _bool(answer, "is_toxic"),
            "toxicity_score": _unit(answer, "toxicity_score", F.lit(0.0)),
            "categories": _strings(answer, "categories"),
            "details": _text(answer, "details", empty),
            "category_scores": _scores(answer, "category_scores"),
        }
    if kind == "prompt_injection":
        return {
            "is_injection": _bool(answer, "is_injection"),
            "injection_score": _unit(answer, "injection_score", F.lit(0.0)),
            "injection_types": _strings(answer, "injection_types"),
            "details": _text(answer, "details", empty),
            "suspicious_patterns": _strings(answer, "suspicious_patterns"),
        }
    return {
        "requests_sensitive_data": _bool(answer, "requests_sensitive_data"),
        "sensitive_types": _strings(answer, "sensitive_types"),
        "details": _text(answer, "details", null),
    }


def ingest(
    requests: DataFrame,
    answers: DataFrame,
    kind: str,
    text: str = "prompt",
    key: str = "request_id",
    signal: Column | None = None,
) -> DataFrame:
    """Join stored answers (``key``, ``answer``) to the requests and add the verdict column of ``kind``.

    ``signal`` is an optional verdict that comes before the answer (see ``safety_signal``), NULL where there is none.
    Of several answers to one request the latest counts (by ``timestamp``, where the answers have one), and of those the
    greatest. So the join is a plain equi-join with one answer per request: it neither repeats requests nor skews.
    """
    name = VERDICT[kind]
    order = F.struct(*[c for c in ("timestamp", "answer") if c in answers.columns])
    latest = answers.groupBy(key).agg(F.max(order).getField("answer").alias("_answer"))
    joined = requests.join(latest, key, "left")
    fields = answer_fields(kind, F.col("_parsed"))
    parsed = joined.withColumn("_parsed", parse_answer(F.col("_answer")))
    accepted = F.col("_parsed").isNotNull() & reduce(and_, [usable for _, usable in fields.values()])
    verdict = F.when(F.col("_accepted"), F.struct(*[value.alias(field) for field, (value, _) in fields.items()]))
    parsed = parsed.withColumn("_accepted", accepted).withColumn("_from_answer", verdict)
    if signal is not None:
        parsed = parsed.withColumn("_from_answer", F.coalesce(signal, "_from_answer"))
    parsed = parsed.withColumn(
        "_rules_for", F.when(F.col("_from_answer").isNull(), strings(kind)).otherwise(strings())
    )
    scored = detect(parsed, text, [kind], wanted="_rules_for")
    return scored.withColumn(name, F.coalesce(F.col("_from_answer"), F.col(name))).drop(
        "_answer", "_parsed", "_accepted", "_from_answer", "_rules_for"
    )


def ingest_pii(requests: DataFrame, answers: DataFrame, text: str = "prompt") -> DataFrame:
    return ingest(requests, answers, "pii_detection", text)


def ingest_toxicity(
    requests: DataFrame, answers: DataFrame, text: str = "prompt", signal: Column | None = None
) -> DataFrame:
    return ingest(requests, answers, "toxicity", text, signal=signal)


def ingest_injection(requests: DataFrame, answers: DataFrame, text: str = "prompt") -> DataFrame:
    return ingest(requests, answers, "prompt_injection", text)


def ingest_sensitive(requests: DataFrame, answers: DataFrame, text: str = "prompt") -> DataFrame:
    return ingest(requests, answers, "sensitive_request", text)


def safety_signal(block_reason: Column, ratings: Column, error: Column) -> Column:
    """Toxicity verdict from a provider's block signal, NULL when the provider did not block.

    ``ratings`` is array<struct<category, probability>>. A blocked prompt lists its MEDIUM and HIGH categories; of
    a repeated category the last score counts. A refused call is one whose error mentions blocking or safety.
    """
    last_part = lambda c: F.element_at(F.split(c, r"\."), -1)
    rated = F.transform(
        F.coalesce(ratings, F.array().cast("array<struct<category:string,probability:string>>")),
        lambda r: F.struct(
            F.lower(last_part(r["category"])).alias("category"),
            F.when(last_part(r["probability"]) == "HIGH", F.lit(RATING_SCORES["HIGH"]))
            .when(last_part(r["probability"]) == "MEDIUM", F.lit(RATING_SCORES["MEDIUM"]))
            .alias("score"),
        ),
    )
    listed = F.filter(rated, lambda r: r["score"].isNotNull())
    categories = F.transform(listed, lambda r: r["category"])
    names = F.array_distinct(categories)
    last_score = lambda name: F.element_at(F.filter(listed, lambda r: r["category"] == name), -1)["score"]
    scores = F.map_from_arrays(names, F.transform(names, last_score))
    blocked = is_true(F.length(block_reason) > 0)
    message = F.lower(error)
    refused = is_true(message.contains("blocked") | message.contains("safety"))
    return F.when(
        blocked,
        F.struct(
            F.lit(True).alias("is_toxic"),
            F.lit(BLOCKED_SCORE).alias("toxicity_score"),
            F.when(F.size(categories) > 0, categories).otherwise(strings(BLOCKED_CATEGORY)).alias("categories"),
            F.concat(F.lit(BLOCKED_PREFIX), block_reason).alias("details"),
            scores.alias("category_scores"),
        ),
    ).when(
        refused,
        F.struct(
            F.lit(True).alias("is_toxic"),
            F.lit(REFUSED_SCORE).alias("toxicity_score"),
            strings(BLOCKED_CATEGORY).alias("categories"),
            F.concat(F.lit(BLOCKED_PREFIX), error).alias("details"),
            F.create_map().cast("map<string,double>").alias("category_scores"),
        ),
    )


def token_usage(usage: DataFrame) -> DataFrame:
    """Token sums and price per request over its guardrail calls; NULL where no token was counted.

    ``usage``: request_id, prompt_tokens, completion_tokens, total_tokens, one row per call; missing counts are 0.
    """
    count = lambda name: F.coalesce(F.sum(name), F.lit(0))
    sums = usage.groupBy("request_id").agg(
        count("prompt_tokens").alias("prompt_tokens"),
        count("completion_tokens").alias("completion_tokens"),
        count("total_tokens").alias("total_tokens"),
    )
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return sums.select(
        "request_id",
        F.when(
            F.col("total_tokens") > 0,
            F.struct("prompt_tokens", "completion_tokens", "total_tokens", cost.alias("estimated_cost")),
        ).alias("token_usage"),
    )
