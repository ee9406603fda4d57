"""Small column helpers: label lists, JSON string columns, text measures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlens.functions import patterns as P


def strings(*values: str) -> Column:
    """An array<string> literal, also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def labels_where(flags: Iterable[tuple[str, Column]]) -> Column:
    """The labels whose flag is true, in the given order."""
    labels = F.array(*[F.when(flag, F.lit(label)) for label, flag in flags])
    return F.array_compact(labels.cast("array<string>"))


def is_true(flag: Column) -> Column:
    """The flag, with NULL as false."""
    return F.coalesce(flag, F.lit(False))


def json_or_null(values: Column) -> Column:
    """A list or map as a JSON string; NULL when it is NULL or empty."""
    return F.when(F.size(values) > 0, F.to_json(values))


def json_strings(text: Column) -> Column:
    """A JSON string list as array<string>; the empty array when it is NULL, empty or no list."""
    return F.coalesce(F.from_json(text, "array<string>"), strings())


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(P.WHITESPACE))


def strip_code_fence(text: Column) -> Column:
    """The JSON part of a model answer: inside the first ```json fence, else the first fence, else all of it."""
    trimmed = strip(text)

    def fenced(mark: str) -> Column:
        return strip(F.split_part(F.split_part(trimmed, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)))

    return (
        F.when(trimmed.contains("```json"), fenced("```json"))
        .when(trimmed.contains("```"), fenced("```"))
        .otherwise(trimmed)
    )


def token_estimate(text: Column) -> Column:
    """Approximate number of tokens: code points divided by four, rounded down."""
    return F.floor(F.length(text) / F.lit(P.CHARS_PER_TOKEN))


def token_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Estimated price of a model call in dollars."""
    million = F.lit(1_000_000.0)
    return prompt_tokens / million * F.lit(P.PROMPT_PRICE_PER_MILLION) + completion_tokens / million * F.lit(
        P.COMPLETION_PRICE_PER_MILLION
    )
