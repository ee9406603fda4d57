from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, None, "en", "a", 5, "x"),
        (2, "", "en", None, 0, "x"),
        (3, " \t\n ", None, "a", 3, None),
        (4, "One two three four five six.", "en", "b", 29, "x"),
        (4, "One two three four five six.", "en", "b", 29, "x"),
        (None, "One two three four five six.", "en", "b", 29, "x"),
        (None, None, None, None, None, None),
        (5, "ONE TWO  THREE\tFOUR five six.", "de", "b", 29, "x"),
        (6, "a " * 30_000, "fr", "c", 60_000, "x"),
        (7, "été à l'œuvre 42 \U0001f600", "fr", "c", 17, "x"),
        (8, "z", "de", "c", 1, "x"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, _chunk int, score string"
    )
