"""Registration of queries, and how their results are put in comparable form.

Arrays become joined strings and timestamps become text in a registered query only, so that two engines' results can
be compared value by value. The operators themselves return arrays and timestamps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


def second(moment: str | Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def day(moment: str | Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def sql_second(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m-%d %H:%M:%S')"


def sql_day(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m-%d')"


def sql_list(*pairs: tuple[str, str]) -> str:
    """The labels whose condition holds, joined by commas; '' when none does."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{label}' END" for label, condition in pairs) + ")"
