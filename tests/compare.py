"""Run registered queries next to their DuckDB statements. Usage: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# Plan nodes that no query may have: cross joins, nested loops and Python workers.
UNWANTED = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
    "FlatMapGroupsInPandas", "PythonUDF",
]


def duck(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _key(row):
    return tuple((value is None, str(type(value)), str(value)) for value in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key), dict(df.dtypes)


def rows_of_duck(connection, sql: str):
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    rows = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=_key)
    return names, rows, {c[0]: str(c[1]) for c in cursor.description}


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b and type(a) is type(b)


def difference(spark_rows, duck_rows) -> str | None:
    if len(spark_rows) != len(duck_rows):
        only_spark = [r for r in spark_rows if r not in set(duck_rows)][:2]
        only_duck = [r for r in duck_rows if r not in set(spark_rows)][:2]
        return f"rows {len(spark_rows)} != {len(duck_rows)}; spark only {only_spark}; duckdb only {only_duck}"
    for left, right in zip(spark_rows, duck_rows, strict=True):
        if not all(same(x, y) for x, y in zip(left, right, strict=True)):
            return f"spark {left}\n      duckdb {right}"
    return None


def compare(spark, connection, name: str, run, sql: str | None, sf_dir: str) -> str | None:
    """None when both results are equal, else what differs. Without SQL only the row count is checked."""
    df = run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [node for node in UNWANTED if node in plan]
    if found:
        return f"plan has {found}"
    names, rows, _ = rows_of_spark(df)
    if sql is None:
        return None if rows else "no rows"
    duck_names, duck_rows, _ = rows_of_duck(connection, sql)
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    if not rows:
        return "no rows"
    return difference(rows, duck_rows)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from govlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            found = compare(spark, connection, name, queries()[name], oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if found is None else found[:1800]}")
    print(f"{len(chosen)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
