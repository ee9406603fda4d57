"""Positions of rows within their key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.operators.common import join_dimension, stored

# monotonically_increasing_id keeps the partition above this bit and the row within it below.
ROW_BITS = 33


def named(key: Column) -> Column:
    """A key as text that is never null: null and the empty text differ."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``position`` (from 0, by ``order`` within ``key``, nulls first) and ``members`` (rows of the key).

    Rows are sorted by ranges of (key, order) and stored, so a key with a third of all rows lies in many ranges. A
    row's position is its place in its range, moved by what the key has in the ranges before: one number per range and
    key. Rows that are equal in all of these columns may share a range border; which of them comes first is then as
    Spark met them, and stays as stored. The input is read twice (ranges are sampled first): store what is dear.
    """
    by = [key, *order, "_row"]
    placed = (
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_row")
    )
    part = F.shiftright("_place", ROW_BITS)
    rows = stored(placed, name).withColumn("_slot", F.concat_ws(":", part.cast("string"), named(F.col(key))))
    counted = rows.groupBy("_slot", F.col(key), part.alias("_part")).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slots = counted.select(
        "_slot",
        (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"),
        F.sum("_n").over(whole).alias("members"),
    )
    joined = join_dimension(rows, stored(slots, f"{name}-ranges"), "_slot", salt_by=["_place"])
    return joined.withColumn("position", F.col("_place") - F.col("_shift")).drop("_slot", "_place", "_shift")
