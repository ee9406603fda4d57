"""The stored daily parts of the audit table, kept current batch by batch.

Every batch of a fact table leaves a record of its run and its days. The rollup keeps a ledger of the runs it has seen. A
refresh compares the two lists, reads the days of batches that are new, were replaced or are gone, and rewrites the parts
of those days only. A second refresh finds nothing to do. A refresh that is interrupted is repeated by the next one: the
ledger is written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.operators.rollups import daily_parts, daily_users
from govlens.sources import batches
from govlens.sources.tables import EVENT_DATE, path_of, read_table

PARTS = {"usage_daily": daily_parts, "users_daily": daily_users}


def parts_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/rollups/{name}"


def read_parts(spark: SparkSession, root: str, name: str = "usage_daily") -> DataFrame:
    """The stored parts; without rows before the first refresh."""
    schema = PARTS[name](read_table(spark, root, "audit_logs").limit(0)).schema
    path = parts_path(root, name)
    return spark.read.schema(schema).parquet(path) if batches.exists(spark, path) else spark.createDataFrame([], schema)


def stale_days(spark: SparkSession, root: str) -> tuple[list[str], dict[str, batches.Record], list[str]]:
    """Days to compute anew, the records of batches that the ledger lacks, and batches of the ledger that are gone."""
    written = batches.records(spark, path_of(root, "audit_logs"))
    rolled = batches.records(spark, parts_path(root, "ledger"))
    new = {b: r for b, r in written.items() if b not in rolled or rolled[b].run != r.run}
    gone = sorted(set(rolled) - set(written))
    touched = [*new.values(), *[rolled[b] for b in [*new, *gone] if b in rolled]]
    return sorted({day for record in touched for day in record.days}), new, gone


def refresh(spark: SparkSession, root: str) -> list[str]:
    """Bring the parts up to date; the days that were computed anew.

    Rows of a day outside the calendar (no event time) belong to no day and are not in the parts.
    """
    days, new, gone = stale_days(spark, root)
    chosen = [day for day in days if day != batches.NO_DAY]
    if chosen:
        listed = [F.lit(day).cast("date") for day in chosen]
        audit = read_table(spark, root, "audit_logs").filter(F.col(EVENT_DATE).isin(*listed))
        for name, make in PARTS.items():
            rows = make(audit)
            (
                rows.repartition(EVENT_DATE)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(EVENT_DATE)
                .parquet(parts_path(root, name))
            )
        present = {str(r[0]) for r in read_parts(spark, root).select(EVENT_DATE).distinct().filter(F.col(EVENT_DATE).isin(*listed)).collect()}
        kept = {str(r[0]) for r in audit.select(EVENT_DATE).distinct().collect()}  # at most the days of this refresh
        for day in present - kept:  # all batches of the day are gone
            for name in PARTS:
                batches.delete(spark, f"{parts_path(root, name)}/{EVENT_DATE}={day}")
    for batch in gone:
        batches.forget(spark, parts_path(root, "ledger"), batch)
    for batch, record in new.items():
        batches.record(spark, parts_path(root, "ledger"), batch, record)
    return days
