"""Governance tables on Parquet: schemas applied on read, day partitions on write."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.operators.hygiene import dead_letters, split_valid
from govlens.schemas import TABLES, Table
from govlens.sources import batches

EVENT_DATE = "event_date"
BATCH_ID = "batch_id"
# What the record of a batch without days names, if it has rows.
WHOLE = "all"
COMPACTED = "compacted"


def path_of(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{TABLES[name].name}"


def stored_schema(table: Table) -> T.StructType:
    """The table's columns plus its partition columns."""
    if table.event_time is None:
        return table.schema
    return T.StructType(
        [
            *table.schema.fields,
            T.StructField(EVENT_DATE, T.DateType(), True),
            T.StructField(BATCH_ID, T.StringType(), True),
        ]
    )


def create_tables(spark: SparkSession, root: str, database: str = "default") -> list[str]:
    """Register the six tables in the catalog, at their paths below ``root``, unless they exist."""
    for table in TABLES.values():
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
            for f in stored_schema(table).fields
        )
        partitioned = f"PARTITIONED BY ({EVENT_DATE}, {BATCH_ID})" if table.event_time else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table.name} ({columns}) USING parquet {partitioned} "
            f"LOCATION '{path_of(root, table.name)}'"
        )
    return [f"{database}.{name}" for name in TABLES]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its fixed schema; empty when it has not been written yet."""
    schema = stored_schema(TABLES[name])
    try:
        return spark.read.schema(schema).parquet(path_of(root, name))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def with_event_date(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order, with the day partition derived from the event time."""
    table = TABLES[name]
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    out = df.select(*fields)
    return out if table.event_time is None else out.withColumn(EVENT_DATE, F.to_date(table.event_time))


def _folder(spark: SparkSession, path: str, batch_id: str, day: str | None) -> str:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
    return "/".join([path, *([] if day is None else [f"{EVENT_DATE}={day}"]), f"{BATCH_ID}={name}"])


def _days_on_disk(spark: SparkSession, path: str, batch_id: str) -> set[str]:
    """The days of a batch without a record that can be relied on: the only case in which all days are listed."""
    return {
        name.removeprefix(f"{EVENT_DATE}=")
        for name in batches.names(spark, path)
        if name.startswith(f"{EVENT_DATE}=") and batches.exists(spark, _folder(spark, path, batch_id, name.partition("=")[2]))
    }


def write_batch(df: DataFrame, path: str, batch_id: str, by: list[str] | None = None) -> None:
    """Write rows into partitions (by ..., batch_id) and replace all that the same batch wrote before.

    ``by`` is nothing or the day. The days are observed while the rows are written, and kept in the batch's record (see
    ``batches``). Partitions that the batch writes again are replaced by the write; those that its last record names and
    that it no longer has are dropped after it. No other folder is looked at.
    """
    if by not in (None, [], [EVENT_DATE]):
        raise ValueError(f"batches are written by {EVENT_DATE} or as a whole, not by {by}")
    spark = df.sparkSession
    last = batches.known(spark, path, batch_id)
    if last is not None:
        before = set(last.days)
    elif batches.written_before(spark, path, batch_id) or not batches.exists(spark, f"{path}/{batches.FOLDER}"):
        before = _days_on_disk(spark, path, batch_id) if by else {WHOLE}
    else:
        before = set()
    batches.begin(spark, path, batch_id)
    seen = Observation()
    values = F.collect_set(F.coalesce(F.col(by[0]).cast("string"), F.lit(batches.NO_DAY)) if by else F.lit(WHOLE))
    (
        df.observe(seen, values.alias("days"))
        .withColumn(BATCH_ID, F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*(by or []), BATCH_ID)
        .parquet(path)
    )
    after = sorted(seen.get["days"] or [])
    for day in sorted(before - set(after)):
        batches.delete(spark, _folder(spark, path, batch_id, day if by else None))
    batches.record(spark, path, batch_id, batches.Record(tuple(after)))


def append(
    df: DataFrame, root: str, name: str, batch_id: str | None = None, rebalance: bool = True
) -> None:
    """Append rows to a table.

    A fact table is partitioned by day and batch. Give a ``batch_id`` to make the write repeatable: a second run of
    the same batch replaces its rows. With ``rebalance`` the rows of a day are brought together before the write, so
    that a day is few large files instead of one small file per task; the rebalance hint lets Spark split a day that
    is far larger than others over several tasks. Leave it out when the input is already laid out by day.
    """
    rows = with_event_date(df, name)
    if TABLES[name].event_time is None:
        rows.write.mode("append").parquet(path_of(root, name))
        return
    if rebalance:
        rows = rows.hint("rebalance", EVENT_DATE)
    write_batch(rows, path_of(root, name), batch_id or uuid.uuid4().hex, [EVENT_DATE])


def compact(spark: SparkSession, root: str, name: str, before: str) -> None:
    """Merge the batches of a fact table's days before ``before`` into one batch a day, with few large files.

    The days must be closed: no batch of theirs may run at the same time or again later. Their rows are first written
    whole to a hidden folder of the table, which no reader sees. Then each day's folder is put aside and the merged one
    takes its place: two moves of a folder with nothing written in between. A reader finds the old batches of a day or the
    merged one, never both; one that lists the table between the two moves misses that day. The old ones go last. A run that was interrupted is taken up by the next one where it stopped.
    """
    path = path_of(root, name)
    staged, old = f"{path}/_compaction", f"{path}/_replaced"
    if batches.known(spark, staged, COMPACTED) is None:
        batches.delete(spark, staged)
        closed = read_table(spark, root, name).filter(F.col(EVENT_DATE) < F.lit(before).cast("date"))
        write_batch(closed.drop(BATCH_ID).hint("rebalance", EVENT_DATE), staged, COMPACTED, [EVENT_DATE])
    merged = batches.known(spark, staged, COMPACTED)
    for day in [n for n in batches.names(spark, staged) if n.startswith(f"{EVENT_DATE}=")]:
        if batches.exists(spark, f"{path}/{day}"):
            batches.delete(spark, f"{old}/{day}")
            batches.rename(spark, f"{path}/{day}", f"{old}/{day}")
        batches.rename(spark, f"{staged}/{day}", f"{path}/{day}")
    done = set(merged.days)
    for batch, record in batches.records(spark, path).items():
        left = tuple(day for day in record.days if day not in done)
        if batch == COMPACTED:
            done |= set(left)
        elif not left:
            batches.forget(spark, path, batch)
        elif left != record.days:
            batches.record(spark, path, batch, batches.Record(left, record.run))
    batches.record(spark, path, COMPACTED, batches.Record(tuple(sorted(done)), merged.run))
    batches.delete(spark, old)
    batches.delete(spark, staged)


def append_audit(rows: DataFrame, root: str, batch_id: str | None = None) -> None:
    """Append audit rows; rows that lack required fields or break a constraint are kept as dead letters instead."""
    batch_id = batch_id or uuid.uuid4().hex
    good, rejected = split_valid(rows, "audit_logs")
    append(good, root, "audit_logs", batch_id)
    write_batch(dead_letters(rejected, whole=True), dead_letter_path(root, "audit_logs"), batch_id)


def dead_letter_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/dead_letters/{name}"


def export_jsonl(conversations: DataFrame, path: str, params: dict) -> dict:
    """Write exported conversations as JSON lines, and a manifest with the parameters and their number.

    The number is observed while the lines are written: a conversation counts once, at its part 0.
    """
    seen = Observation()
    counted = conversations.observe(seen, F.count_if(F.col("part") == 0).alias("total_conversations"))
    counted.write.mode("overwrite").json(f"{path}/conversations")
    manifest = {"export_params": params, "total_conversations": seen.get["total_conversations"]}
    spark = conversations.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    return manifest
