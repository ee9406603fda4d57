"""Structured Streaming jobs. ``session_counters`` serves streams as it is. Each builder takes a streaming DataFrame; the runners at the end attach the sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from govlens.operators.access import classify_access
from govlens.operators.common import spread
from govlens.operators.conversations import session_counters
from govlens.plans.screening import screen_batch
from govlens.sources import batches
from govlens.sources.tables import BATCH_ID, COMPACTED, write_batch

__all__ = [
    "abandonments",
    "activity_sessions",
    "compact_changes",
    "current",
    "daily_counts",
    "deduplicated",
    "key_usage",
    "run_append",
    "run_screening",
    "run_update",
    "update_writer",
    "session_counters",
]


def daily_counts(audit: DataFrame, late: str = "1 day") -> DataFrame:
    """Checks per day, kept current; a day closes ``late`` after its end."""
    return (
        audit.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(F.col("status") == "blocked").alias("blocked_requests"),
            F.count_if(F.col("status") == "passed").alias("passed_requests"),
            F.count_if("has_pii").alias("pii_incidents"),
            F.approx_count_distinct("user_id").alias("approx_users"),
        )
        .select(F.to_date("window.start").alias("date"), "*")
        .drop("window")
    )


def deduplicated(audit: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per request and guardrail type; repeats within the watermark are dropped."""
    return audit.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["request_id", "guardrail_type"])


def activity_sessions(
    events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour"
) -> DataFrame:
    """Periods of activity of a user (or another ``key``): a pause longer than ``gap`` ends one."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy(F.session_window("timestamp", gap).alias("session"), key)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("session.start").alias("started_at"), F.col("session.end").alias("ends_at"), "n_events")
    )


def abandonments(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """End events (session_id, status, ended_at) of conversations that fell silent, for ``end_conversations``.

    A conversation that resumes and falls silent again ends again later; the latest end counts there.
    """
    return activity_sessions(messages, "session_id", gap, late).select(
        "session_id", F.lit("abandoned").alias("status"), F.col("ends_at").alias("ended_at")
    )


def key_usage(access: DataFrame, keys: DataFrame) -> DataFrame:
    """The latest valid use per key, from arriving access events and a static key table."""
    valid = classify_access(access, keys).filter(F.col("status") == "valid")
    return valid.groupBy("key_id").agg(F.max("ts").alias("last_used_at"))


def _start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start a query: over what is available now, or, with ``every``, again and again at that interval."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_screening(
    requests: DataFrame, root: str, checkpoint: str, name: str = "screening", every: str | None = None
) -> StreamingQuery:
    """Screen arriving prompts into the audit table below ``root``; rejected requests go to its dead letters.

    Each micro-batch is one batch of the table, named after the stream (``name`` must be unique among the streams
    that write to the table). A batch that is repeated after a failure replaces its rows, so every request is written
    once. No state; rows move between tasks only when a batch has fewer partitions than cores.
    """
    def write(batch: DataFrame, number: int) -> None:
        screen_batch(spread(batch, "request_id", "timestamp"), batch, root, f"{name}-{number}")

    return _start(requests.writeStream.foreachBatch(write), checkpoint, every)


def run_append(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append finished rows to Parquet files (exactly once)."""
    return _start(rows.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, every)


def update_writer(rows: DataFrame, path: str) -> DataStreamWriter:
    """Writes the groups each batch changed, with the version of the batch."""
    run = time.time_ns() // 1_000

    def write(batch: DataFrame, number: int) -> None:
        version = F.struct(F.lit(run).alias("run"), F.lit(number).cast("long").alias("batch"))
        write_batch(batch.withColumn("version", version), path, f"{run}-{number}")

    return rows.writeStream.foreachBatch(write).outputMode("update")


def run_update(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the groups each batch changed; the newest batch of a group holds its current values.

    Batches are ordered by the start of the run and their number in it: with a new checkpoint the numbers begin anew.
    ``compact_changes`` merges what has piled up.
    """
    return _start(update_writer(rows, path), checkpoint, every)


def current(changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The newest state per key from the files of ``run_update``."""
    newest = F.max(F.struct("version", *values)).alias("_newest")
    return changes.groupBy(key).agg(newest).select(key, *[f"_newest.{v}" for v in values])


def compact_changes(spark: SparkSession, path: str, key: str) -> None:
    """Keep only the newest row of each key among the batches of ``run_update`` that have ended.

    The kept rows are written as one more batch before the others go, and they carry their version: a reader that sees
    both finds the same newest rows, and one that sees either misses nothing. Run it between runs of the stream, or at
    any time for batches that are done: batches that are written meanwhile stay.
    """
    done = batches.records(spark, path)
    rows = spark.read.parquet(path).filter(F.col(BATCH_ID).isin(sorted(done))).drop(BATCH_ID)
    values = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*values), "version").alias("_newest"))
    write_batch(newest.select(key, "_newest.*").select(*rows.columns), path, f"{COMPACTED}-{time.time_ns()}")
    for batch in done:
        batches.delete(spark, f"{path}/{BATCH_ID}={batch}")
        batches.forget(spark, path, batch)
