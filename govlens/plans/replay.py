"""Rejected rows come back: dead letters are mended and written as if they had been right from the start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.operators.hygiene import dead_letters, restored, split_valid
from govlens.plans.screening import rejected_summary, screen
from govlens.schemas import AUDIT_LOGS
from govlens.sources import batches
from govlens.sources.tables import BATCH_ID, append, dead_letter_path, write_batch

Mend = Callable[[DataFrame], DataFrame]

# Batches that a replay writes: the mended rows of a batch, and those that are still rejected.
REPLAY = "replay-"

_FIELDS = ["request_id", "timestamp", "agent_id", "user_id", "department", "session_id", "prompt"]
REQUEST = T.StructType(
    [T.StructField(f, T.TimestampType() if f == "timestamp" else T.StringType()) for f in _FIELDS]
    + [T.StructField("guardrails", T.ArrayType(T.StringType()))]
)


def letters(spark: SparkSession, root: str, name: str, batch_id: str) -> DataFrame | None:
    """The dead letters of one batch; None where there are none at all."""
    try:
        found = spark.read.parquet(dead_letter_path(root, name))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    return found.filter(F.col(BATCH_ID) == batch_id)


def replay_audit(spark: SparkSession, root: str, batch_id: str, mend: Mend) -> None:
    """Mend the rejected audit rows of a batch and append those that are valid now.

    ``mend`` gets the rows as they were given and returns them with the table's columns. The letters of the batch stay as
    they are, so the replay can be repeated, with the same or a better ``mend``: its rows are a batch of their own, which
    is replaced as a whole. Rows that are still rejected are the letters of that batch.
    """
    found = letters(spark, root, "audit_logs", batch_id)
    if found is None:
        return
    good, rejected = split_valid(mend(restored(found, AUDIT_LOGS.schema)), "audit_logs")
    append(good, root, "audit_logs", REPLAY + batch_id)
    write_batch(dead_letters(rejected, whole=True), dead_letter_path(root, "audit_logs"), REPLAY + batch_id)


def replay_requests(spark: SparkSession, root: str, batch_id: str, mend: Mend, schema: T.StructType = REQUEST) -> None:
    """Mend the rejected requests of a batch and screen them into the audit table; repeatable like ``replay_audit``."""
    found = letters(spark, root, "requests", batch_id)
    if found is None:
        return
    rows, rejected = screen(mend(restored(found, schema)))
    append(rows, root, "audit_logs", REPLAY + batch_id)
    write_batch(rejected_summary(rejected), dead_letter_path(root, "requests"), REPLAY + batch_id)


def open_letters(spark: SparkSession, root: str, name: str, batch_id: str) -> DataFrame | None:
    """The letters of a batch that are still to be mended: those of its replay, or all of them if there was none."""
    again = letters(spark, root, name, REPLAY + batch_id)
    replayed = batches.known(spark, dead_letter_path(root, name), REPLAY + batch_id)
    return again if replayed is not None else letters(spark, root, name, batch_id)
