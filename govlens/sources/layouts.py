"""Tables laid out for joins by one key: bucketed and sorted, so that views and exports shuffle no messages.

Conversations and their messages are bucketed by session, audit rows by request, into the same number of buckets. A join or
a grouping by that key then reads matching buckets side by side. The layout pays for tables that are read often and written
rarely, such as closed days; a table is written as a whole and replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bytes of a bucket that one task reads at a time.
BUCKET_BYTES = 256 << 20


def buckets_for(size: int, least: int) -> int:
    """A number of buckets for so many bytes: a power of two, so that tables of other sizes still match by halves."""
    wanted = max(1, least, -(-size // BUCKET_BYTES))
    return 1 << (wanted - 1).bit_length()


def save_bucketed(df: DataFrame, table: str, path: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """Write rows as the catalog table ``table`` at ``path``, bucketed by ``key`` and sorted by (key, order) in a bucket.

    Rows are brought together by bucket before the write, so a bucket is one file and not one per task. A session that is
    far larger than others makes one large bucket: its file is split into several tasks where no grouping needs it whole.
    """
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return df.sparkSession.table(table)


def save_sessions(
    conversations: DataFrame, messages: DataFrame, prefix: str, root: str, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages as the tables ``<prefix>_conversations`` and ``<prefix>_messages`` below ``root``."""
    order = ["turn_number", "timestamp", "message_id"]
    return (
        save_bucketed(conversations, f"{prefix}_conversations", f"{root}/conversations", "session_id", [], buckets),
        save_bucketed(messages, f"{prefix}_messages", f"{root}/messages", "session_id", order, buckets),
    )


def save_requests(
    audit: DataFrame, feedback: DataFrame, prefix: str, root: str, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Audit rows and feedback by request, for ``feedback_to_session``: only one rating per request and session moves on."""
    return (
        save_bucketed(audit, f"{prefix}_audit", f"{root}/audit", "request_id", ["timestamp"], buckets),
        save_bucketed(feedback, f"{prefix}_feedback", f"{root}/feedback", "request_id", ["timestamp"], buckets),
    )


def drop_tables(spark: SparkSession, prefix: str) -> None:
    """Forget the tables of a prefix; their files stay."""
    for table in spark.catalog.listTables():
        if table.name.startswith(f"{prefix}_"):
            spark.sql(f"DROP TABLE {table.name}")


def exchanges(df: DataFrame) -> list[str]:
    """What a plan shuffles: the keys of its exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ", 1)[1] for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
