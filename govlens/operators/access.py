"""API keys: hashing, access classification, last use, inventory, revocation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.operators.common import first_per_key, join_dimension, moment, only
from govlens.operators.hygiene import apply_defaults
from govlens.schemas import API_KEYS

PREFIX_LENGTH = 12


def key_hash(plain: Column) -> Column:
    """SHA-256 of the key, in hex."""
    return F.sha2(plain, 256)


def key_prefix(plain: Column) -> Column:
    """The first characters of the key, for display."""
    return F.concat(F.substring(plain, 1, PREFIX_LENGTH), F.lit("..."))


def hash_keys(created: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Key rows from (key_id, agent_id, plain_key, ...): hash and prefix instead of the key, expiry after n days."""
    filled = apply_defaults(created, "key")
    when = F.coalesce("created_at", moment(as_of)) if "created_at" in created.columns else moment(as_of)
    filled = filled.withColumn("created_at", when)
    if "description" not in filled.columns:
        filled = filled.withColumn("description", F.lit(None).cast("string"))
    return filled.withColumns(
        {
            "key_hash": key_hash(F.col("plain_key")),
            "key_prefix": key_prefix(F.col("plain_key")),
            "expires_at": F.col("created_at") + F.make_dt_interval(days=F.col("expires_days")),
            "last_used_at": F.lit(None).cast("timestamp"),
            "is_active": F.lit(True),
        }
    ).select(*API_KEYS.schema.fieldNames())


def attribute_access(access: DataFrame, keys: DataFrame) -> DataFrame:
    """Match access events (presented_key, ts) to the key with the same hash; unmatched events keep NULLs.

    One key row per hash is used. The presented key is dropped: it is a secret.
    """
    known = first_per_key(keys, "key_hash", F.asc("key_id")).select(
        "key_hash", "key_id", "agent_id", "expires_at", "is_active"
    )
    hashed = access.withColumn("key_hash", key_hash(F.col("presented_key"))).drop("presented_key")
    return join_dimension(hashed, known, "key_hash", salt_by=hashed.columns, large=True)


def access_status(at: str = "ts") -> Column:
    """unknown, inactive, expired or valid, checked in this order."""
    return (
        F.when(F.col("key_id").isNull(), "unknown")
        .when(~F.col("is_active"), "inactive")
        .when(F.col("expires_at") < F.col(at), "expired")
        .otherwise("valid")
    )


def classify_access(access: DataFrame, keys: DataFrame, at: str = "ts") -> DataFrame:
    """Each access event with its status; key and agent only for valid ones."""
    matched = attribute_access(access, keys).withColumn("status", access_status(at))
    valid = F.col("status") == "valid"
    return matched.withColumns(
        {"key_id": F.when(valid, F.col("key_id")), "agent_id": F.when(valid, F.col("agent_id"))}
    ).drop("key_hash", "expires_at", "is_active")


def latest_use(classified: DataFrame, at: str = "ts") -> DataFrame:
    """The latest valid use per key."""
    return (
        classified.filter(F.col("status") == "valid").groupBy("key_id").agg(F.max(at).alias("last_use"))
    )


def last_used(keys: DataFrame, access: DataFrame, at: str = "ts") -> DataFrame:
    """Keys with last_used_at moved to their latest valid use."""
    return (
        keys.join(latest_use(classify_access(access, keys, at), at), "key_id", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "last_use"))
        .drop("last_use")
    )


def agent_keys(keys: DataFrame, agent_id: str | None = None) -> DataFrame:
    """Key inventory without hashes, newest first."""
    return (
        only(keys, agent_id=agent_id)
        .select(
            "agent_id", "key_id", "key_prefix", "description", "created_at", "expires_at", "last_used_at", "is_active"
        )
        .orderBy("agent_id", F.desc("created_at"), "key_id")
    )


def revoke_keys(keys: DataFrame, revoked: DataFrame) -> DataFrame:
    """Deactivate the keys listed in ``revoked`` (key_id)."""
    listed = revoked.select("key_id").distinct().withColumn("_revoked", F.lit(True))
    return (
        keys.join(listed, "key_id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_revoked").isNull())
        .drop("_revoked")
    )
