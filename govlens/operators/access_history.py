"""API keys as they were at the time of an access: the history of keys, and an as-of join of accesses with it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.operators.access import access_status, key_hash, latest_use
from govlens.operators.common import join_dimension, stored

# One row per change of a key: what holds from ``valid_from`` on.
CHANGE_SCHEMA = (
    "key_hash string, key_id string, agent_id string, valid_from timestamp, expires_at timestamp, is_active boolean"
)
# Length of the time ranges that accesses and changes meet in.
RANGE = timedelta(days=1)


def key_changes(keys: DataFrame, switches: DataFrame) -> DataFrame:
    """The history of keys: a row when a key is made, and one for each switch (key_id, at, is_active) after that.

    ``keys`` are rows as ``hash_keys`` makes them. Their ``is_active`` counts for keys without a switch only: it says how
    a key is today, and a key with switches was active when it was made. A switch before the key was made, without a time,
    or of an unknown key, is ignored. Of several switches at one moment a revocation counts.
    """
    at_once = switches.filter(F.col("at").isNotNull()).groupBy("key_id", "at").agg(F.min("is_active").alias("is_active"))
    switched = at_once.select("key_id").distinct().withColumn("_switched", F.lit(True))
    names = [c.split()[0] for c in CHANGE_SCHEMA.split(", ")]
    made = keys.join(switched, "key_id", "left").withColumns(
        {"valid_from": F.col("created_at"), "is_active": F.col("is_active") | F.col("_switched").isNotNull()}
    )
    later = (
        keys.drop("is_active").join(at_once, "key_id").filter(F.col("at") >= F.col("created_at")).withColumnRenamed("at", "valid_from")
    )
    # A switch in the moment a key is made takes the place of the row that made it.
    return (
        made.select(*names, F.lit(0).alias("_n"))
        .unionByName(later.select(*names, F.lit(1).alias("_n")))
        .groupBy("key_hash", "key_id", "valid_from")
        .agg(F.max_by(F.struct("agent_id", "expires_at", "is_active"), "_n").alias("_state"))
        .select("key_hash", "key_id", "_state.agent_id", "valid_from", "_state.expires_at", "_state.is_active")
        .select(*names)
    )


def access_as_of(access: DataFrame, changes: DataFrame, at: str = "ts", length: timedelta = RANGE) -> DataFrame:
    """Each access event with its status by what its key was at that moment; key and agent only for valid ones.

    An as-of join on (hash, range of time). For every range in which a key is presented, its changes inside the range and
    the last one before it become one short array; the ranges come from a pre-aggregated scan of two columns. An access
    then meets one row of its key and range, and takes the latest change in it that is not after the access. The accesses
    of a hot key are spread over its ranges and, beyond the broadcast threshold, over salts.

    An access before its key was made is unknown; one at the very moment of a revocation is inactive. Of two keys with
    one hash, the one changed last counts, ties by the larger key_id. Accesses without a time or a key are unknown.
    """
    micros = length // timedelta(microseconds=1)
    range_of = lambda c: F.floor(F.unix_micros(c) / F.lit(micros))
    hashed = access.withColumns({"key_hash": key_hash(F.col("presented_key")), "_range": range_of(at)}).drop("presented_key")
    seen = hashed.select("key_hash", "_range").dropna().distinct()
    state = F.struct("valid_from", "key_id", "agent_id", "expires_at", "is_active")
    known = changes.dropna(subset=["key_hash", "valid_from"]).select("key_hash", state.alias("_state"))
    # Changes and ranges of a key in the order of time: each range is given the last change up to its start.
    changed_at = known.select("key_hash", F.unix_micros("_state.valid_from").alias("_at"), F.lit(0).alias("_kind"), "_state")
    begun = seen.join(known.select("key_hash").distinct(), "key_hash", "left_semi").select(
        "key_hash", (F.col("_range") * F.lit(micros)).alias("_at"), F.lit(1).alias("_kind"), "_range"
    )
    points = changed_at.unionByName(begun, allowMissingColumns=True)
    before = Window.partitionBy("key_hash").orderBy("_at", "_kind", "_state").rowsBetween(Window.unboundedPreceding, 0)
    carried = points.withColumn("_last", F.last("_state", ignorenulls=True).over(before)).filter("_kind = 1")
    inside = known.withColumn("_range", range_of(F.col("_state.valid_from")))
    in_ranges = carried.select("key_hash", "_range", F.col("_last").alias("_state")).unionByName(inside.select("key_hash", "_range", "_state"))
    place = F.concat_ws(" ", "key_hash", F.col("_range").cast("string"))
    states = (
        in_ranges.filter(F.col("_state").isNotNull())
        .groupBy(place.alias("_place"))
        .agg(F.sort_array(F.collect_set("_state")).alias("_states"))
    )
    placed = hashed.withColumn("_place", F.when(F.col("key_hash").isNotNull() & F.col("_range").isNotNull(), place))
    joined = join_dimension(placed, stored(states, "key_states"), "_place", salt_by=hashed.columns, large=True)
    past = F.filter("_states", lambda s: s["valid_from"] <= F.col(at))
    matched = joined.withColumn("_then", F.element_at(F.when(F.size(past) > 0, past), -1)).withColumns(
        {c: F.col("_then")[c] for c in ("key_id", "agent_id", "expires_at", "is_active")}
    )
    matched = matched.withColumn("status", access_status(at))
    valid = F.col("status") == "valid"
    return matched.withColumns(
        {"key_id": F.when(valid, F.col("key_id")), "agent_id": F.when(valid, F.col("agent_id"))}
    ).drop("key_hash", "_range", "_place", "_states", "_then", "expires_at", "is_active")


def last_used_as_of(keys: DataFrame, access: DataFrame, changes: DataFrame, at: str = "ts") -> DataFrame:
    """Keys with last_used_at moved to their latest use that was valid when it happened, whatever happened to them since."""
    return (
        keys.join(latest_use(access_as_of(access, changes, at), at), "key_id", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "last_use"))
        .drop("last_use")
    )
