"""Shared steps: time ranges, top-k, first row per key, dimension joins and ranks that survive hot keys."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.session import scratch_dir

# Pieces a hot key is spread over when a dimension is too large to broadcast.
SALTS = 32
# Ranges of hashes that the facts of a join are counted by, and the share of the facts from which one holds a hot key.
HASHES = 1 << 16
HOT = 1 / 1000
# Days that the search for the latest rows goes back before it reads everything.
LONGEST = 1 << 14


def moment(as_of: datetime | str | None) -> Column:
    """The time a report is made for: a literal, or the current time when None."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def days_before(as_of: datetime | str | None, days: int) -> Column:
    return moment(as_of) - F.make_dt_interval(days=F.lit(days))


def last_days(df: DataFrame, as_of: datetime | str | None, days: int, on: str = "timestamp") -> DataFrame:
    """Rows from ``days`` days before ``as_of`` on; prunes day partitions when the table has them."""
    start = days_before(as_of, days)
    out = df.filter(F.col(on) >= start)
    return out.filter(F.col("event_date") >= F.to_date(start)) if "event_date" in df.columns else out


def period(df: DataFrame, as_of: datetime | str | None, days: int, on: str = "timestamp") -> DataFrame:
    """Rows in the closed range of the last ``days`` days up to ``as_of``."""
    end = moment(as_of)
    out = last_days(df, as_of, days, on).filter(F.col(on) <= end)
    return out.filter(F.col("event_date") <= F.to_date(end)) if "event_date" in df.columns else out


def only(df: DataFrame, **equal: str | None) -> DataFrame:
    """Keep rows whose columns equal the given values; None and the empty text mean no condition."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Spread scanned rows over all cores by a hash of ``by`` when the scan has fewer partitions than there are cores.

    Meant for few unsplittable files before work that is heavy per row, such as text scanning. Large inputs have more
    partitions than cores and pass unchanged, and so does a plan that shuffles already: counting its partitions would
    run it.
    """
    if hasattr(df, "_jdf") and df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def first_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order.

    Spark keeps only each task's candidates per key before the shuffle (window group limit), so a key with very many
    rows does not travel whole.
    """
    keys = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def identified(df: DataFrame, name: str, batch_id: str, *content: str | Column) -> DataFrame:
    """Add an id: a hash of the batch, the content and a number among rows of equal content.

    Equal rows are alike in everything that counts here, so it does not matter which of them gets which number, and a
    recomputed task gives the same set of ids.
    """
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in content]
    equal = df.withColumn("_same", F.sha2(F.concat_ws(":", F.lit(batch_id), *texts), 256))
    number = F.row_number().over(Window.partitionBy("_same").orderBy("_same"))
    return equal.withColumn("_n", number).withColumn(name, F.sha2(F.concat_ws(":", "_same", "_n"), 256)).drop("_same", "_n")


def newest_days(found: DataFrame, wanted: int, as_of: datetime | str | None = None) -> DataFrame:
    """Rows of the newest days that hold ``wanted`` rows, from a table with day partitions; all rows if there are fewer.

    Goes back from ``as_of`` by 1, 2, 4, ... days until enough rows are found. Each step takes at most the rows that are
    still missing, from the days it adds, and reads no other partition. What lies after ``as_of`` counts as new. Rows
    without a day come last, and only where all days together have too few rows.
    """
    day = found.sparkSession.range(1).select(F.to_date(moment(as_of))).first()[0]
    end, step = None, 1
    while step <= LONGEST:
        start = day - timedelta(days=step)
        band = found.filter(F.col("event_date") > F.lit(start))
        if end is not None:
            band = band.filter(F.col("event_date") <= F.lit(end))
        wanted -= len(band.select(F.lit(1)).take(wanted))
        if wanted <= 0:
            return found.filter(F.col("event_date") > F.lit(start))
        end, step = start, 2 * step
    return found


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the size estimate is within the session's broadcast threshold.

    False where the estimate cannot be read, and where rows are generated: the optimizer does not count those.
    """
    if not hasattr(df, "_jdf") or "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        return False
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= limit


def _hash_range(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HASHES)).cast("int")


def hot_ranges(facts: DataFrame, key: str) -> list[int]:
    """The ranges of the key's hashes with more than ``HOT`` of the facts: 1 / ``HOT`` at most.

    A scan that counts; a task sends ``HASHES`` numbers at most.
    """
    counts = {r["_range"]: r["count"] for r in facts.groupBy(_hash_range(key).alias("_range")).count().collect()}
    least = HOT * sum(counts.values())
    return sorted(at for at, n in counts.items() if n > least)


def _salted(
    rows: DataFrame, small: DataFrame, key: str, salt_by: list[str], hot: list[int] | None
) -> tuple[DataFrame, DataFrame]:
    """Spread rows over salts by a hash of ``salt_by``, and copy the small side once per salt.

    With ``hot``, this is done for keys in these ranges of hashes only; the others have one salt. The salt depends on the
    row alone, so a recomputed task gives the same rows.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if hot is not None:
        is_hot = _hash_range(key).isin(hot)
        salt, salts = F.when(is_hot, salt).otherwise(0), F.when(is_hot, salts).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_salt", salt), small.withColumn("_salt", F.explode(salts))


def join_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, salt_by: list[str], how: str = "left", large: bool = False
) -> DataFrame:
    """Join facts with a dimension, for keys that may hold a large share of the facts.

    ``how`` is left, inner, left_semi or left_anti. The dimension is broadcast when its estimate fits the session's
    threshold. Beyond that the join runs on (key, salt): a key with a third of all facts meets its dimension row in
    ``SALTS`` tasks instead of one. That copies the dimension ``SALTS`` times. For one that may be ``large``, about as
    large as the facts, the facts are counted by their key first, and only the rows of hot keys are copied; not on
    streams, which can't be counted.
    """
    if fits_broadcast(dimension):
        return facts.join(F.broadcast(dimension), key, how)
    hot = hot_ranges(facts, key) if large and not facts.isStreaming else None
    salted, copies = _salted(facts, dimension, key, salt_by, hot)
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate result to the shared scratch folder and read it back.

    Its size is then known from its files, so Spark decides on a broadcast by the real size, and an executor that is
    lost later does not bring the work back.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(
    df: DataFrame, key: list[str], buckets: dict[str, Column], order: list[str], amount: Column, out: str
) -> DataFrame:
    """Add the running sum of ``amount`` within ``key`` in the order of ``order``, for keys of any size.

    ``buckets`` cut each key's rows into ranges that follow ``order`` (bucket columns compare like the order columns
    do). Rows are ranked inside their bucket only; what lies before a bucket comes from per-bucket sums, which are
    narrow. No task ever holds or scans the rows of a whole hot key. Rows without a key or an order are kept; their
    sum starts anew.
    """
    names = list(buckets)
    cut = df.withColumns(buckets).withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0)))
    sums = cut.groupBy(*key, *names).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, *names, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy(*key, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.join(offsets, [*key, *names], "left")
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.sum("_amount").over(inside))
        .drop("_amount", "_before", *names)
    )
