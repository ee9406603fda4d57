"""Mixing sources to target weights: repetition rates per source, and the copies of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.operators.common import stored

# Weights given to the sources in turn, in the order of their names.
WEIGHTS = (1, 2, 3)
# No document is taken more often.
MOST_COPIES = 3
# Ranges that a ranking of the sources is cut into.
RANGES = 32

# A word is a longest run of other characters than these (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words, without building a list of them: words become one letter each, spaces go."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")), F.lit(0)).cast("long")


def drawn(*columns: str, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the values and the seed alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add the sum of each column over all rows before a row, in a total order.

    Rows are sorted in ranges; what lies before a range comes from the sums of the ranges, so no task holds all rows.
    """
    cut = stored(df.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(offsets, "_range")
    added = {
        out: F.col(f"_o_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("decimal(38,0)")
        for out, c in sums.items()
    }
    return joined.withColumns(added).drop("_range", *[f"_o_{out}" for out in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their code points, null last, weigh 1, 2, 3 in turn and share the sum of all sizes. Where a
    share is above three times a source's size, the target stops there and the rest is shared again. That ends where
    sources in the order of size per weight are full up to one of them, and all from there on get an equal part per
    weight; two running sums find that place.
    """
    exact = F.col("source_size").cast("decimal(38,0)")
    named = sizes.select("source", "source_size", exact.alias("_size"), F.lit(1).cast("decimal(38,0)").alias("_one"))
    ranked = _running(named, [F.col("source").asc_nulls_last()], {"_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS)).cast("int") + 1)
    weighed = ranked.withColumn("_weight", weight.cast("decimal(38,0)"))
    ratio = F.col("_size").cast("double") / F.col("_weight").cast("double")
    order = [ratio.asc(), F.col("source").asc_nulls_last()]
    running = _running(weighed, order, {"_size_before": "_size", "_weight_before": "_weight", "_place": "_one"})
    sums = weighed.agg(F.sum("_size").alias("size"), F.sum("_weight").alias("weight")).first()  # two numbers
    total, weights = (F.lit(str(x or 0)).cast("decimal(38,0)") for x in sums)
    rest = (total - MOST_COPIES * F.col("_size_before")).cast("double")
    open_weight = (weights - F.col("_weight_before")).cast("double")
    is_full = MOST_COPIES * F.col("_size").cast("double") * open_weight <= F.col("_weight").cast("double") * rest
    judged = stored(running.withColumns({"_rest": rest, "_open": open_weight, "_full": is_full}), "sources")
    first = judged.filter(~F.col("_full")).agg(F.min_by(F.struct("_place", "_rest", "_open"), "_place")).first()[0]
    target = (MOST_COPIES * F.col("source_size")).cast("double")
    if first is not None:
        share = F.col("_weight").cast("double") * F.lit(first["_rest"]) / F.lit(first["_open"])
        target = F.when(F.col("_place") < F.lit(first["_place"]), target).otherwise(share)
    return judged.select("source", "source_size", target.alias("target"))


def rates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) per row.

    ``size`` counts words (runs of characters other than space and \\x09-\\x0D; null text: 0). ``rate`` is the source's
    target divided by its size, 0 for a source without words. ``copies`` is floor(rate), and one more with the
    probability of the remaining fraction, drawn from a hash of id, text and seed: reruns agree. Rows with equal id and
    text are drawn alike. Null sources form one source, the last. An empty table gives an empty result. Only the named
    columns are read, once; sizes and draws are written to the shared folder.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col).cast("string")).alias("size"),
            F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_md5"),
        ).select("id", "source", "size", drawn("id", "text_md5", seed=seed).alias("draw")),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(by_source), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    return (
        sized.join(goals, sized["source"].eqNullSafe(goals["_source"]))
        .withColumn("rate", rate)
        .withColumn("copies", whole + (F.col("draw") < F.col("rate") - whole).cast("long"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """The mix itself: the input's columns and ``copy`` (from 1), a row per copy that ``rates`` gives a document."""
    sized = docs.select(
        F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(by_source), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.select(F.col("source").alias("_source"), rate.alias("_rate"))
    whole = F.floor("_rate")
    text_md5 = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    draw = docs.withColumn("_md5", text_md5).withColumn("_draw", drawn(id_col, "_md5", seed=seed)).drop("_md5")
    copies = whole + (F.col("_draw") < F.col("_rate") - whole).cast("long")
    return (
        draw.join(goals, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .drop("_source", "_rate", "_draw", "_copies")
    )
