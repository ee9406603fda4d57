"""The corpus pipeline: documents through the operators of govlens.llm, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlens.llm import decontaminate, jaccard, mixing, substrings, toxicity
from govlens.llm.ranks import named
from govlens.operators.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model learns from all labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, carry=docs.columns, least=0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8, the one with the smallest doc_id.

    Rows that repeat a doc_id, or have none, are judged by their own texts: of a group one row stays, one with an id before
    one without. Of rows without words one stays for each doc_id and text.
    """
    marked = docs.withColumns({"_text_hash": F.xxhash64("text"), "_row": F.xxhash64(*docs.columns)})
    key = F.concat_ws(":", named(F.col("doc_id")), F.col("_text_hash").cast("string"))
    found = jaccard.jaccard_components(marked, size=5, percent=80, carry=("_text_hash",)).withColumn("_key", key)
    alone = F.when(F.col("component_key").isNull(), F.col("_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_hash", "_key"))
    kept = found.groupBy("component_key", alone.alias("alone")).agg(first.alias("first")).select("first._key")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_row"))
    chosen = marked.withColumn("_key", key).join(kept, "_key", "left_semi").withColumn("_rank", rank)
    return chosen.filter("_rank = 1").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words and more that occur at several places; the rest of a text stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substrings.repeated_passages(docs, carry=others)
    cut = found.withColumn("text", F.expr("CASE WHEN n_removed = 0 THEN text ELSE kept_text END"))
    if "n_chars" in others:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(size))
    return cut.select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold most of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    return mixing.mixed(docs)


# Columns that stages read; all others travel under names of their own, so that none meets one that an operator makes.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(stage: Stage) -> Stage:
    """The stage with every other column of its documents renamed for the way through it.

    A column that the stage adds keeps its name, with ``_`` behind it as often as it takes to differ from the others.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in READ]
        away = {c: f"_extra_{i}" for i, c in enumerate(rest)}
        out = stage(spark, docs.toDF(*[away.get(c, c) for c in docs.columns]), sf_dir)
        back = {short: c for c, short in away.items()}
        names = [back.get(c, c) for c in out.columns[: len(docs.columns)]]
        for added in out.columns[len(docs.columns) :]:
            while added in names:
                added += "_"
            names.append(added)
        return out.toDF(*names)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", sheltered(without_toxic)),
    ("jaccard_join", sheltered(one_of_each_group)),
    ("substring_dedup", sheltered(without_repeats)),
    ("decontamination", sheltered(without_test_items)),
    ("source_mixing", sheltered(mixed_sources)),
]

# Trained models, components of similar texts and tilings have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
