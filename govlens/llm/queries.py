"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm import (
    decontaminate,
    html_text,
    jaccard,
    language,
    line_rules,
    merkle,
    mixing,
    neighbours,
    ppm,
    repair,
    substrings,
    toxicity,
    urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``: decides what is held out of training. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


@query
def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return ppm.language_scores(docs, ~F.col("held_out"), carry=("held_out",))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fit(pages))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", "item_words", "covered_words", F.size("tiles").alias("n_tiles"), "coverage"
    )


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rates(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rated.select("doc_id", "size", "source_size", "target", taken)


ORACLES["op5_source_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13)
      AS BIGINT) / 4503599627370496.0 AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
running AS (
  SELECT *,
    CAST((SELECT sum(source_size) FROM sources) - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE) AS rest,
    CAST((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS open,
    row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS place
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT place AS first_place, rest AS first_rest, open AS first_open FROM running
  WHERE NOT CAST(3 * source_size AS DOUBLE) * open <= weight * rest ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN first_place IS NULL OR place < first_place THEN CAST(3 * source_size AS DOUBLE)
         ELSE weight * first_rest / first_open END AS target
  FROM running LEFT JOIN stop ON TRUE)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (
  SELECT doc_id, size, source_size, target, draw,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
"""


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), training=~held_out)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(4) == 2
    network = language.fit(docs, training=~held_out)
    return language.identified(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


URL_RULES = (
    urls.Rule(urls.ALLOW, "com", "/"),
    urls.Rule(urls.BLOCK, "example.com", "/en/"),
    urls.Rule(urls.ALLOW, "www.example.com", "/en/"),
    urls.Rule(urls.BLOCK, "net", "/es/"),
    urls.Rule(urls.BLOCK, "net", "/fr/"),
)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no host column; their source stands for it."""
    return line_rules.judged(table(spark, sf_dir, "documents")).drop("removed")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the table, and a copy held against it in which some texts are in lower case (A-Z)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # An id that is null has no decimal text: its row is never changed.
    harmed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(harmed, F.translate("text", letters, letters.lower()))
    found = merkle.manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=changed
    )
    again = merkle.folded(F.coalesce("now_leaf", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repaired(rows, present=present)


ORACLES["op11_line_rules"] = """
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_no, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM texts),
windows AS (
  SELECT row_no, i, [words[i], words[i + 1], words[i + 2]] AS span
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM words WHERE len(words) >= 3)),
twice AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, span) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_no, count(DISTINCT i + k) AS n_repeat_words
  FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_no),
lines AS (
  SELECT row_no, line, trim(regexp_replace(regexp_replace(
      translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'),
      '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS normal
  FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM texts)),
full_lines AS (
  SELECT l.row_no, source, text, line, normal, len(string_split(normal, ' ')) AS n
  FROM lines l JOIN texts t ON l.row_no = t.row_no WHERE normal <> ''),
repeated AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY row_no),
hosts AS (SELECT source, count(DISTINCT text) AS host_documents FROM texts GROUP BY source),
often AS (
  SELECT source, normal, count(DISTINCT text) AS documents FROM full_lines GROUP BY source, normal
  HAVING count(DISTINCT text) > 10),
frequent AS (
  SELECT o.source, normal FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source
  WHERE documents > CAST(0.02 AS DOUBLE) * host_documents),
gone AS (
  SELECT row_no, CAST(sum(n) AS BIGINT) AS n_removed_words FROM full_lines f
  JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.normal = q.normal GROUP BY row_no),
found AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_removed_words, 0) AS n_removed_words
  FROM texts JOIN words USING (row_no) LEFT JOIN repeated USING (row_no) LEFT JOIN covered USING (row_no)
  LEFT JOIN gone USING (row_no)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND n_removed_words <= 0.5 * n_words AS kept FROM judged
"""
