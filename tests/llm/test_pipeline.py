"""The pipeline: what each stage removes and keeps, and that copies, leaks, repeats and toxic texts go."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from govlens.llm import decontaminate, jaccard, mixing, substrings, toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, and one of each kind that a stage must catch, with the tables they need."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(1)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sa", "pel", "vo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = {}, []
    for i in range(400):
        rows[i] = text(rng.randint(40, 120))
    for i in range(60):
        words = rows[i].split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(("scoundrel", "villain", "scoundrels")))
        rows[i] = " ".join(words)
    labels = [(i, 1, int(i < 60)) for i in range(300)]
    item = text(30)
    shared = text(60)
    rows[1000], rows[1001] = rows[390], rows[390] + " " + word()  # an exact and a near copy
    rows[1002] = f"{text(50)} {item} {text(50)}"
    rows[1003], rows[1004] = f"{text(90)} {shared} {text(90)}", f"{text(100)} {shared} {text(80)}"
    rows[1005] = f"{text(300)} you scoundrel {text(300)}"
    table = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = set(range(60, 400))
    assert list(STAGES) == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "source_mixing"]
    one = STAGES["toxicity"](spark, docs, folder)
    assert one.columns == docs.columns
    assert not ids(one) & (set(range(60)) | {1005}) and len(clean - ids(one)) <= 3
    two = STAGES["jaccard_join"](spark, docs, folder)
    assert ids(docs) - ids(two) == {1000, 1001} and two.columns == docs.columns
    three = STAGES["substring_dedup"](spark, two, folder)
    text = {r.doc_id: r for r in three.collect()}
    assert text[1003].text.split() == rows[1003].split()[:90] + rows[1003].split()[150:]
    assert text[1003].n_chars == len(text[1003].text) and text[1004].text != rows[1004]
    assert all(text[i].text == rows[i] for i in clean)
    four = STAGES["decontamination"](spark, docs, folder)
    assert ids(docs) - ids(four) == {1002} and four.columns == docs.columns
    five = STAGES["source_mixing"](spark, docs, folder)
    assert five.columns == [*docs.columns, "copy"] and ids(five) <= ids(docs)


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark, corpus):
    """A near copy of a document and a text of its own under one doc_id: the copy goes, the other stays."""
    folder, rows = corpus
    table = [(1, rows[100]), (2, rows[100] + " x"), (2, rows[101]), (2, rows[101]), (2, None), (3, rows[102]), (3, rows[103])]
    table += [(4, rows[103] + " x"), (5, rows[101] + " y")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    out = STAGES["jaccard_join"](spark, docs, folder)
    kept = [(1, rows[100]), (2, rows[101]), (2, None), (3, rows[102]), (3, rows[103])]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str)


def test_run(spark, corpus):
    folder, _ = corpus
    out = ids(corpus_pipeline.run(spark, folder))
    assert out and not out & {*range(60), 1000, 1001, 1002, 1005}


def test_run_equals_the_operators(spark, sf_dir):
    """Each stage against its operator, on the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = docs.join(toxicity.scored(docs, model).filter("score < 0.5").select("doc_id"), "doc_id", "left_semi")
    kept = jaccard.jaccard_components(left, size=5, percent=80).filter("doc_id = component_id").select("doc_id")
    left = left.join(kept, "doc_id", "left_semi")
    text = {r.doc_id: r for r in substrings.repeated_passages(left).collect()}
    left = STAGES["substring_dedup"](spark, left, sf_dir)
    assert all(r.text == (text[r.doc_id].kept_text if text[r.doc_id].n_removed else text[r.doc_id].text) for r in left.collect())
    left = decontaminate.decontaminated(left, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    copies = {r.doc_id: r.copies for r in mixing.rates(left).collect() if r.copies}
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == copies


def test_odd_and_empty_documents(spark, odd, corpus):
    folder, _ = corpus
    docs = odd.withColumn("n_chars", odd._chunk.cast("long")).drop("_chunk", "score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).collect() == []
        if name == "jaccard_join":
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
        elif name == "toxicity":  # all labels that these rows have are 1, so every text with a word goes
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, None}
        elif name != "source_mixing":
            assert out.count() == docs.count()


INTERNAL = [
    "score", "n_words", "n_removed", "spans", "kept_text", "_rate", "_source", "_rank", "_text_hash", "copy", "id", "key",
    "root", "n_shingles", "component_id", "component_key", "n_links", "carried_0", "_chunk", "_draw", "_md5", "_copies",
    "first", "alone", "coverage", "tiles", "a column. with `marks`", "_row", "_extra_0",
]


def test_columns_named_like_internal_ones_keep_their_values(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id >= 300")
    named = docs.toDF(*docs.columns)
    for i, name in enumerate(INTERNAL):
        named = named.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, named, folder)
        assert out.columns[: len(named.columns)] == named.columns
        plain = {r.doc_id for r in stage(spark, docs, folder).collect()}
        found = out.collect()
        assert {r.doc_id for r in found} == plain and found, name
        for r in found:
            values = dict(zip(out.columns, r, strict=True))
            assert all(values[c] == f"{i}:{r.doc_id}" for i, c in enumerate(INTERNAL))


def test_copies_without_an_id_go(spark, corpus):
    folder, rows = corpus
    table = [(None, rows[100]), (None, rows[100]), (None, rows[100] + " x"), (7, rows[101]), (None, rows[101]), (None, None), (None, rows[102])]
    out = STAGES["jaccard_join"](spark, spark.createDataFrame(table, "doc_id long, text string").repartition(3), folder)
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == 4 and {(7, rows[101]), (None, None), (None, rows[102])} < set(got)
