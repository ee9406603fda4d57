"""Greedy string tiling against a plain search for the longest match."""

from __future__ import annotations

import random

import numpy as np
import pytest

from govlens.llm import decontaminate as D


def plain_tiles(doc, item, least):
    """The textbook loop: the longest common run of free words, until none has ``least`` words."""
    taken_doc, taken_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while (
                    i + n < len(doc)
                    and j + n < len(item)
                    and doc[i + n] == item[j + n]
                    and not taken_doc[i + n]
                    and not taken_item[j + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        taken_doc[i : i + n] = [True] * n
        taken_item[j : j + n] = [True] * n
        out.append(best)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_the_plain_loop(seed):
    rng = random.Random(seed)
    doc = [rng.randrange(4) - (rng.random() < 0.1) * 9 for _ in range(rng.randint(0, 40))]
    doc = [x if x >= 0 else -1 for x in doc]
    item = [rng.randrange(4) for _ in range(rng.randint(0, 15))]
    got = D.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in plain_tiles(doc, item, 3))
    for i, j, n in got:
        assert doc[i : i + n] == item[j : j + n]
    assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for _, _, n in got)
    assert len({x for _, j, n in got for x in range(j, j + n)}) == sum(n for _, _, n in got)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture
def benchmark(spark):
    rows = [(7, ITEM, 1), (8, None, 1), (9, "", 1), (10, "one two", 1), (None, "p q r s t u v w", 1)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def texts():
    w = ITEM.split()
    return [
        (1, f"before {ITEM} after"),
        (2, " x ".join([" ".join(w[10:]), " ".join(w[:10])])),  # reordered
        (3, " ".join(w[:9])),  # less than half
        (4, ITEM.upper().replace(" ", ", ")),
        (5, "one two"),
        (6, None),
        (7, ""),
        (8, " ".join(w[:7] + ["other"] + w[8:])),  # one word changed
        (9, "y " * 50_000 + ITEM),
        (None, ITEM),
        (1, f"before {ITEM} after"),
        (11, "p q r s t u v w"),
    ]


@pytest.mark.parametrize("block", [32 << 20, 100])
def test_found_items(spark, benchmark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(*r, "c") for r in texts()], "doc_id long, text string, coverage string")
    out = D.contaminated(docs, benchmark).collect()
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in out)
    assert got == [(0, 7), (1, 7), (1, 7), (2, 7), (4, 7), (8, 7), (9, 7), (11, 0)]
    by_id = {r.doc_id: r for r in out}
    assert by_id[2].covered_words == 20 and len(by_id[2].tiles) == 2
    assert by_id[8].covered_words == 19 and by_id[8].coverage == 0.95
    kept = D.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "one two three"), (2, "four five six seven"), (3, "今天天气很好"), (4, "東京都"), (5, "สวัสดีครับ")]
    rows = [(1, "a One, two three."), (2, "four five six"), (3, "x four five six seven"), (4, "他说今天天气很好。我们走吧"), (5, "在東京都里 one two"), (6, "天天很好"), (7, "กสวัสดีครับก")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 4), (7, 5)}
    assert {r.doc_id for r in D.decontaminated(docs, benchmark).collect()} == {2, 6}


def test_documents_hold_the_planted_items(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    plain = {
        (d.doc_id, i.item_id)
        for d in docs.collect()
        for i in items.collect()
        if b" ".join(D.words_of(i.text)) in b" ".join(D.words_of(d.text)) and len(D.words_of(i.text)) >= 5
    }
    assert plain and plain <= got


def test_empty_tables(spark, benchmark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    assert D.contaminated(docs.limit(0), benchmark).collect() == []
    assert D.contaminated(docs, benchmark.limit(0)).collect() == []
    assert D.decontaminated(docs, benchmark.limit(0)).count() == len(texts())


@pytest.mark.parametrize("n", [1_000, 250_000])
def test_one_word_repeated_on_both_sides(n):
    """Some megabytes of one word: one tile, in memory that follows the words."""
    assert D.tiles(np.zeros(n, np.int64), np.zeros(n // 5, np.int64), 3) == [(0, 0, n // 5)]
    two = np.tile(np.array([0, 1], np.int64), n // 2)
    assert sum(w for _, _, w in D.tiles(two, np.concatenate([two[: n // 10], [7], two[: n // 20]]), 3)) >= n // 10


def test_pieces_of_three_words(spark):
    """Reordered pieces of three words are tiles, once a longer piece is a seed."""
    words = [f"w{i}" for i in range(26)]
    pieces = [words[:5], *[words[a : a + 3] for a in range(5, 26, 3)]]
    text = " x ".join(" ".join(p) for p in reversed(pieces))
    found = D.contaminated(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"),
    ).collect()
    assert [(r.item_id, r.covered_words) for r in found] == [(7, 26)]
