"""Prediction by partial matching against a plain trie of contexts, and the unigram model against counts."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govlens.llm import ppm


def normal(text):
    return b" ".join((text or "").encode().lower().split())


class Trie:
    """Method D with exclusion, one symbol after the other."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.symbols(text):
                for k in range(order + 1):
                    self.counts[context[order - k :]][symbol] += 1

    def symbols(self, text):
        data = bytes([ppm.START]) * self.order + normal(text) + bytes([ppm.END])
        for i in range(self.order, len(data)):
            yield data[i - self.order : i], data[i]

    def log10(self, text):
        out = 0.0
        for context, symbol in self.symbols(text):
            excluded = set()
            for k in range(self.order, -1, -1):
                seen = self.counts.get(context[self.order - k :], {})
                free = {s: c for s, c in seen.items() if s not in excluded}
                n = sum(free.values())
                if n and symbol in free:
                    out += math.log10((free[symbol] - 0.5) / n)
                    break
                if n:
                    out += math.log10(len(free) / (2 * n))
                excluded |= set(seen)
            else:
                out -= math.log10(ppm.SYMBOLS - len(excluded))
        return out


def expected(rows, order):
    learned = [t for _, t, train in rows if train]
    trie = Trie(learned, order)
    counts = Counter(w for t in learned for w in normal(t).split())
    total, kinds = sum(counts.values()) + len(learned), len(counts) + bool(learned)
    out = []
    for doc_id, text, _ in rows:
        c = [counts[w] for w in normal(text).split()] + [len(learned)]
        base = sum(math.log10((x + 1) / (total + kinds + 1)) for x in c)
        out.append((doc_id, len(c), sum(x > 0 for x in c), total, base, trie.log10(text)))
    return out


def check(df, rows, order):
    out = ppm.language_scores(df, F.col("train"), carry=("train",), order=order).collect()
    key = lambda r: (r[0] or 0, r[1], r[5])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
    for a, b in zip(got, sorted(expected(rows, order), key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-5)


@pytest.mark.parametrize("order", [2, 5])
def test_equals_the_plain_trie(spark, docs, order, monkeypatch):
    monkeypatch.setattr(ppm, "TEXT_PER_CHUNK", 20_000)
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_SHARD", 30_000)
    monkeypatch.setattr(ppm, "SLICE", 3_000)
    flagged = docs.withColumn("train", F.col("doc_id") % 3 != 0).select("doc_id", "text", "train").limit(60)
    rows = [tuple(r) for r in flagged.collect()]
    check(spark.createDataFrame(rows, flagged.schema), rows, order)


def test_shards_do_not_cut_contexts(spark, docs, monkeypatch):
    """Far more shards than contexts of two bytes: even cuts of the key range lie inside the ranges of used pairs."""
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_SHARD", 7)
    few = docs.filter("length(text) BETWEEN 500 AND 3000").orderBy("doc_id").limit(12)
    rows = [(r.doc_id, r.text, i % 3 != 0) for i, r in enumerate(few.collect())]
    used = {int(ppm.SPREAD[a << 8 | b]) for _, t, _ in rows for a, b in zip(normal(t), normal(t)[1:], strict=False)}
    shards = sum(len(t.encode()) + 64 for _, t, _ in rows) // 7 + 1
    assert len(used & {(i << 16) // shards for i in range(1, shards)}) > 10
    check(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), rows, 5)


def test_odd_rows(odd):
    flagged = odd.withColumn("train", F.coalesce(F.col("doc_id") != 4, F.lit(True)))
    check(flagged, [tuple(r) for r in flagged.select("doc_id", "text", "train").collect()], 3)


def test_without_training(odd):
    flagged = odd.withColumn("train", F.lit(False))
    check(flagged, [tuple(r) for r in flagged.select("doc_id", "text", "train").collect()], 3)


def test_empty_table(odd):
    assert ppm.language_scores(odd.limit(0), F.lit(True)).collect() == []


def test_copies_of_training_texts_are_cheap(spark, docs):
    text = docs.filter("length(text) BETWEEN 500 AND 900").orderBy("doc_id").first().text
    rows = [(1, text, True), (2, text, False), (3, text[::-1], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    score = {r.doc_id: r.score for r in ppm.language_scores(df, F.col("train")).collect()}
    assert score[1] == score[2] > score[3] / 3


def test_pieces_of_a_shard_equal_the_whole():
    """Pieces end between byte pairs; a pair with more keys than a piece stays whole."""
    draw = np.random.default_rng(5)
    text = bytes(draw.choice(list(b"aaab "), 4_000).tolist()) + bytes(draw.integers(97, 123, 4_000).tolist())
    keys, counts = ppm.gathered(pa.chunked_array([[text.decode()]]), np.array([True]), 4)
    pairs = draw.integers(0, 9, (256, 256))
    whole = ppm.log_probabilities(keys, counts, pairs, 4).astype(np.float32)
    for at_once in (1, 7, 300, len(keys), len(keys) + 1):
        assert np.array_equal(ppm.by_pairs(keys, counts, pairs, 4, at_once), whole)
