"""Substring dedup against all windows, one by one."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from govlens.llm import substrings


def expected(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        spans, start = [], None
        for i, g in enumerate([*gone, False]):
            if g and start is None:
                start = i
            if not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((len(w), sum(gone), kept, spans))
    return out


def found(df):
    rows = df.select("doc_id", "text", "n_words", "n_removed", "kept_text", "spans").collect()
    return {(r[0], r[1]): (r[2], r[3], r[4], [tuple(s) for s in r[5]]) for r in rows}


@pytest.mark.parametrize("window, anchor", [(8, 3), (5, 5), (6, 1)])
def test_equals_all_windows(spark, window, anchor, monkeypatch):
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_CHUNK", 700)
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_SHARD", 1500)
    rng = random.Random(window)
    words = ["a", "b", "c", "dd", "e."]
    passages = [[rng.choice(words) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.random()}" for _ in range(9)] for _ in range(4)]
        texts.append(rng.choice((" ", "\n", " \t")).join(w for p in parts for w in p))
    texts += [None, "", "  ", "a a a a a a a a a a a a a a a a a a a a"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(substrings.repeated_passages(df, window=window, anchor=anchor))
    for row, exp in zip(rows, expected(texts, window), strict=True):
        assert got[row] == exp


def test_on_documents(docs):
    got = found(substrings.repeated_passages(docs))
    rows = docs.select("doc_id", "text").collect()
    for row, exp in zip(rows, expected([r.text for r in rows], 35), strict=True):
        assert got[tuple(row)] == exp


def test_odd_rows(odd):
    out = substrings.repeated_passages(odd, carry=["source", "_chunk"], window=4, anchor=2).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out if r.doc_id}
    assert (by_id[1].text, by_id[1].kept_text, by_id[1].n_words) == (None, "", 0)
    assert by_id[3].text == " \t\n " and by_id[3].n_words == 0
    assert by_id[4].n_removed == 6 and by_id[4].kept_text == ""
    assert by_id[5].n_removed == 0  # words are compared as they are
    assert by_id[6].n_removed == 30_000
    assert {r.source for r in out} == {"a", "b", "c", None}


def test_empty_table(odd):
    assert substrings.repeated_passages(odd.limit(0)).collect() == []
