"""Mixing: targets against the rule applied step by step, and the copies that are emitted."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest

from govlens.llm import mixing


def shared_out(sizes):
    """Share by weight, stop at three times the size, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        left = [s for s in names if s not in target]
        rest = total - sum(target.values())
        each = {s: Fraction(rest * weight[s], sum(weight[x] for x in left)) for s in left}
        above = [s for s in left if each[s] > 3 * sizes[s]]
        if not above:
            return {**target, **each}
        target |= {s: Fraction(3 * sizes[s]) for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((0, 1, 3, 10, 50, 400)) + rng.randrange(3) for i in range(rng.choice((1, 4, 40)))}
    sizes |= {None: 7, "É": 4, "\U0001f600": 2, "\uffff": 3, "": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in shared_out(sizes).items()})
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_rates_and_copies(spark, docs):
    rated = mixing.rates(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.rates(docs.repartition(5)).collect()}
    assert {r.doc_id: r.copies for r in rated} == again
    taken, target = Counter(), {}
    for r in rated:
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.15)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in rated if r.copies})


def test_seeds_differ(docs):
    one, two = ({r.doc_id: r.copies for r in mixing.rates(docs, seed=s).collect()} for s in (0, 1))
    assert one != two


def test_odd_rows(odd):
    rated = mixing.rates(odd).collect()
    assert len(rated) == odd.count()
    by_id = {r.doc_id: r for r in rated if r.doc_id}
    assert by_id[1].size == 0 and by_id[2].size == 0 and by_id[3].size == 0
    assert by_id[4].size == 6 and by_id[6].size == 30_000 and by_id[2].source is None
    assert by_id[2].source_size == 0 and by_id[2].copies == 0
    mixed = mixing.mixed(odd)
    assert mixed.columns == [*odd.columns, "copy"]
    assert sum(r.copies for r in rated) == mixed.count()


def test_empty_table(odd):
    assert mixing.rates(odd.limit(0)).collect() == []
    assert mixing.mixed(odd.limit(0)).collect() == []


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.rates(df).collect()] == [(0, 0.0, 0)] * 2
