"""Jaccard join and components against all pairs."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from govlens.llm import components, jaccard


def expected(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j, both in Counter(j for t in s for j in index[t]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
                if s != sets[j]:
                    links[s].add(sets[j])
                    links[sets[j]].add(s)
        for t in s:
            index[t].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):  # a null id is never the least
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter(
        (rows[i][0], len(s), least.get(root(i)) if s else rows[i][0], len(links[s])) for i, s in enumerate(sets)
    )


def found(df, **options):
    out = jaccard.jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id", "n_links")
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("percent", [50, 85])
def test_equals_all_pairs(spark, percent, monkeypatch):
    """Chains and crowds of near copies, with groups and tasks so small that all are cut."""
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_CHUNK", 4000)
    monkeypatch.setattr("govlens.llm.chunks.TEXT_PER_SHARD", 9000)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "QUERY_SHINGLES", 300)
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(8)]
    rows = []
    for _ in range(8):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))] + common
        for _ in range(rng.choice((1, 4, 25))):
            rows.append((len(rows), rng.choice((" ", "\n ")).join(text)))
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, size=3, percent=percent) == expected(rows, 3, percent)


def test_groups_cut_by_sets(spark, monkeypatch):
    """One family of short near copies, in groups of a few sets with a few queries a task: no link is lost."""
    monkeypatch.setattr(jaccard, "GROUP_SETS", 16)
    monkeypatch.setattr(jaccard, "QUERY_SETS", 9)
    rng = random.Random(4)
    common = [f"c{i}" for i in range(24)]
    rows = [(i, " ".join([*common[: rng.randint(20, 24)], f"x{i}"])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, size=3, percent=80) == expected(rows, 3, 80)


def verified(sets, own, percent):
    """Components (as sets of keys) and numbers of links that opening one group gives."""
    table = pa.table(
        {
            "key": [str(i).encode() for i in range(len(sets))],
            "shingles": [x.tobytes() for x in sets],
            "own": own,
            "judged": [True] * len(sets),
        }
    )
    up, links = list(range(len(sets))), [0] * len(sets)
    for a, b, n in jaccard._verified(table, percent):
        if b is None:
            links[int(a)] += n
        else:
            x, y = up[int(a)], up[int(b)]
            up = [y if z == x else z for z in up]
    return len(set(up)), {frozenset(i for i, z in enumerate(up) if z == x) for x in up}, links


@pytest.mark.parametrize("cells", [1, 1 << 19])
def test_a_group_of_near_copies(cells, monkeypatch):
    """Shingles that most members hold, that some hold and that one holds; sets of other groups between the members."""
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rng = np.random.default_rng(3)
    sets = []
    for size in (10, 30):
        family = rng.integers(0, 1 << 63, size)
        for _ in range(150):
            own = rng.integers(0, 1 << 63, int(rng.integers(0, 4)))
            sets.append(np.unique(np.concatenate([rng.permutation(family)[: size - int(rng.integers(0, 4))], own])))
    sets = [sets[i].astype(np.uint64) for i in rng.permutation(len(sets))]
    own = [bool(x) for x in rng.random(len(sets)) < 0.7]
    linked = [[] for _ in sets]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if (own[i] or own[j]) and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                linked[i].append(j)
                linked[j].append(i)
    root = list(range(len(sets)))
    for i, near in enumerate(linked):
        for j in near:
            x, y = root[i], root[j]
            root = [y if z == x else z for z in root]
    components = {frozenset(i for i, z in enumerate(root) if z == x) for x in root}
    assert verified(sets, own, 80) == (len(components), components, [len(x) for x in linked])


def test_a_large_family_takes_seconds():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 18)
    sets = [np.sort(np.append(common, rng.integers(0, 1 << 63, 2))).astype(np.uint64) for _ in range(8_000)]
    start = time.process_time()
    table = pa.table(
        {
            "key": [str(i).encode() for i in range(len(sets))],
            "shingles": [x.tobytes() for x in sets],
            "own": [True] * len(sets),
            "judged": [True] * len(sets),
        }
    )
    found = list(jaccard._verified(table, 80))
    assert time.process_time() - start < 30
    assert sorted(n for _, b, n in found if b is None) == [len(sets) - 1] * len(sets)
    assert sum(b is not None for _, b, _ in found) == len(sets) - 1


def test_on_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, size=4, percent=85) == expected(rows, 4, 85)


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = found(odd, size=5, percent=80)
    assert got == expected(rows, 5, 80)
    # A null id is linked like others and never the smallest; texts without words stay alone.
    assert got[(None, 2, 4, 0)] == 1 and got[(1, 0, 1, 0)] == 1 and got[(None, 0, None, 0)] == 1


def test_empty_table(odd):
    assert jaccard.jaccard_components(odd.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 499), (7, 7), (3, 2), (900, 901), (901, 499)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    roots = dict(found.collect())
    assert {roots[i] for i in range(1, 101)} == {0}
    assert {roots[i] for i in (500, 900, 901)} == {499}
    assert found.count() == 103
