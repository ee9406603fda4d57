"""Nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from govlens.llm import neighbours, queries

KIND = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    """(query, id) -> distance of the k nearest, ties to the smaller id; and the k-th distance of each query."""
    ok = [
        (i, np.array(v, np.float64))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q in queries:
        best = {}
        for vector in (v for i, v in ok if i == q):
            for i, v in ok:
                if i != q and len(v) == len(vector):
                    d = float(np.sqrt(((v - vector) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
        if any(i == q for i, _ in ok):
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = queries.QUERIES["op8_nearest_neighbours"](spark, sf_dir).collect()
    right = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(right)
    vector = {i: np.array(v, np.float64) for i, v in rows}
    found = 0
    for q, near in got.items():
        assert near == sorted(near) and len(near) == len(right[q])
        for d, i in near:
            assert d == pytest.approx(float(np.sqrt(((vector[i] - vector[q]) ** 2).sum())), rel=1e-12)
        found += len({i for _, i in near} & {i for _, i in right[q]})
    assert found >= 0.95 * sum(map(len, right.values()))
    assert {r["rank"] for r in out} == set(range(1, 11))


def test_odd_rows(spark, monkeypatch):
    """Few rows: everything that can be a neighbour is found."""
    monkeypatch.setattr(neighbours, "QUERIES_TOGETHER", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 40)]
    same = [0.5, 0.5, 0.5, 0.5]
    rows += [(i, same) for i in range(200, 230)]  # ties
    rows += [(0, same), (0, same), (0, [9.0, 9.0, 9.0, 9.0]), (3, rows[2][1])]  # repeated rows and ids
    rows += [(50, None), (51, []), (52, [0.0] * 4), (53, [1.0, None, 1.0, 1.0]), (54, [math.nan] * 4), (100, [math.inf] * 4)]
    rows += [(None, same), (60, [1.0, 2.0]), (61, [1.0, 2.5]), (300, [0.0, 0.0, 0.0, 1e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3)
    asked = [0, 5, 60, 200, 300, 52, 100]
    out = neighbours.nearest(df, df.filter(df.vec_id.isin(asked))).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, near in brute(rows, asked, 10).items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in near])
    assert set(got) == {0, 5, 60, 200, 300} and got[60] == [(0.5, 61)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], "x")], KIND)
    assert neighbours.nearest(df.limit(0), df).collect() == []
    assert neighbours.nearest(df, df.limit(0)).collect() == []
    assert neighbours.nearest(df, df).collect() == []


def test_many_blocks(spark, monkeypatch):
    """Blocks, pages and slices of small size; a third of the rows are copies of one vector, and one id repeats."""
    for name, size in (("INDEXED_TOGETHER", 64), ("QUERIES_TOGETHER", 5), ("BLOCKS_TOGETHER", 8), ("PIVOTS", 16)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    near = centres[rng.integers(0, 12, 1_200)] + rng.normal(size=(1_200, 16)) * 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(near.astype(np.float32))]
    rows += [(2_000 + i, rows[7][1]) for i in range(600)]
    rows += [(7, rows[8][1])] * 30
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(5)
    asked = [*range(0, 1_200, 40), 7, 2_000, 2_013, 2_599]
    got = {}
    for r in neighbours.nearest(df, df.filter(df.vec_id.isin(asked))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    right = brute(rows, asked, 10)
    assert set(got) == set(right)
    found = sum(len({i for _, i in got[q]} & {i for _, i in right[q]}) for q in right)
    assert found >= 0.95 * sum(map(len, right.values()))
    for q in (2_000, 2_013, 2_599):  # copies: the smallest ids, but the own
        assert got[q] == [(0.0, i) for i in [7, *range(2_000, 2_012)] if i != q][:10]


def test_blocks_that_cannot_collide_stay_closed(spark):
    """A far block is not opened; one within the windows is, and a query without a home opens all of its length."""
    here, there = np.full(4, 1.0), np.full(4, 50.0)
    directions = neighbours._directions(4)
    ranges = [(f"4:{i}:0", *[(x @ directions + d).tolist() for d in (-1.0, 1.0)]) for i, x in enumerate((here, there))]
    ranges.append(("2:0:0", [0.0] * neighbours.PROJECTIONS, [1.0] * neighbours.PROJECTIONS))
    ranges = spark.createDataFrame(ranges, "block string, low array<double>, high array<double>")
    inf = float("inf")
    asked = [(1, here.tolist(), "4:0:0", 0.5), (2, here.tolist(), "4:1:0", 0.5), (3, here.tolist(), None, inf)]
    asked = spark.createDataFrame(asked, "id long, vector array<double>, home string, bound double")
    opened = sorted((r.id, r.block) for r in neighbours._opened(asked, ranges).collect())
    assert opened == [(2, "4:0:0"), (3, "4:0:0"), (3, "4:1:0")]
