"""Approximate nearest neighbours by collision counting over sorted projections, with query-centred windows.

Vectors lie in blocks around pivots, each with a sorted array of each projection. A query first searches its home block;
the k-th best distance there bounds its windows. It then opens only those blocks in which enough windows of that width
meet the block's range of the projection: elsewhere no vector can reach the collision threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.operators.common import join_dimension, stored

# Projections, and how many of them must see a vector near the query before it is verified.
PROJECTIONS = 32
COLLISIONS = 19
# A window is at first so wide that it holds this part of the vectors; each virtual rehashing widens it by the factor.
FIRST_SHARE = 0.01
WIDEN = 1.25
# Windows are wide enough when the k-th best distance, times this, is within them: see ``Index.nearest``.
REACH = 1.15
# Vectors of one block, queries of one task on a block, blocks that one task holds against its queries, and pivots at most.
INDEXED_TOGETHER = 4_096
QUERIES_TOGETHER = 8_192
BLOCKS_TOGETHER = 4_096
PIVOTS = 1_024
SEED = 13


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components present and finite, not all zero."""
    present = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(present, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _directions(length: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(length, PROJECTIONS))


class Index:
    """Vectors of one length: a sorted array of each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.directions = _directions(vectors.shape[1])
        projected = vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()
        # What rounding may do to a projection.
        self.slack = 1e-9 * float(np.abs(projected).max())

    def nearest(
        self, query_id: int, query: np.ndarray, k: int, bound: float = np.inf
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id; not the query's own id.

        Windows around the query's projections widen step by step. A vector that COLLISIONS windows hold is verified:
        its distance is computed. A vector at distance d lies in one window of half width h with the probability
        P(|N| < h / d). The search ends when h >= REACH * (distance of the k-th best): any vector nearer than that has
        at least the probability P(|N| < REACH) = 0.75 per projection, so 24 collisions on average, two deviations more
        than needed at the very rim. It also ends when the windows hold everything, so that no vector is missed
        for want of width. Where the k-th best distance is at most ``bound``, windows have their last width at once, and
        farther vectors are left out.
        """
        n = len(self.ids)
        at = query @ self.directions
        seen = np.zeros(n, np.int16)
        checked = np.zeros(n, bool)
        checked[self.ids == query_id] = True
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at, strict=True)])
        high = low.copy()
        ids, distances = np.empty(0, np.int64), np.empty(0)
        if bound < np.inf:
            half = REACH * bound + self.slack
        else:
            near = max(1, int(n * FIRST_SHARE / 2))
            spread = [s[min(n - 1, a + near)] - s[max(0, a - near)] for s, a in zip(self.sorted, low, strict=True)]
            half = max(float(np.median(spread)) / 2, self.slack, 1e-300)
        while True:
            new = []
            for j, (s, x) in enumerate(zip(self.sorted, at, strict=True)):
                a, b = np.searchsorted(s, x - half, "left"), np.searchsorted(s, x + half, "right")
                # Rounding may put the first place beside a window of no width.
                a, b = min(a, low[j]), max(b, high[j])
                new += [self.order[j, a : low[j]], self.order[j, high[j] : b]]
                low[j], high[j] = a, b
            seen += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            found = np.flatnonzero((seen >= COLLISIONS) & ~checked)
            if len(found):
                checked[found] = True
                gap = self.vectors[found] - query
                apart = np.sqrt((gap * gap).sum(1))
                ids = np.concatenate([ids, self.ids[found[apart <= bound]]])
                ids, distances = _best(ids, np.concatenate([distances, apart[apart <= bound]]), k)
            if bound < np.inf or len(ids) == k and half >= REACH * distances[-1]:
                return ids, distances
            if (low == 0).all() and (high == n).all():
                return ids, distances
            half *= WIDEN


def _best(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by distance and id, an id once."""
    order = np.lexsort((distances, ids))
    ids, distances = ids[order], distances[order]
    first = C.changes(ids)
    ids, distances = ids[first], distances[first]
    order = np.lexsort((ids, distances))[:k]
    return ids[order], distances[order]


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors, by the length of the vectors."""
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    [(_, found)] = _by_length(vectors.combine_chunks())
    return found


def _pivots(base: DataFrame) -> dict[int, np.ndarray]:
    """Some of the vectors, by length: about one for each block, and PIVOTS at most."""
    wanted = min(PIVOTS, -(-base.count() // INDEXED_TOGETHER))
    sample = base.orderBy(F.xxhash64("id", "vector")).limit(max(1, wanted)).select("vector").toArrow()
    if not sample.num_rows:
        return {}
    return {x.shape[1]: np.unique(x, axis=0) for _, x in _by_length(sample.column("vector").combine_chunks())}


def _in_cells(rows: DataFrame, pivots: C.Shared) -> DataFrame:
    """Rows with ``cell``: the length of the vector and its nearest pivot."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty(batch.num_rows, object)
            for at, vectors in _by_length(batch.column("vector")) if batch.num_rows else ():
                centres = pivots.value.get(vectors.shape[1], np.zeros((1, vectors.shape[1])))
                nearest_one = ((centres * centres).sum(1) - 2 * (vectors @ centres.T)).argmin(1)
                cells[at] = [f"{vectors.shape[1]}:{i}" for i in nearest_one.tolist()]
            columns = [*batch.columns, pa.array(cells, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell"])

    kind = dict(rows.dtypes)["vector"]
    return rows.mapInArrow(placed, f"id long, vector {kind}, cell string")


FOUND = "query_id long, vec_id long, score double, block string, low array<double>, high array<double>"


def _searched(blocks: DataFrame, pairs: DataFrame, k: int, every: bool) -> DataFrame:
    """Search the blocks for the queries put to them, (block, id, vector, bound); ``every``: with all blocks' ranges.

    Many queries of a block are cut by hash over several tasks, each with the block.
    """
    load = F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_TOGETHER)).alias("slices")
    loads = stored(pairs.groupBy("block").agg(load), "loads")
    slices = F.coalesce("slices", F.lit(1))
    held = blocks.join(loads, "block", "left" if every else "inner").withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))
    ).drop("slices")
    cuts = loads.select(F.col("block"), F.col("slices").alias("cuts"))
    put = pairs.join(cuts, "block").withColumn("slice", F.expr("pmod(xxhash64(id, vector), cuts)")).drop("cuts")

    def search(key: tuple, held: pa.Table, put: pa.Table) -> pa.Table:
        index = Index(held.column("id").to_numpy(), _matrix(held.column("vector")))
        rows: list[tuple] = []
        if put.num_rows:
            asked = (put.column("id").to_pylist(), _matrix(put.column("vector")), put.column("bound").to_pylist())
            for query_id, query, bound in zip(*asked, strict=True):
                ids, distances = index.nearest(query_id, query, k, bound)
                for i, d in zip(ids.tolist(), distances.tolist(), strict=True):
                    rows.append((query_id, i, d, None, None, None))
        if every and key[1].as_py() == 0:
            low, high = index.sorted[:, 0] - index.slack, index.sorted[:, -1] + index.slack
            rows.append((None, None, None, key[0].as_py(), low.tolist(), high.tolist()))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        many = pa.list_(pa.float64())
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), many, many]
        names = ["query_id", "vec_id", "score", "block", "low", "high"]
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    sides = [df.groupBy("block", "slice") for df in (held, put)]
    return sides[0].cogroup(sides[1]).applyInArrow(search, FOUND)


def _opened(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(block, id, vector, bound): the blocks, but the query's home, that can hold a vector with enough collisions.

    Queries in slices meet the ranges of blocks in pages, both of bounded size.
    """
    queries, pages = (
        max(1, -(-df.count() // n)) for df, n in ((asked, QUERIES_TOGETHER), (ranges, BLOCKS_TOGETHER))
    )
    put = asked.withColumn("slice", F.expr(f"pmod(xxhash64(id, vector), {queries})")).withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))
    )
    paged = ranges.withColumn("page", F.expr(f"pmod(xxhash64(block), {pages})")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(queries - 1).cast("long")))
    )

    def opens(put: pa.Table, paged: pa.Table) -> pa.Table:
        names = np.array(paged.column("block").to_pylist(), object)
        lengths = np.array([int(x.split(":")[0]) for x in names], np.int64)
        low, high = (
            np.array(paged.column(c).to_pylist(), np.float64).reshape(-1, PROJECTIONS) for c in ("low", "high")
        )
        home = np.array(put.column("home").to_pylist(), object)
        bound = put.column("bound").to_numpy()
        rows, blocks = [], []
        for places, vectors in _by_length(put.column("vector").combine_chunks()) if put.num_rows else ():
            same = np.flatnonzero(lengths == vectors.shape[1])
            for i, at in zip(places.tolist(), vectors @ _directions(vectors.shape[1]), strict=True):
                half = REACH * bound[i]
                met = ((low[same] <= at + half) & (high[same] >= at - half)).sum(1)
                opened = names[same[met >= COLLISIONS]]
                opened = opened[opened != home[i]]
                rows.append(np.full(len(opened), i))
                blocks.append(opened)
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        blocks = np.concatenate(blocks) if blocks else np.empty(0, object)
        out = put.select(["id", "vector", "bound"]).take(pa.array(rows, pa.int64()))
        return out.add_column(0, "block", pa.array(blocks, pa.string()))

    sides = [df.groupBy("page", "slice") for df in (put, paged)]
    kind = dict(asked.dtypes)["vector"]
    return sides[0].cogroup(sides[1]).applyInArrow(opens, f"block string, id long, vector {kind}, bound double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found by Euclidean distance, nearest first.

    Candidates are all rows but those with the query's id; ties go to the smaller id; ``score`` is the distance in double
    precision. Vectors are put into cells around pivots, and cells are cut by hash into blocks of a few thousand. A query
    searches its home block, then the blocks that its windows meet (collision counting, see ``Index``); the best of all
    are merged. Of equal vectors the k + 1 smallest ids are indexed: no other can be among the k nearest.

    Rows without id, and vectors that are null, zero or hold null or non-finite components, take no part, as queries
    neither. Vectors of different lengths are not compared. A repeated id is one candidate, with its nearest vector, and
    one query with the best of its vectors' neighbours. Empty tables give an empty result. Only the named columns are
    read.
    """

    def valid(df: DataFrame) -> DataFrame:
        named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        return named.filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()

    equal = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    base = stored(valid(vectors).withColumn("equal", equal).filter(F.col("equal") <= k + 1).drop("equal"), "vectors")
    pivots = C.Shared(vectors.sparkSession, _pivots(base))
    cells = stored(_in_cells(base, pivots), "cells")
    parts = F.ceil(F.count(F.lit(1)) / F.lit(INDEXED_TOGETHER)).alias("parts")
    parts = stored(cells.groupBy("cell").agg(parts), "cell-parts")
    block = F.concat_ws(":", "cell", F.expr("pmod(xxhash64(id, vector), parts)")).alias("block")
    blocks = join_dimension(cells, parts, "cell", salt_by=["id"], how="inner").select(block, "id", "vector")

    asked = join_dimension(_in_cells(valid(queries), pivots), parts, "cell", salt_by=["id"])
    home = F.when(F.col("parts").isNotNull(), block).alias("home")
    asked = stored(asked.select("id", "vector", home), "queries")
    at_home = asked.filter("home IS NOT NULL").select(
        F.col("home").alias("block"), "id", "vector", F.lit(float("inf")).alias("bound")
    )
    first = stored(_searched(blocks, at_home, k, every=True), "found-at-home")

    near = _ranked(first.filter("query_id IS NOT NULL"), k)
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = join_dimension(asked, stored(bounds, "bounds"), "id", salt_by=["vector"])
    bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    ranges = first.filter("block IS NOT NULL").select("block", "low", "high")
    opened = stored(_opened(bounded, ranges), "opened")
    later = _searched(blocks, opened, k, every=False).select("query_id", "vec_id", "score")
    return _ranked(near.drop("rank").unionByName(later), k)
