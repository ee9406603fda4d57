"""N-gram Jaccard join with a token-group matrix: documents whose shingle sets are similar, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.llm.components import components
from govlens.operators.common import stored

# Shingles that the sets of one group, and the queries of one task on a group, hold together (a bound on memory), and
# their numbers of sets (with both, a bound on the comparisons of a task).
GROUP_SHINGLES = 1 << 20
QUERY_SHINGLES = 1 << 22
GROUP_SETS = 1 << 13
QUERY_SETS = 1 << 14
# Within a group: a shingle is a column of the matrix if so many members hold it, and one in so many; cells compared at once.
LEAST_COLUMN = 64
COLUMN_SHARE = 8
CELLS = 1 << 19
SEEN = np.dtype("u1")


class Sets:
    """The distinct shingle sets of a chunk, as sorted arrays of hashes."""

    def __init__(self, texts: pa.ChunkedArray, size: int):
        ids, words, starts = C.words_of(texts, lower=True)
        rolling = C.Rolling(ids, words, 3)
        place = np.arange(len(ids))
        grams = rolling(place[: max(0, len(ids) - size + 1)], place[: max(0, len(ids) - size + 1)] + size)
        self.key_of_row: list[bytes | None] = []
        self.sets: dict[bytes, np.ndarray] = {}
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if a == b:
                self.key_of_row.append(None)
                continue
            if b - a < size:
                found = rolling(np.array([a]), np.array([b]))
            else:
                found = np.sort(grams[a : b - size + 1])
                found = found[C.changes(found)]
            key = xxhash.xxh3_128_digest(found.tobytes())
            self.sets.setdefault(key, found)
            self.key_of_row.append(key)

    def codes(self, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortened hashes of all sets: sorted distinct values, the place of each shingle among them, and counts."""
        if not self.sets:
            return (np.empty(0, np.uint64),) * 3
        return np.unique(
            np.concatenate(list(self.sets.values())) >> np.uint64(shift), return_inverse=True, return_counts=True
        )


def _ask(chunk: int, codes: np.ndarray, counts: np.ndarray, shards: int) -> pa.Table:
    cuts = np.searchsorted(codes, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    counts = np.minimum(counts, 255).astype(SEEN)
    return C.asked_table(
        [i for i, _, _ in rows],
        chunk,
        [codes[a:b].astype("<u4").tobytes() for _, a, b in rows],
        [counts[a:b].tobytes() for _, a, b in rows],
    )


def _frequencies(keys: np.ndarray, more: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    _, group = np.unique(keys, return_inverse=True)
    return np.minimum(np.bincount(group, more), 255).astype(SEEN)[group]


def shingle_sets(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, n, key, prefix, shingles, carried columns) per row. ``key`` names the set; null without words.

    ``prefix`` holds the set's rarest shingles, so many that two sets at the threshold share one of them. It and
    ``shingles`` are null where no other set has any shingle of the prefix, so that the set has no partner. Rarity
    comes from counts over all sets; it only orders the shingles, and counts of shortened hashes serve for that.
    """
    parts, shards = C.chunked(docs, id_col, text_col, carry)
    bits = (shards - 1).bit_length()
    types = dict(docs.dtypes)
    carried = {f"carried_{i}": types[name] for i, name in enumerate(carry)}
    by_chunk = parts.groupBy("_chunk")

    def asks(table: pa.Table) -> pa.Table:
        codes, _, counts = Sets(table.column("text"), size).codes(32 - bits)
        return _ask(C.chunk_of(table), codes, counts, 1 << bits)

    def chooses(table: pa.Table, found: pa.Table) -> pa.Table:
        sets = Sets(table.column("text"), size)
        _, place, _ = sets.codes(32 - bits)
        seen = C.answers(found, SEEN)[place] if len(place) else place
        prefix: dict[bytes, np.ndarray] = {}
        at = 0
        for key, shingles in sets.sets.items():
            n = len(shingles)
            counts = seen[at : at + n]
            at += n
            wanted = n + (-percent * n // 100) + 1
            if np.count_nonzero(counts == 1) < wanted:
                first = np.lexsort((shingles, counts))[:wanted]
                prefix[key] = shingles[first[counts[first] > 1]]
        left = dict(prefix)
        keys = sets.key_of_row
        one = [left.pop(k, None) for k in keys]  # equal sets of a chunk are sent once
        return pa.table(
            {
                "id": table.column("id"),
                "n": pa.array([0 if k is None else len(sets.sets[k]) for k in keys], pa.int64()),
                "key": pa.array(keys, pa.binary()),
                "prefix": pa.array([None if x is None else x.view(np.int64) for x in one], pa.list_(pa.int64())),
                "shingles": pa.array(
                    [None if x is None else sets.sets[k].tobytes() for k, x in zip(keys, one, strict=True)],
                    pa.binary(),
                ),
                **{name: table.column(name) for name in carried},
            }
        )

    asked = by_chunk.applyInArrow(asks, C.ASKED)
    found = C.answered(asked, _frequencies, SEEN, np.dtype("<u4"))
    schema = f"id {types[id_col]}, n long, key binary, prefix array<long>, shingles binary"
    schema = ", ".join([schema, *[f"{name} {kind}" for name, kind in carried.items()]])
    return by_chunk.cogroup(found.groupBy("_chunk")).applyInArrow(chooses, schema)


class Group:
    """The members of a group as a matrix of shingles and members, for exact overlaps with many sets at once.

    Shingles that many members hold are columns of zeros and ones, so that a family of near copies is compared by
    matrix products; of the other shingles there are lists of their holders. A column has at least one member in
    ``COLUMN_SHARE``, so all columns together have at most that many cells for each shingle of the members.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.begin, self.count = np.unique(every[order], return_index=True, return_counts=True)
        dense = np.flatnonzero(self.count >= max(LEAST_COLUMN, len(sets) // COLUMN_SHARE))
        self.column = np.full(len(self.union), -1)
        self.column[dense] = np.arange(len(dense))
        kind = np.float32 if self.sizes.max() < 1 << 15 else np.float64  # both hold 400 times such counts exactly
        self.cells = np.zeros((len(dense), len(sets)), kind)
        self.cells[np.repeat(np.arange(len(dense)), self.count[dense]), self._holders(dense)] = 1

    def _holders(self, at: np.ndarray) -> np.ndarray:
        """Members that hold each of the given places of the union, one after the other."""
        c = self.count[at]
        return self.holder[np.repeat(self.begin[at], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Places in the union of those shingles that it holds."""
        at = np.minimum(np.searchsorted(self.union, shingles), len(self.union) - 1)
        return at[self.union[at] == shingles]

    def overlaps(self, places: list[np.ndarray]) -> np.ndarray:
        """The number of shingles that each set, given by its places, shares with each member."""
        held = np.zeros((len(places), len(self.cells)), self.cells.dtype)
        columns = [self.column[at] for at in places]
        for i, column in enumerate(columns):
            held[i, column[column >= 0]] = 1
        both = held @ self.cells
        for row, at, column in zip(both, places, columns, strict=True):
            np.add.at(row, self._holders(at[column < 0]), 1)
        return both


def _verified(table: pa.Table, percent: int) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Open one group: (set, set linked with it, None) for each component, and (set, None, number of links)."""
    keys = table.column("key").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    own = np.array(table.column("own").to_pylist(), bool)
    members = np.flatnonzero(own)
    # A member is compared with the members before it, any other set with all.
    before = np.where(own, np.cumsum(own) - 1, len(members))
    group = Group([sets[i] for i in members.tolist()])
    asked, places = [], []
    for i in np.flatnonzero(table.column("judged").to_numpy()).tolist():
        at = group.places(sets[i])
        if len(at) * 100 >= percent * len(sets[i]):  # else the union holds too little of it for any member
            asked.append(i)
            places.append(at)
    # The first member of each member's component, as far as links are known.
    first, links = np.arange(len(members)), np.zeros(len(keys), np.int64)
    step = max(1, CELLS // (len(members) + len(group.cells)))
    for start in range(0, len(asked), step):
        block = np.array(asked[start : start + step])
        both = group.overlaps(places[start : start + step])
        # 100 * both >= percent * (size + other size - both)
        both *= 100 + percent
        both -= percent * group.sizes.astype(both.dtype)
        linked = both >= np.array([percent * len(sets[i]) for i in block.tolist()], both.dtype)[:, None]
        linked &= np.arange(len(members)) < before[block][:, None]
        links[members] += np.add.reduce(linked, 0, np.int32)
        links[block] += np.add.reduce(linked, 1, np.int32)
        for row in np.flatnonzero(linked.any(1)).tolist():
            i = block[row]
            found = first[linked[row]]
            if own[i]:
                found = np.append(found, first[before[i]])
            low = found.min()
            if low < found.max():
                joined = np.zeros(len(members), bool)
                joined[found] = True
                first[joined[first]] = low
            if not own[i]:
                yield keys[i], keys[members[low]], None
    for j in np.flatnonzero(first < np.arange(len(members))).tolist():
        yield keys[members[j]], keys[members[first[j]]], None
    for i in np.flatnonzero(links).tolist():
        yield keys[i], None, int(links[i])


def _cuts(shingles: int, sets: int) -> Column:
    """Into how many pieces sets of sizes ``n`` are cut, so that a piece has so many shingles and sets on average."""
    return F.ceil(F.greatest(F.sum("n") / F.lit(shingles), F.count(F.lit(1)) / F.lit(sets)))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): pairs of linked sets that connect every component, and numbers of links (with b null).

    Sets that share a frequent prefix shingle, their leader, form a group; a large group is cut by hash. The
    token-group matrix lists the groups that hold a prefix shingle. A set opens the groups before its own that hold a
    shingle of its prefix and sets of fitting sizes; others cannot hold a partner. When opened, the overlap with the
    union of the group's sets is a second bound; what passes is compared with all members, many sets at once. A group's queries
    are cut by hash into tasks of bounded size. Every link is counted, and written only as far as components need it.
    """
    named = sets.filter(F.col("prefix").isNotNull())
    postings = named.select("key", "n", F.explode("prefix").alias("shingle")).distinct()
    shared = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    postings = stored(postings.join(shared, "shingle"), "postings")
    leaders = postings.groupBy("key", "n").agg(F.max(F.struct("sets", "shingle")).getField("shingle").alias("leader"))
    cut = leaders.groupBy("leader").agg(_cuts(GROUP_SHINGLES, GROUP_SETS).alias("cuts"))
    group = F.struct("leader", F.expr("pmod(xxhash64(key, 1), cuts)").alias("part"))
    grouped = stored(leaders.join(cut, "leader").select("key", "n", group.alias("group")), "groups")
    with_group = postings.join(grouped.select("key", "group"), "key")
    matrix = with_group.groupBy("shingle", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    opened = (
        with_group.withColumnRenamed("group", "home")
        .join(matrix, "shingle")
        .filter((F.col("group") < F.col("home")) & fits)
        .select("key", "n", "group")
        .distinct()
    )
    opened = stored(opened, "openings")
    load = opened.groupBy("group").agg(_cuts(QUERY_SHINGLES, QUERY_SETS).alias("slices"))
    slices = F.greatest(F.coalesce("slices", F.lit(1)), F.lit(1))
    members = (
        grouped.join(load, "group", "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
        .select("key", "group", "slice", F.lit(True).alias("own"), (F.col("slice") == 0).alias("judged"))
    )
    queries = opened.join(load, "group").select(
        "key",
        "group",
        F.expr("pmod(xxhash64(key, 2), slices)").alias("slice"),
        F.lit(False).alias("own"),
        F.lit(True).alias("judged"),
    )
    one_each = (
        named.join(grouped.select("key"), "key", "left_semi")
        .groupBy("key")
        .agg(F.first("shingles").alias("shingles"))
    )
    tasks = members.unionByName(queries).join(one_each, "key")

    def verify(table: pa.Table) -> pa.Table:
        found = list(_verified(table, percent)) if table.num_rows > 1 else []
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)})

    return tasks.groupBy("group", "slice").applyInArrow(verify, "a binary, b binary, links long")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, n_shingles, n_links, component_id, component_key, carried columns) per row.

    Texts are lower-cased (A-Z) and cut into words at space and \\x09-\\x0D; a text's set has its distinct shingles of
    ``size`` words, or the whole sequence if it has fewer. Two texts link when 100 * intersection >= percent * union.
    ``component_id`` is the smallest id reachable by links, the own included. ``n_links`` counts the other distinct
    sets that a row's set links with; rows with equal sets are linked, too, and not counted. ``component_key`` tells
    components apart also where ids repeat; null without words.

    A null text or one without words has no shingle, links with nothing and is its own component. Repeated rows fall
    into one component. A null id is never the smallest; a component of null ids has the id null. An empty table gives
    an empty result. Only the named columns are read. Shingles are compared by 64 bits of hash.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is between 1 and 100")
    sets = stored(shingle_sets(docs, id_col, text_col, size, percent, carry), "shingle-sets")
    found = stored(links(sets, percent), "links")
    roots = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    smallest = sets.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("smallest"))
    rooted = smallest.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    by_root = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    of_key = rooted.join(by_root, "root").join(counts, "key", "left").select("key", "component_id", "n_links", "root")
    component: Column = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        sets.drop("prefix", "shingles")
        .join(of_key, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            component.alias("component_id"),
            F.col("root").alias("component_key"),
            *[F.col(f"carried_{i}").alias(name) for i, name in enumerate(carry)],
        )
    )
