"""Merkle manifest of a dataset: a tree of digests per group, a tree over the groups, and a proof for every row.

Ranks of rows are read as digits of base 16. Within blocks of 16**3 nodes the digits are grouped away one after another;
each grouping nests the nodes below as structs in their parent, so a block ends as one row that holds its whole subtree.
Blocks are the nodes of the next tier. Proofs come from the way back: the array of a node's children is transformed into
(child, siblings to its left, to its right) and exploded, digit by digit. Tiers meet in an aggregation over their union,
so no join is needed, and no row holds more than one block, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm.ranks import ranked
from govlens.operators.common import stored

# Bits of a digit: 16 children a node.
DIGIT = 4
# Digits grouped away within one block.
DIGITS = 3

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of texts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as ``bytes:value``, or ``-`` for null: concatenated values can't be read in two ways."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return digest(*[framed(v) for v in values])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path of siblings."""
    return F.aggregate(path, start, lambda below, at: digest(at["left"], below, at["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def _has_level(level: int) -> Column:
    """Whether several nodes remain below this level."""
    return F.col("members") > (1 << (DIGIT * level))


def _rolled(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members, index, digest, below) of nodes to the same of their blocks; ``below`` nests the children."""
    rows = nodes.withColumn("block", F.shiftright("index", DIGIT * DIGITS)).repartition(*keys, "block")
    for level in range(DIGITS):
        children = F.sort_array(F.collect_list(F.struct("index", "digest", "below")))
        parent = F.shiftright("index", DIGIT).alias("index")
        rows = rows.groupBy(*keys, "members", "block", parent).agg(children.alias("below"))
        both = F.sha2(F.array_join(F.transform("below", lambda child: child["digest"]), ""), 256)
        rows = rows.withColumn("digest", F.when(_has_level(level), both).otherwise(F.col("below")[0]["digest"]))
    return rows.drop("block")


def _tiers(nodes: DataFrame, keys: list[str], name: str) -> list[DataFrame]:
    """Blocks of nodes, blocks of these blocks and so on, until each key has one; every tier is stored."""
    tiers: list[DataFrame] = []
    blocks = F.shiftright(F.col("members") + ((1 << (DIGIT * DIGITS)) - 1), DIGIT * DIGITS)
    while True:
        tier = stored(_rolled(nodes, keys), f"{name}-{len(tiers)}")
        tiers.append(tier)
        if (tier.agg(F.max(blocks)).first()[0] or 0) <= 1:
            return tiers
        nodes = tier.select(*keys, blocks.alias("members"), "index", "digest", F.lit(0).alias("below"))


def _opened(blocks: DataFrame, keys: list[str], given: list[str]) -> DataFrame:
    """The nodes of blocks, each with its path: the siblings at every level, from its own up, then the block's path."""
    rows = blocks
    for level in reversed(range(DIGITS)):
        rows = rows.withColumn("digests", F.transform("below", lambda child: child["digest"]))

        def among(child: Column, j: Column) -> Column:
            left = F.array_join(F.slice("digests", F.lit(1), j), "")
            right = F.array_join(F.slice("digests", j + 2, F.lit(1 << DIGIT)), "")
            return F.struct(
                child["index"].alias("index"), child["below"].alias("below"), left.alias("left"), right.alias("right")
            )

        rows = rows.select(*keys, "members", *given, "path", F.inline(F.transform("below", among)))
        longer = F.concat(F.array(F.struct("left", "right")), F.col("path"))
        rows = rows.withColumn("path", F.when(_has_level(level), longer).otherwise(F.col("path"))).drop("left", "right")
    return rows


def _paths(tiers: list[DataFrame], top: DataFrame, keys: list[str], given: list[str]) -> DataFrame:
    """The nodes below the first tier with their paths. ``top``: (keys, path, given) of each key's last block."""
    above = top.withColumn("index", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        both = tier.select(*keys, "index", "members", "below").unionByName(
            above.select(*keys, "index", "path", *given), allowMissingColumns=True
        )
        values = [F.first(c, ignorenulls=True).alias(c) for c in ("members", "below", "path", *given)]
        above = _opened(both.groupBy(*keys, "index").agg(*values), keys, given)
    return above


def proofs(leaves: DataFrame, group: str, order: str, value: str = "leaf") -> DataFrame:
    """All rows of ``leaves`` with (subroot, root, path); ``path`` lists the siblings from the leaf's level up to the root.

    Per ``group`` the digests in ``value`` ascend by ``order`` (nulls first; rows alike in both ascend by digest, and rows
    alike in all three may change places, which no digest shows). While several nodes remain, every 16 consecutive ones,
    the last run fewer, become the digest of their concatenation. What remains is the group's subroot; subroots in the
    order of the group (null first, by bytes) lead to the root in the same way. A null group is a group. Columns must
    be of types that can be ordered. An empty table has no rows and no root.
    """
    rows = ranked(stored(leaves, "merkle-leaves"), group, [order, value], "merkle-sorted")
    key = [group]
    nodes = rows.select(
        group, "members", F.col("position").alias("index"), F.col(value).alias("digest"),
        F.struct(*[c for c in leaves.columns if c != group]).alias("below"),
    )
    tiers = _tiers(nodes, key, "merkle-group")

    tops = tiers[-1].select(F.col(group).alias("group"), F.col("digest").alias("subroot"), F.lit(0).alias("all"))
    numbered = ranked(tops, "all", ["group"], "merkle-groups")
    of_all = numbered.select(
        "all", "members", F.col("position").alias("index"), F.col("subroot").alias("digest"),
        F.struct("group", "subroot").alias("below"),
    )
    root_tiers = _tiers(of_all, ["all"], "merkle-root")
    empty = F.array().cast(PATH).alias("path")
    top = root_tiers[-1].select("all", empty, F.col("digest").alias("root"))
    groups = _paths(root_tiers, top, ["all"], ["root"])
    given = groups.select(F.col("below.group").alias(group), "path", F.col("below.subroot").alias("subroot"), "root")
    found = _paths(tiers, given, key, ["subroot", "root"])
    rest = [F.col("below")[c].alias(c) for c in leaves.columns if c != group]
    return found.select(group, *rest, "subroot", "root", "path")


def manifest(docs: DataFrame, values: list[str], group: str = "source", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """(order, group, leaf, subroot, root, path, now_leaf) of every row: its proof, and the digest of what it holds now.

    ``values`` make the leaf; ``changed`` replaces the last of them in ``now_leaf`` where it is not null, as a row read
    back from a copy would. Other columns are ignored, whatever their names. Repeated rows are leaves of their own.
    """
    columns = [F.col(v) for v in values]
    now = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(*columns[:-1], changed))
    leaves = docs.select(
        F.col(order).alias("order"), F.col(group).alias("group"), leaf(*columns).alias("leaf"), now.alias("now_leaf")
    )
    return proofs(leaves, "group", "order").withColumnsRenamed({"order": order, "group": group})
