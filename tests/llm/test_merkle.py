"""The manifest equals a plain tree built by a loop; proofs lead to the root and notice changes."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from govlens.llm import merkle
from govlens.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """(root, siblings of each leaf per level as (left, right))."""
    paths = [[] for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j, (_, leaves) in enumerate(run):
                left, right = ("".join(d for d, _ in x) for x in (run[:j], run[j + 1 :]))
                for i in leaves:
                    paths[i].append((left, right))
            above.append((h(*[d for d, _ in run]), [i for _, leaves in run for i in leaves]))
        nodes = above
    return nodes[0][0], paths


def plain(rows):
    """{(doc_id, leaf): {(subroot, root, path)}} by groups; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], h(*map(framed, row))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        leaves = sorted(groups[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *plain_tree([d for _, d in leaves])))
    root, tops = plain_tree([t[1] for t in trees])
    found = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        found += [(i, leaf, subroot, root, tuple(path + top)) for (i, leaf), path in zip(leaves, paths, strict=True)]
    return sorted(found, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, path int"
VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 7) for r in rows], SCHEMA)


def rows_of(found):
    listed = found.select("doc_id", "leaf", "subroot", "root", "path").collect()
    return sorted(((r[0], r[1], r[2], r[3], tuple((p.left, p.right) for p in r[4])) for r in listed), key=str)


def test_equals_the_plain_tree(spark):
    """Groups of one, of full and of begun runs; nulls, repeated rows and ids, and columns named like results."""
    rows = [(i, f"s{n}", "en", i % 7, f"Text {i}" * (i % 5)) for n in (1, 2, 16, 17, 300) for i in range(n)]
    rows += [(i, None, None, None, None) for i in range(3)] + [(None, "s2", "x", 1, "a"), (None, "s2", "x", 1, "b")]
    rows += [(5, "", "é", 1, "ä" * 40)] * 20 + [(5, "", "é", 1, "z")] + [(9, None, None, None, None)] * 2
    rows += [(i, f"t{i}", "en", 0, "x") for i in range(300)]
    found = merkle.manifest(table(spark, rows), VALUES)
    assert rows_of(found) == plain(rows)


def test_blocks_of_blocks(spark, monkeypatch):
    """With one digit a block, a group needs several tiers; the trees stay the same."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rows = [(i, "big", "en", i, f"t{i}") for i in range(700)] + [(i, f"s{i}", "en", i, "y") for i in range(40)]
    assert rows_of(merkle.manifest(table(spark, rows), VALUES)) == plain(rows)


def test_one_row_and_no_row(spark):
    one = merkle.manifest(table(spark, [(1, "a", None, 2, "")]), VALUES).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    assert merkle.manifest(table(spark, []), VALUES).collect() == []


def test_proofs_notice_changes(spark):
    rows = [(i, f"s{i % 3}", "en", i, "Abc" if i % 2 else "abc") for i in range(100)]
    found = merkle.manifest(table(spark, rows), VALUES, changed=F.when(F.col("doc_id") < 50, F.lower("text")))
    again = merkle.folded(F.coalesce("now_leaf", "leaf"), F.col("path"))
    for r in found.select("doc_id", "root", again.alias("again")).collect():
        assert (r.again == r.root) == (r.doc_id >= 50 or r.doc_id % 2 == 0)


def test_group_of_many_rows_is_spread(spark):
    """No task gets a whole group: a group is dealt out by its blocks."""
    leaves = spark.range(20_000).selectExpr(
        "concat('one', id % 1) AS source", "20000 + id % 1 AS members", "id AS index", "'d' AS digest", "0 AS below"
    )
    blocks = merkle._rolled(leaves, ["source"])
    assert blocks.count() == 5
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*VALUES).collect()
    tree = {(i, leaf): (subroot, root, path) for i, leaf, subroot, root, path in plain([tuple(r) for r in docs])}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in QUERIES["op12_merkle_manifest"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        leaf = h(*map(framed, doc))
        subroot, root, path = tree[doc.doc_id, leaf]
        now = leaf
        if zlib.crc32(str(doc.doc_id).encode()) % 5 == 0 and doc.text is not None:
            now = h(*map(framed, [*doc[:-1], doc.text.translate(lower)]))
        for left, right in path:
            now = h(left, now, right)
        expected = (doc.doc_id, leaf, subroot, root, h(*[a + b for a, b in path]), now, now == root)
        assert tuple(got[doc.doc_id]) == expected


@pytest.mark.parametrize("value, text", [(None, "-"), ("", "0:"), ("é", "2:é"), (-5, "2:-5")])
def test_framing(spark, value, text):
    kind = "long" if isinstance(value, int) else "string"
    assert spark.createDataFrame([(value,)], f"v {kind}").select(merkle.framed(F.col("v"))).first()[0] == text
