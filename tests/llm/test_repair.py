"""Edits are the cheapest of all possible ones, whether a conversation is taken whole or in segments."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from govlens.llm import repair
from govlens.llm.queries import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def plain(codes):
    """All audits with at most two insertions at a place, tried one by one."""
    best = None
    gaps = [("", "I", "II")] * (len(codes) + 1)
    for edits in product("KRD", repeat=len(codes)):
        if any(c[1] in "bd" and e != "D" for c, e in zip(codes, edits, strict=True)):
            continue
        for inserts in product(*gaps):
            audit = "".join(i + e for i, e in zip(inserts, edits, strict=False)) + inserts[-1]
            cost = sum(COST[x] for x in audit) + 3 * sum(c[1] == "t" and e != "D" for c, e in zip(codes, edits, strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            free = []
            for i, e in zip(inserts, edits, strict=False):
                free += ["ua"] * len(i)
            options, row = [], 0
            for x in audit:
                if x == "I":
                    options.append("ua")
                else:
                    if x != "D":
                        options.append("ua" if x == "R" else codes[row][0])
                    row += 1
            if any(PATTERN.fullmatch("".join(o)) for o in product(*options)):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_all_audits(seed):
    draw = random.Random(seed)
    codes = tuple(draw.choice("suuaa-") + draw.choice("----tbd") for _ in range(draw.randint(0, 4)))
    assert repair.search("".join(codes)) == plain(codes)


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_the_whole(seed):
    draw = random.Random(seed)
    codes = [draw.choice("suuaa-") + draw.choice("-----tbd") for _ in range(draw.randint(1, 60))]
    size = draw.randint(1, 7)
    segments = []
    for a in range(0, len(codes), size):
        found = {(s, e): repair.search("".join(codes[a : a + size]), s, e) for s in range(4) for e in range(4)}
        segments.append({s: {e: found[s, e] for e in range(4) if found[s, e] is not None} for s in range(4)})
    assert repair.fold(segments) == repair.search("".join(codes))


@pytest.mark.parametrize("seed", range(5))
def test_long_searches_stay_linear(seed, monkeypatch):
    """Each (rows, state) is opened a few times at most, whatever the faults."""
    draw = random.Random(seed)
    codes = "".join(draw.choice("suuaa-") + draw.choice("---tbd") for _ in range(2_000))
    opened = []

    class Counted(dict):
        def __getitem__(self, key):
            opened.append(key)
            return super().__getitem__(key)

    bounds = repair.suffix_bounds(codes, None)
    monkeypatch.setattr(repair, "suffix_bounds", lambda *_: bounds)
    monkeypatch.setattr(repair, "MOVES", Counted(repair.MOVES))
    cost, audit = repair.search(codes)
    assert cost == bounds[0][repair.START] and sum(x != "I" for x in audit) == 2_000
    assert len(opened) < 5 * 2_000


def plain_result(rows):
    """rows: (turn, role, text) of one conversation, nulls replaced."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    codes, seen, faults = [], set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        fault = "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
        seen.add((role, text))
        faults.append(fault)
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "-") + fault)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = repair.search("".join(codes))
    out, at, last = [], 0, ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        out.append(f"{role}:{text}")
    assert PATTERN.fullmatch("".join(x[:1] for x in out))
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", *repair.COLUMNS).collect()}


def mixed_rows(seed, n):
    draw = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", " "]
    texts = ["Hello.", "Hello", "", " \t\n", "é?", "x" * 50 + "!", "line\nline. ", " "]
    rows = []
    for conv in range(n):
        for turn in range(draw.choice([1, 2, 5, 9, 40])):
            rows.append((conv, draw.choice([turn, turn, turn * 2, None]), draw.choice(roles), draw.choice(texts) + draw.choice(["", str(turn) + "."])))
    return rows + [(None, 1, "user", "Null conversation.")]


SCHEMA = "conv_id long, turn long, role string, text string, cost string, key int, position string"


def test_results_equal_plain_ones_whole_and_in_segments(spark, monkeypatch):
    rows = mixed_rows(1, 60)
    expected = {}
    for conv, *rest in rows:
        expected.setdefault(conv, []).append(tuple(rest))
    expected = {conv: plain_result(found) for conv, found in expected.items()}
    df = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    assert results(repair.repaired(df)) == expected
    assert results(repair.repaired(df, most_rows=8)) == expected
    monkeypatch.setattr(repair, "SEGMENT", 4)
    monkeypatch.setattr(repair, "BLOCK", 8)
    assert results(repair.repaired(df, most_bytes=20)) == expected


def test_nulls_and_missing_rows(spark):
    rows = [(1, None, None, None), (2, 0, "user", None), (3, 0, None, "Hi."), (4, 0, "user", "Hi.")]
    df = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    got = results(repair.repaired(df, present=F.col("conv_id") != 4))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert got[2] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert got[3] == plain_result([(0, " ", "Hi.")])
    assert got[4] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert results(repair.repaired(df, present=F.lit(False), most_rows=0)) == {c: got[4] for c in (1, 2, 3, 4)}
    assert results(repair.repaired(df.limit(0))) == {}


def test_one_long_conversation(spark):
    """60,000 rows: the edits come from segments, and repeats are known across them."""
    rows = spark.range(60_000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") == 50_001, "Row 1.").otherwise(F.concat(F.lit("Row "), F.col("id"), F.lit("."))).alias("text"),
    )
    got = results(repair.repaired(rows))[7]
    assert got[:6] == (0, 0, 1, 0, 0, 7) and got[6] == "K" * 50_001 + "DI" + "K" * 9_998


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    expected = {}
    for row in rows:
        harm = zlib.crc32(f"{row.conv_id}:{row.turn}".encode()) % 20
        role, text = row.role, row.text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        expected.setdefault(row.conv_id, []).extend([(row.turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1))
    expected = {conv: plain_result(found) for conv, found in expected.items()}
    assert results(QUERIES["op13_conversation_repair"](spark, sf_dir)) == expected
