"""Repair of conversations whose roles no longer alternate: the cheapest edits, found by branch and bound.

A repaired conversation has role initials ``(s?(ua)+)?``. Depth-first search over (rows consumed, state) with an explicit
stack: a node is cut when its cost and the suffix bound of its state exceed the incumbent, or when a cheaper prefix
(ties: the smaller audit) has reached the same node before. The search ends when the stack is empty, so the incumbent is
then proved best. Bounds count for each state what the rows left cost at least; without them long conversations would
be searched again after each better prefix. What an edit may do depends on the state only, so the best edits of a long conversation follow from
those of its segments: each is searched from every state, and a fold over the segments keeps the best prefix per state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from govlens.llm.ranks import named, ranked
from govlens.operators.common import join_dimension, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"

# States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
# The state after a row of the role that the pattern asks for, and that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# What ends a conversation from each state: edits at its end.
CLOSING = {START: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}

SPACE = " \t\n\v\f\r"
# Rows and bytes of a conversation that one task takes as a whole, and rows of a segment of longer ones.
ROWS, BYTES, SEGMENT = 4_096, 16 << 20, 32
# Rows up to which the edits of a conversation are remembered for others with the same roles and faults.
REMEMBERED = 16
# Rows of a conversation whose segments one task searches.
BLOCK = SEGMENT * 512

Best = tuple[int, str]


def _moves(state: int, row: str) -> list[tuple[int, str, int, int]]:
    """(cost, edit, next state, rows consumed). A row is its role's initial and its fault."""
    initial, fault = row
    moves = [(DELETE_COST, DELETE, state, 1), (INSERT_COST, INSERT, NEXT[state], 0)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        moves.append((REROLE_COST + extra, REROLE, NEXT[state], 1))
        if (state, initial) in KEPT:
            moves.append((extra, KEEP, KEPT[state, initial], 1))
    return moves


MOVES = {(s, i + f): _moves(s, i + f) for s in CLOSING for i in "sua-" for f in (BLANK, DUPLICATE, TRUNCATED, SOUND)}


def suffix_bounds(codes: str, goal: int | None) -> list[list[float]]:
    """Per rows consumed and state: what the rows left cost at least, up to the end or to the state ``goal``."""
    none = float("inf")
    if goal is None:
        bounds = [[INSERT_COST * len(CLOSING[s]) for s in CLOSING]]
    else:
        bounds = [[0 if s == goal else none for s in CLOSING]]
    for i in range(len(codes) - 2, -1, -2):
        after, row = bounds[-1], codes[i : i + 2]
        here = [min(c + after[to] for c, _, to, consumed in MOVES[s, row] if consumed) for s in CLOSING]
        for _ in CLOSING:  # insertions lead from state to state
            here = [min(here[s], INSERT_COST + here[NEXT[s]]) for s in CLOSING]
        bounds.append(here)
    return bounds[::-1]


def search(codes: str, start: int = START, goal: int | None = None) -> Best | None:
    """The least (cost, audit) of rows (two letters each: initial and fault) from a state, closing edits included.

    With ``goal`` the search ends in that state, before any closing edits; None if it can't be reached.
    """
    n, least = len(codes) // 2, suffix_bounds(codes, goal)
    incumbent: Best | None = None
    reached: dict[tuple[int, int], Best] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + least[i][state]
        if bound == float("inf"):
            continue
        if incumbent is not None and (bound, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        before = reached.get((i, state))
        if before is not None and before <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n:
            found = (cost, audit) if goal is not None else (bound, audit + CLOSING[state])
            if incumbent is None or found < incumbent:
                incumbent = found
            continue
        moves = [
            (price + least[i + used][to], edit, price, to, used)
            for price, edit, to, used in MOVES[state, codes[2 * i : 2 * i + 2]]
        ]
        moves.sort(reverse=True)  # the most promising is pushed last and searched first
        for _, edit, price, to, used in moves:
            stack.append((i + used, to, cost + price, audit + edit))
    return incumbent


# Most conversations are short and alike in roles and faults: what a task has found of such.
FOUND: dict[str, Best] = {}


def remembered(codes: str) -> Best:
    found = FOUND.get(codes)
    if found is None:
        found = search(codes)
        if len(FOUND) < 1 << 16:
            FOUND[codes] = found
    return found


def fold(segments: Iterable[dict[int, dict[int, Best]]]) -> Best:
    """The least (cost, audit) of a conversation from its segments: per segment, start and end state the best edits.

    Per state the best prefix is kept as (cost, rank, links to its parts). Prefixes of equally many rows never begin one
    another, so their order is that of their first difference, and ranks carry it on without comparing whole audits.
    """
    prefixes: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
    for segment in segments:
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, (cost, rank, _) in prefixes.items():
            for end, (more, audit) in segment[start].items():
                found = (cost + more, rank, audit, start)
                if end not in best or found < best[end]:
                    best[end] = found
        order = sorted(best, key=lambda end: best[end][1:3])
        prefixes = {
            end: (best[end][0], rank, (prefixes[best[end][3]][2], best[end][2])) for rank, end in enumerate(order)
        }
    ends = [(cost + INSERT_COST * len(CLOSING[s]), rank, CLOSING[s], link) for s, (cost, rank, link) in prefixes.items()]
    cost, _, closing, link = min(ends, key=lambda x: x[:2])
    parts = [closing]
    while link is not None:
        link, audit = link
        parts.append(audit)
    return cost, "".join(reversed(parts))


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: blank, a duplicate, truncated, or none."""
    end = text.rstrip(SPACE)
    if not end:
        return BLANK
    return DUPLICATE if seen else SOUND if end[-1] in ".!?" else TRUNCATED


def _code(role: str, fault: str) -> str:
    return (role[:1] if role[:1] in ("s", "u", "a") else "-") + fault


def applied(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    state, rest = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rest)
        if edit == DELETE:
            continue
        state = KEPT[state, role[:1]] if edit == KEEP else NEXT[state]
        yield (role if edit == KEEP else ROLE[state]), text


class Digest:
    """SHA-256 of ``role:text`` lines, fed one by one."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"\n{role}:{text}".encode() if self.any else f"{role}:{text}".encode())
        self.any = True


class Counts:
    """Faults, illegal neighbours and turns of rows in order; parts of a conversation can be added up."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initials: tuple[str, str] | None = None
        self.first_turn = self.last_turn = None

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        self.add((fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, 0, turn is not None), (initial, initial), turn, turn)

    def add(self, numbers: Iterable[int], initials: tuple[str, str], first: int | None, last: int | None) -> None:
        for name, n in zip(self.NAMES, numbers, strict=True):
            setattr(self, name, getattr(self, name) + int(n))
        if self.initials is not None and self.initials[1] + initials[0] not in LEGAL:
            self.illegal += 1
        self.initials = (initials[0] if self.initials is None else self.initials[0], initials[1])
        if first is not None:
            self.turns -= first == self.last_turn  # a turn on both sides is one turn
            self.first_turn = first if self.first_turn is None else self.first_turn
            self.last_turn = last

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


RESULT = "id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _grouped(rows: Iterable[dict], *by: str) -> Iterator[Iterator[dict]]:
    """Runs of rows that agree in ``by``, each as an iterator."""
    for _, group in groupby(rows, key=lambda r: tuple(r[c] for c in by)):
        yield group


def _batched(rows: Iterable[dict], schema: pa.Schema, size: int = 1_000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= size or length >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _short(rows: Iterator[dict]) -> dict:
    """A conversation that fits one task."""
    counts, seen, kept, codes, conv = Counts(), set(), [], [], None
    for row in rows:
        conv = row["id"]
        if not row["present"]:
            continue
        role, text = row["role"], row["text"]
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        counts.row(row["turn"], role[:1], fault)
        codes.append(_code(role, fault))
        kept.append((role, text))
    cost, audit = (remembered if len(codes) <= REMEMBERED else search)("".join(codes))
    digest = Digest()
    for role, text in applied(kept, audit):
        digest.add(role, text)
    return _result(conv, counts, cost, audit, digest)


def _result(conv: object, counts: Counts, cost: int, audit: str, digest: Digest) -> dict:
    return {
        "id": conv, "gaps": counts.gaps, "blank": counts.blank, "duplicate": counts.duplicate,
        "truncated": counts.truncated, "illegal": counts.illegal, "cost": cost, "audit": audit,
        "repaired_sha256": digest.sha.hexdigest(),
    }


def _segment(rows: Iterator[dict]) -> dict:
    """A segment of a long conversation, searched from every state."""
    counts, codes, out = Counts(), [], {}
    for row in rows:
        role, text = row["role"], row["text"]
        fault = fault_of(text, bool(row["seen"]))
        counts.row(row["turn"], role[:1], fault)
        codes.append(_code(role, fault))
        out.setdefault("key", row["key"])
        out.setdefault("id", row["id"])
        out.setdefault("segment", row["segment"])
    searched = [(s, e, search("".join(codes), s, e)) for s in CLOSING for e in CLOSING]
    best = [(s, e, *found) for s, e, found in searched if found is not None]
    first, last = counts.initials
    return out | {
        "numbers": [getattr(counts, n) for n in Counts.NAMES], "first": first, "last": last,
        "first_turn": counts.first_turn, "last_turn": counts.last_turn,
        "starts": [b[0] for b in best], "ends": [b[1] for b in best], "costs": [b[2] for b in best],
        "audits": [b[3] for b in best],
    }


SEGMENTS = (
    "key string, id {id}, segment long, numbers array<long>, first string, last string, first_turn long, "
    "last_turn long, starts array<long>, ends array<long>, costs array<long>, audits array<string>"
)


def _folded(rows: Iterator[dict]) -> dict:
    """The segments of one conversation in order, to what is known of it but the digest."""
    counts, named_by = Counts(), {}

    def tables() -> Iterator[dict[int, dict[int, Best]]]:
        for row in rows:
            named_by.update(key=row["key"], id=row["id"])
            counts.add(row["numbers"], (row["first"], row["last"]), row["first_turn"], row["last_turn"])
            table: dict[int, dict[int, Best]] = {s: {} for s in CLOSING}
            for s, e, c, a in zip(row["starts"], row["ends"], row["costs"], row["audits"], strict=True):
                table[s][e] = (c, a)
            yield table

    cost, audit = fold(tables())
    out = _result(None, counts, cost, audit, Digest())
    return out | named_by


def _hashed(rows: Iterator[dict]) -> dict:
    """A conversation's result row (position -1), then its rows in order, to the result with the digest of all rows."""
    head = next(rows)
    digest = Digest()
    for role, text in applied(((r["role"], r["text"]) for r in rows), head["audit"]):
        digest.add(role, text)
    return {c: head[c] for c in ("id", *COLUMNS[:-1])} | {"repaired_sha256": digest.sha.hexdigest()}


def _streamed(df: DataFrame, keys: list[str], order: list[str], by: list[str], one, schema: str) -> DataFrame:
    """Apply ``one`` to every run of rows that agree in ``by``, in tasks that hold all rows of ``keys`` in order.

    Rows pass one by one: a task holds what ``one`` keeps of a run, not the run.
    """
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((one(group) for group in _grouped(_rows(batches), *by)), kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _long_results(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations too long for one task: positions, segments, a fold over them, and a digest as a stream.

    Only the digest, a chain by nature, passes all rows of a conversation through one task, one by one.
    """
    present = rows.filter("present").withColumn("mark", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    placed = stored(ranked(present.drop("present"), "key", ["turn", "role", "text"], "long-conversations"), "long-positions")
    marked = placed.withColumn("mark", F.concat_ws(" ", "mark", "key"))
    first = marked.groupBy("mark").agg(F.min("position").alias("first_seen"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = join_dimension(marked, stored(first.drop("n"), "repeated-rows"), "mark", salt_by=["position"])
    seen = F.coalesce(F.col("position") > F.col("first_seen"), F.lit(False))
    cut = joined.select(
        "key", "id", "turn", "role", "text", "position", seen.alias("seen"),
        F.floor(F.col("position") / F.lit(SEGMENT)).alias("segment"), F.floor(F.col("position") / F.lit(BLOCK)).alias("block"),
    )
    segments = _streamed(cut, ["key", "block"], ["position"], ["key", "segment"], _segment, SEGMENTS.format(id=kind))
    heads = _streamed(segments, ["key"], ["segment"], ["key"], _folded, ("key string, " + RESULT + ", repaired_sha256 string").format(id=kind))
    heads = heads.drop("repaired_sha256").withColumn("position", F.lit(-1).cast("long"))
    both = heads.unionByName(placed.select("key", "id", "position", "role", "text"), allowMissingColumns=True)
    return _streamed(both, ["key"], ["position"], ["key"], _hashed, (RESULT + ", repaired_sha256 string").format(id=kind))


def repaired(rows: DataFrame, id_col: str = "conv_id", present: Column | None = None, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ``rows``.

    ``rows`` hold an id, turn, role and text; null roles and texts count as one space. Rows for which ``present`` does
    not hold name their conversation only. Rows go by turn (null first), then role and text; equal rows are repeats and
    all but the first are duplicates. ``gaps``: turns missing between the lowest and the highest. ``audit`` has one
    letter for each edit: K keep, R new role, D delete, I insert an empty row; of equally cheap audits the smallest.
    A conversation without rows has zeros, an empty audit and the digest of nothing. A null id is a conversation.

    A conversation of up to ``most_rows`` rows and ``most_bytes`` of text is repaired in one piece; the rows of longer
    ones stay out of that shuffle and are taken in segments. Other columns are ignored.
    """
    kind = dict(rows.dtypes)[id_col]
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    text = F.when(here, F.coalesce(F.col("text").cast("string"), F.lit(" ")))
    clean = rows.select(
        named(F.col(id_col)).alias("key"), F.col(id_col).alias("id"), here.alias("present"),
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
    )
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    sizes = clean.groupBy("key").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
    long_ones = stored(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("key"), "long-keys")
    schema = (RESULT + ", repaired_sha256 string").format(id=kind)
    order = ["turn", "role", "text"]
    if long_ones.isEmpty():
        return _streamed(clean, ["key"], order, ["key"], _short, schema).withColumnRenamed("id", id_col)
    short = join_dimension(clean, long_ones, "key", salt_by=order, how="left_anti")
    long = join_dimension(clean, long_ones, "key", salt_by=order, how="left_semi")
    out = _streamed(short, ["key"], order, ["key"], _short, schema).unionByName(_long_results(long, kind))
    # A long conversation none of whose rows is present.
    gone = long.groupBy("key").agg(F.first("id").alias("id"), F.max("present").alias("any")).filter("NOT any")
    empty = _streamed(gone.withColumn("present", F.lit(False)), ["key"], [], ["key"], _short, schema)
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows harmed by a hash of ``conv_id:turn``, and whether a row is still there.

    By crc32 modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    its role user. Nulls, also in conv_id and turn, count as one space.
    """
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    marked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    changed = marked.withColumns(
        {
            "text": F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(harm == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return changed.drop("copy"), F.col("harm") != 0
