"""Streaming jobs that keep state of their own: sessions that end by a timer, counters that expire, rows taken in order.

State lives in RocksDB, an entry per session (for keys: per bucket of them) and the rows that wait, and each job empties it
by itself: by a timer, or by a time to live. Rows reach the Python side as Arrow batches, grouped by key.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from govlens.operators.access import access_status, key_hash
from govlens.operators.access_history import CHANGE_SCHEMA
from govlens.schemas import END_STATUSES
from govlens.streaming.jobs import update_writer

# Processors travel with their class: the Python workers, one of them beside the driver, need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ABANDONED = END_STATUSES[1]
# Groups that keys are dealt to by a hash. What a group costs beside its rows is paid so many times per batch at most.
KEY_BUCKETS = 1024
# Rows of a bucket that are kept as one value.
ROWS_PER_PIECE = 10_000
# The times of pandas end in 2262: for the watermark, what lies after this one is divided. What lies before 1970 is late.
EXACT, DIVISOR = "2250-01-01", 1 << 15


def _ms(length: timedelta) -> int:
    return int(length / timedelta(milliseconds=1))


class Silence(StatefulProcessor):
    """Ends a session when a time has passed since its last message arrived, whatever else arrives."""

    def __init__(self, gap: timedelta):
        self.gap = _ms(gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "last long, n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, n, due = self.session.get() or (None, 0, None)
        closed = False
        for row in rows:
            n += 1
            last = row.at if last is None or (row.at is not None and row.at > last) else last
            closed = closed or row.closes
        if due is not None:
            self.handle.deleteTimer(due)
        if closed:
            self.session.clear()
        else:
            due = timerValues.getCurrentProcessingTimeInMs() + self.gap
            self.handle.registerTimer(due)
            self.session.update((last, n, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.session.exists():
            return
        last, n, _ = self.session.get()
        self.session.clear()
        yield Row(session_id=key[0], n_messages=n, last=last)

    def close(self) -> None:
        pass


def silent_sessions(messages: DataFrame, gap: timedelta = timedelta(minutes=30)) -> DataFrame:
    """End events (session_id, status, ended_at, n_messages) of sessions without a message for ``gap``.

    The time counts from the arrival of the last message, on the clock: a session ends although no other event follows,
    and one that resumes in time goes on. ``ended_at`` is ``gap`` after the time of its last message. A session of which
    a message has the flag ``closes`` (if there is such a column) was ended by its client and is not abandoned. After the
    end nothing is kept of a session; if it resumes later, it is a new one here, and ends again, later, for
    ``end_conversations``. Messages without a session are ignored.
    """
    closes = F.coalesce("closes", F.lit(False)) if "closes" in messages.columns else F.lit(False)
    rows = messages.filter(F.col("session_id").isNotNull()).select(
        "session_id", F.unix_micros("timestamp").alias("at"), closes.alias("closes")
    )
    ended = rows.groupBy("session_id").transformWithState(
        Silence(gap), "session_id string, n_messages long, last long", "append", "processingTime"
    )
    micros = _ms(gap) * 1_000
    return ended.select(
        "session_id",
        F.lit(ABANDONED).alias("status"),
        F.timestamp_micros(F.col("last") + F.lit(micros)).alias("ended_at"),
        "n_messages",
    )


class Counters(StatefulProcessor):
    """Running counts of a session, forgotten when it has been idle for a time."""

    def __init__(self, idle: timedelta):
        self.idle = _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, pii long, blocked long", ttlDurationMs=self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, pii, blocked = self.counts.get() or (0, 0, 0)
        for row in rows:
            n, pii, blocked = n + row.n, pii + row.pii, blocked + row.blocked
        self.counts.update((n, pii, blocked))
        yield Row(session_id=key[0], message_count=n, total_pii_incidents=pii, total_blocked=blocked)

    def close(self) -> None:
        pass


def expiring_counters(messages: DataFrame, idle: timedelta = timedelta(days=2)) -> DataFrame:
    """Messages, PII incidents and blocked messages per session, kept current; rows are the sessions each batch changed.

    The counts of a session that has had no message for ``idle`` leave the state; if it resumes after that, they begin
    anew, so ``idle`` must be longer than sessions pause.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int").alias(name.removeprefix("has_").removeprefix("was_"))
    rows = messages.select("session_id", F.lit(1).alias("n"), flag("has_pii"), flag("was_blocked"))
    out = "session_id string, message_count long, total_pii_incidents long, total_blocked long"
    return rows.groupBy("session_id").transformWithState(Counters(idle), out, "update", "processingTime")


# (state or None, row) -> (state, values of the result row or None)
Advance = Callable[[tuple | None, Row], tuple[tuple | None, tuple | None]]


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then takes them in the order of their time.

    A key has one timer, for the earliest row that waits (or for the end of its state), and touches its state a few times
    per batch, however many rows it has.
    """

    def __init__(self, advance: Advance, row: T.StructType, state: str, out: list[str], idle: timedelta):
        self.advance, self.row, self.state, self.out, self.idle = advance, row, state, out, _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.known = handle.getValueState("known", self.state)
        self.timer = handle.getValueState("timer", "due long, last long")

    def _due(self, due: int | None, last: int | None) -> None:
        before = self.timer.get()
        if before is not None and before[0] != due:
            self.handle.deleteTimer(before[0])
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due, last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(row[f] for f in self.row.names) for row in rows]
        waiting, (due, last) = self.waiting.exists(), self.timer.get() or (None, None)
        self.waiting.appendList(new)
        first = min(row[0] for row in new)
        if not waiting or first < due:
            self._due(first, last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((row for row in rows if row[0] <= now), key=lambda row: row[:2])
        later = [row for row in rows if row[0] > now]
        state, (_, last) = self.known.get(), self.timer.get() or (None, None)
        make, result = Row(*self.row.names), Row(*self.out)
        for row in due:
            state, found = self.advance(state, make(*row))
            if found is not None:
                yield result(*found)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        last = due[-1][0] if due else last
        if state is not None and last is not None and last + self.idle > now:
            self.known.update(tuple(state))
            self._due(min([last + self.idle, *(row[0] for row in later)]), last)
        else:
            self.known.clear()
            self._due(min((row[0] for row in later), default=None), last)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame,
    keys: list[str],
    order: str,
    advance: Advance,
    state: str,
    out: str,
    late: str = "1 hour",
    idle: timedelta = timedelta(days=30),
) -> DataFrame:
    """Apply ``advance`` to the rows of each key in the order of (timestamp, ``order``, a whole number), once the watermark is past it.

    Rows may arrive in any order within ``late`` of the newest one; later ones are dropped. Only rows that wait and one
    state per key are kept, and the state goes when a key has been idle for ``idle`` (event time). ``advance`` gets the
    state (None at first) and a row, and returns the state and the values of a result row, or None for no result. Rows
    without a time are left out.
    """
    rest = [f for f in rows.schema.fields if f.name != "timestamp"]
    placed = rows.filter(F.col("timestamp").isNotNull()).withColumns(
        {"_at": F.unix_millis("timestamp"), "_order": F.coalesce(F.col(order).cast("long"), F.lit(-(2**63) + 1))}
    )
    kind = T.StructType([T.StructField("_at", T.LongType()), T.StructField("_order", T.LongType()), *rest])
    processor = InOrder(advance, kind, state, T.StructType.fromDDL(out).names, idle)
    return placed.withWatermark("timestamp", late).groupBy(*keys).transformWithState(processor, out, "append", "eventTime")


def _next_turn(state: tuple | None, row: Row) -> tuple[tuple, tuple]:
    turn = (0 if state is None else state[0]) + (row.role == "user")
    return (turn,), (row.session_id, row.message_id, row.role, row.seq, turn)


def streamed_turn_numbers(
    messages: DataFrame, late: str = "1 hour", idle: timedelta = timedelta(days=30)
) -> DataFrame:
    """(session_id, message_id, role, seq, turn_number) as messages arrive: the streaming twin of ``turn_numbers``.

    Messages are numbered in the order of (timestamp, seq): the number rises with each user message, and a reply carries
    that of the message before it. A message is numbered once the watermark is past it, so that one that arrives late
    still counts in its place. The counter of a session is kept for ``idle`` after its last message.
    """
    rows = messages.select("session_id", "timestamp", "message_id", "role", F.col("seq").cast("long").alias("seq"))
    out = "session_id string, message_id string, role string, seq long, turn_number long"
    return in_order(rows, ["session_id"], "seq", _next_turn, "turn long", out, late, idle)


def _packed(frame: pd.DataFrame) -> bytes:
    """Rows as one value of the state."""
    batch, out = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(packed) as reader:
        return reader.read_pandas()


class Later:
    """Rows that wait on, packed in pieces, and the time of the earliest one."""

    def __init__(self):
        self.first: int | None = None
        self.pieces: list[bytes] = []
        self.open: list[pd.DataFrame] = []

    def add(self, frame: pd.DataFrame) -> None:
        due_ms = int(frame["due_ms"].min())
        self.first = due_ms if self.first is None else min(self.first, due_ms)
        self.open.append(frame)
        if sum(map(len, self.open)) >= ROWS_PER_PIECE:
            self.close()

    def close(self) -> None:
        if self.open:
            self.pieces.append(_packed(pd.concat(self.open, ignore_index=True)))
            self.open = []

    def put(self, waiting: ListState) -> None:
        """In place of what waited."""
        self.close()
        if self.pieces:
            waiting.put([(packed,) for packed in self.pieces])
        elif waiting.exists():
            waiting.clear()


class States:
    """What keys were at any time: ``known`` (key_hash, state) from the start on, and the ``changes`` after that.

    Of several changes of a key at one moment the one with the largest state counts.
    """

    def __init__(self, known: pd.DataFrame, changes: pd.DataFrame):
        changes = changes.sort_values(["at", "state"], kind="stable")
        code, keys = pd.factorize(np.concatenate([known["key_hash"], changes["key_hash"]]))
        self.keys = pd.Index(keys, dtype=object)
        self.moments = np.unique(changes["at"] // 1000)
        rank = np.concatenate([np.zeros(len(known), np.int64), self._rank(changes["at"])])
        by_key = np.argsort(code, kind="stable")
        self.states = np.concatenate([known["state"], changes["state"], [None]])
        self.order = np.append(by_key, len(code))  # the last place holds no state
        self.code = np.append(code[by_key], -1)
        self.place = self.code[:-1] * (len(self.moments) + 1) + rank[by_key]

    def _rank(self, at: pd.Series) -> np.ndarray:
        """How many moments (milliseconds) of change have come."""
        return np.searchsorted(self.moments, at // 1000, side="right")

    def codes(self, key_hash: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for a key without any state."""
        return self.keys.get_indexer(key_hash)

    def at(self, code: np.ndarray, at: pd.Series) -> np.ndarray:
        """The state of each key at a time, that of the same millisecond included; None before its first one."""
        found = np.searchsorted(self.place, code * (len(self.moments) + 1) + self._rank(at), side="right") - 1
        return self.states[self.order[np.where((code >= 0) & (self.code[found] == code), found, len(self.place))]]

    def latest(self) -> pd.DataFrame:
        """(key_hash, state) in the order of the codes."""
        ends = np.flatnonzero(np.diff(self.code))
        return pd.DataFrame({"key_hash": self.keys, "state": self.states[self.order[ends]]})


class AccessInTime(StatefulProcessor):
    """Holds the accesses and changes of a bucket of keys until the watermark has passed them, then judges the accesses.

    The rows of all keys of a bucket are kept and judged as columns, so no key and no row costs a call of its own. A
    bucket has one timer, for the earliest row that waits, or for the first key that will have been idle for ``idle``.
    Accesses are judged piece by piece; only the changes of a bucket and the states of its keys are in memory at once.
    """

    CHANGE, ACCESS = ["key_hash", "due_ms", "at", "state"], ["key_hash", "due_ms", "at", "event_id"]

    def __init__(self, idle: timedelta):
        self.idle = _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", "rows binary")
        self.accesses = handle.getListState("accesses", "rows binary")
        self.known = handle.getValueState("known", "rows binary")
        # When each known key was last seen: moves with every access, unlike what is known of it.
        self.seen = handle.getValueState("seen", "due_ms binary")
        self.timer = handle.getValueState("timer", "due long")

    def _due(self, due: int | None) -> None:
        before = self.timer.get()
        if before is not None and before[0] != due:
            self.handle.deleteTimer(before[0])
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = (self.timer.get() or (None,))[0]
        for frame in rows:
            for kind, waiting, columns in ((0, self.changes, self.CHANGE), (1, self.accesses, self.ACCESS)):
                part = frame.loc[frame["kind"] == kind, columns]
                if len(part):
                    waiting.appendValue((_packed(part),))
                    due_ms = int(part["due_ms"].min())
                    first = due_ms if first is None else min(first, due_ms)
        self._due(first)
        return iter(())

    @staticmethod
    def _passed(waiting: ListState, now: int, later: Later) -> Iterator[pd.DataFrame]:
        """The rows that the watermark has passed, piece by piece; the others are added to ``later``."""
        for (packed,) in waiting.get() if waiting.exists() else ():
            frame = _unpacked(packed)
            due = frame["due_ms"] <= now
            if due.any():
                yield frame[due]
            if not due.all():
                later.add(frame[~due])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        later_changes, later_accesses = Later(), Later()
        none = pd.DataFrame({c: pd.Series(dtype="int64" if c in ("due_ms", "at") else object) for c in self.CHANGE})
        changes = pd.concat([none, *self._passed(self.changes, now, later_changes)], ignore_index=True)
        known = _unpacked(self.known.get()[0]) if self.known.exists() else none[["key_hash", "state"]]
        states = States(known, changes)
        seen = np.full(len(states.keys), np.iinfo(np.int64).min)
        if len(known):
            seen[: len(known)] = np.frombuffer(self.seen.get()[0], np.int64)
        np.maximum.at(seen, states.codes(changes["key_hash"]), changes["due_ms"])
        for frame in self._passed(self.accesses, now, later_accesses):
            code = states.codes(frame["key_hash"])
            np.maximum.at(seen, code[code >= 0], frame["due_ms"].to_numpy()[code >= 0])
            yield pd.DataFrame({"event_id": frame["event_id"], "at": frame["at"], "state": states.at(code, frame["at"])})
        later_changes.put(self.changes)
        later_accesses.put(self.accesses)
        stays = seen + self.idle > now
        if not stays.any():
            self.known.clear()
            self.seen.clear()
        else:
            if len(changes) or not stays.all():
                self.known.update((_packed(states.latest()[stays]),))
            self.seen.update((seen[stays].tobytes(),))
        times = [later.first for later in (later_changes, later_accesses) if later.first is not None]
        self._due(min([*times, *(seen[stays] + self.idle).tolist()], default=None))

    def close(self) -> None:
        pass


def _near(at: Column) -> Column:
    """Times in microseconds, those after ``EXACT`` closer to it, in the same order."""
    last = F.unix_micros(F.lit(EXACT).cast("timestamp"))
    return F.when(at > last, last + F.floor((at - last) / F.lit(DIVISOR))).otherwise(at)


def streamed_access(
    access: DataFrame, changes: DataFrame, late: str = "1 hour", idle: timedelta = timedelta(days=400)
) -> DataFrame:
    """Each access event with its status by the state its key had at that time; key and agent only for valid ones.

    ``access``: (event_id, presented_key, ts); ``changes``: the columns of ``key_changes``, as a stream of their own. Both
    are one stream in the order of time, so a key that is made, revoked or restored while the stream runs counts from its
    moment on. A change must arrive within ``late`` of the newest event, like the accesses. What a key was is kept until it
    has been idle for ``idle`` (event time). Keys are dealt to ``KEY_BUCKETS`` groups; the accesses of a hot key go through
    its group in pieces. Of several changes of a key at one moment a revocation counts. From 2250 on an access may wait
    for events up to ``late`` * ``DIVISOR`` after it.
    """
    none = lambda kind: F.lit(None).cast(kind)
    events = access.select(
        key_hash(F.col("presented_key")).alias("key_hash"), F.lit(1).alias("kind"),
        F.col("event_id").cast("string").alias("event_id"), F.unix_micros("ts").alias("at"), none("string").alias("state"),
    )
    state = "key_id string, agent_id string, inactive boolean, expires_us long"
    values = F.struct(
        "key_id", "agent_id", (~F.col("is_active")).alias("inactive"), F.unix_micros("expires_at").alias("expires_us")
    )
    keys = changes.select(
        "key_hash", F.lit(0).alias("kind"), none("string").alias("event_id"),
        F.unix_micros("valid_from").alias("at"), F.to_json(values).alias("state"),
    )
    both = events.unionByName(keys).filter(F.col("at").isNotNull()).withColumns(
        {"key_hash": F.coalesce("key_hash", F.lit("")), "timestamp": F.timestamp_micros(_near(F.col("at")))}
    )
    both = both.withColumn("due_ms", F.unix_millis("timestamp"))
    bucket = F.pmod(F.xxhash64("key_hash"), F.lit(KEY_BUCKETS)).cast("int")
    judged = (
        both.withColumn("bucket", bucket)
        .withWatermark("timestamp", late)
        .groupBy("bucket")
        .transformWithStateInPandas(AccessInTime(idle), "event_id string, at long, state string", "append", "eventTime")
    )
    judged = judged.withColumn("state", F.from_json("state", state)).select("event_id", "at", "state.*")
    judged = judged.withColumns(
        {"ts": F.timestamp_micros("at"), "expires_at": F.timestamp_micros("expires_us"), "is_active": ~F.col("inactive")}
    )
    judged = judged.withColumn("status", access_status("ts"))
    valid = F.col("status") == "valid"
    return judged.select(
        "event_id", "ts", "status", F.when(valid, F.col("key_id")).alias("key_id"), F.when(valid, F.col("agent_id")).alias("agent_id")
    )


def state_rows(query: StreamingQuery) -> int | None:
    """Entries that a query keeps in its state; None while no batch has told."""
    progress = query.lastProgress
    operators = [] if progress is None else progress["stateOperators"]
    return sum(s["numRowsTotal"] for s in operators) if operators else None


def _run_until(writer: DataStreamWriter, checkpoint: str, every: str, done: Callable[[StreamingQuery], bool], at_most: timedelta) -> None:
    """Run a query whose timers need a trigger on the clock, until ``done`` holds.

    It may take ``at_most`` from the last moment on at which it worked on new input, however long that took.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    fed = time.monotonic()
    try:
        while query.isActive and not done(query):
            if query.status["isDataAvailable"]:
                fed = time.monotonic()
            if time.monotonic() > fed + at_most.total_seconds():
                raise TimeoutError(f"the stream did not come to its end in {at_most} after its input")
            time.sleep(0.2)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def _idle(query: StreamingQuery) -> bool:
    """Whether the last batch got no rows after the ones before had told their state."""
    return state_rows(query) is not None and query.lastProgress["numInputRows"] == 0


def run_while_open(
    ended: DataFrame, path: str, checkpoint: str, every: str = "1 second", at_most: timedelta = timedelta(minutes=10)
) -> None:
    """Append the ends of sessions to Parquet files until all input is taken and no session is open, then stop.

    Where a job should go on, start it with ``run_append`` and an interval: timers fire at every trigger.
    """
    writer = ended.writeStream.format("parquet").outputMode("append").option("path", path)
    _run_until(writer, checkpoint, every, lambda query: _idle(query) and state_rows(query) == 0, at_most)


def run_update_while_fed(
    rows: DataFrame, path: str, checkpoint: str, every: str = "1 second", at_most: timedelta = timedelta(minutes=10)
) -> None:
    """Write the groups that each batch changed, as ``run_update`` does, until a batch gets no input; see ``current``."""
    _run_until(update_writer(rows, path), checkpoint, every, _idle, at_most)
