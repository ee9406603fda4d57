"""Shared steps: texts in chunks, and what all chunks together know about the keys of one chunk.

Counting long keys (word windows, byte contexts) over a corpus by one row per occurrence costs far more than the
counting itself. Here a chunk (some megabytes of text) sends its distinct keys once, packed by key range; the task of a
range, a shard, merges what all chunks sent and answers each chunk in the order of its own keys. A chunk then applies
the answers to its texts. Chunk and shard sizes are fixed amounts of text, so their numbers grow with the input and no
task holds more at 1000 times the data. A key that every text holds costs one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text per chunk and per shard.
TEXT_PER_CHUNK = 4 << 20
TEXT_PER_SHARD = 16 << 20
# A row costs memory even when its text is empty.
BYTES_PER_ROW = 64

ASKED = "_shard int, _chunk long, keys binary, more binary"
ANSWERED = "_chunk long, _shard int, reply binary"

U64 = np.uint64


def chunked(
    docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str] = (), per_chunk: int = TEXT_PER_CHUNK
) -> tuple[DataFrame, int]:
    """Rows as (_chunk, id, text, carried columns), and the number of shards.

    A row's chunk depends on its values alone, so a recomputed task gives the same chunks.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(BYTES_PER_ROW)).alias("n")).first()["n"]
    chunks, shards = (max(1, -(-(size or 0) // each)) for each in (per_chunk, TEXT_PER_SHARD))
    chunk = F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks))
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    carried = [F.col(name).alias(f"carried_{i}") for i, name in enumerate(carry)]
    return docs.select(chunk.alias("_chunk"), *columns, *carried), shards


def chunk_of(table: pa.Table) -> int:
    return table.column("_chunk")[0].as_py()


def ask(chunk: int, keys: np.ndarray, shards: int, more: np.ndarray | None = None, whole: int = 0) -> pa.Table:
    """Sorted keys (uint64), cut by range into one row per shard, with an array of the same length beside them.

    Keys that differ in their last ``whole`` bits only are not cut apart.
    """
    edges = np.array([((i << 64) // shards) >> whole << whole for i in range(1, shards)], dtype=U64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return asked_table(
        [i for i, _, _ in rows],
        chunk,
        [keys[a:b].tobytes() for _, a, b in rows],
        [b"" if more is None else more[a:b].tobytes() for _, a, b in rows],
    )


def asked_table(shards: list[int], chunk: int, keys: list[bytes], more: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "_shard": pa.array(shards, pa.int32()),
            "_chunk": pa.array([chunk] * len(shards), pa.int64()),
            "keys": pa.array(keys, pa.binary()),
            "more": pa.array(more, pa.binary()),
        }
    )


def answered(
    asked: DataFrame,
    reply: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    more: np.dtype | None = None,
    keys: np.dtype | type = U64,
) -> DataFrame:
    """Merge each shard. ``reply(keys, more, chunk)`` gets the entries of all chunks and returns one item for each."""

    def one(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, keys) for x in table.column("keys").to_pylist()]
        beside = [np.frombuffer(x, more) for x in table.column("more").to_pylist()] if more is not None else []
        chunks = table.column("_chunk").to_numpy()
        lengths = np.array([len(x) for x in sent])
        out = reply(
            np.concatenate(sent), np.concatenate(beside) if beside else np.empty(0), np.repeat(chunks, lengths)
        )
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        return answered_table(
            table, [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        )

    return asked.groupBy("_shard").applyInArrow(one, ANSWERED)


def answered_table(asked: pa.Table, replies: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "_chunk": asked.column("_chunk"),
            "_shard": asked.column("_shard"),
            "reply": pa.array(replies, pa.binary()),
        }
    )


def answers(table: pa.Table, dtype: np.dtype | type) -> np.ndarray:
    """The answers to one chunk, in the order of its sorted keys."""
    order = np.argsort(table.column("_shard").to_numpy(), kind="stable")
    replies = table.column("reply").to_pylist()
    return np.frombuffer(b"".join(replies[i] for i in order), dtype)


def thinned(df: DataFrame, draw: Column, rows: Column | int, wanted: int) -> DataFrame:
    """Of ``rows`` rows those with the lowest hashes (xxhash64), four times as many as wanted.

    Done before the wanted rows are ranked, so that no task's best rows need to be gathered, however many tasks there are.
    """
    return df.filter((draw.cast("double") / F.lit(2.0**64) + 0.5) * rows < 4 * wanted)


def pieces(batches: Iterator[pa.RecordBatch], size: int = TEXT_PER_CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes each; a row is never cut."""
    for batch in batches:
        step = max(1, min(batch.num_rows, size * batch.num_rows // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def words_of(texts: pa.ChunkedArray | pa.Array, lower: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words as numbers, the distinct words, and where each text's words start (one more entry than texts).

    A word is a longest run of characters other than space and \\x09-\\x0D. A null text has no words.
    """
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    pieces = lists.flatten()
    full = pc.greater(pc.binary_length(pieces), 0)
    keep = full.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)
    coded = pieces.filter(full).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), starts


def changes(*columns: np.ndarray) -> np.ndarray:
    """True for each row of sorted columns that differs from the row before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> U64(29))


class Rolling:
    """Hashes of word ranges in constant time each: sums of hash(word) * base**position, taken modulo 2**64."""

    def __init__(self, ids: np.ndarray, words: list[str], seed: int):
        base = U64(xxhash.xxh3_64_intdigest(b"base", seed) | 5)
        inverse = U64(pow(int(base), -1, 1 << 64))
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), U64, len(words))
        n = len(ids)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[U64(1)], np.full(n, base, U64)]), dtype=U64)
            self.back = np.cumprod(np.concatenate([[U64(1)], np.full(n, inverse, U64)]), dtype=U64)
            self.sums = np.concatenate([[U64(0)], np.cumsum(of_word[ids] * powers[:n], dtype=U64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for each pair."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.back[start])


class Shared:
    """A value of bounded size for all tasks, broadcast with its class, which the executors need not have installed."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"sent": self.sent}

    @property
    def value(self):
        if "found" not in self.__dict__:
            self.__dict__["found"] = cloudpickle.loads(self.sent.value)
        return self.__dict__["found"]
