"""Language-model scoring by prediction by partial matching over bytes, and by a unigram model of words beside it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.operators.common import stored

# Bytes of the longest context; 2 to 6.
ORDER = 5
# Bytes that no UTF-8 text holds: before a text and after it. All but START can be predicted.
START, END = 0xFE, 0xFF
SYMBOLS = 255
# A larger chunk repeats more contexts, so less is sent; positions are handled in slices.
TEXT_PER_CHUNK = 8 << 20
SLICE = 1 << 20
# Keys of a shard whose probabilities are worked out at once; all keys of a byte pair stay together.
KEYS_AT_ONCE = 1 << 18

U64 = np.uint64
# A chunk's own counts.
COUNT = np.uint32
# A bijection of 16-bit numbers spreads neighbouring contexts over the shards.
SPREAD = (np.arange(1 << 16, dtype=np.int64) * 40503) & 0xFFFF
GATHERED = np.argsort(SPREAD)


def normalised(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each starts: A-Z in lower case, words joined by one space; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(texts)
    joined = pc.binary_join(lists, " ").cast(pa.large_binary())
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
    starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return data, starts


class Stream:
    """The texts of a chunk in a row, each after ``order`` start marks and before an end mark."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, order: int, chosen: np.ndarray | None = None):
        data, starts = normalised(texts)
        rows = np.arange(len(starts) - 1) if chosen is None else chosen
        lengths = (starts[1:] - starts[:-1])[rows]
        self.order = order
        self.ends = np.cumsum(lengths + order + 1)
        self.begins = self.ends - lengths - order - 1
        self.bytes = np.full(self.ends[-1] if len(rows) else 0, START, np.uint8)
        for a, n, o in zip((self.begins + order).tolist(), lengths.tolist(), starts[rows].tolist(), strict=True):
            self.bytes[a : a + n] = data[o : o + n]
            self.bytes[a + n] = END

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first position, keys of the positions that hold a symbol, their places in the slice).

        A key has the two bytes before the symbol, spread, in its top 16 bits, then the bytes before those, the nearest
        first, and the symbol last. Contexts with one pair of nearest bytes are neighbours, so a shard knows all
        contexts from two bytes up that end alike.
        """
        order, text = self.order, self.bytes
        for a in range(order, len(text), SLICE):
            b = min(len(text), a + SLICE)
            before = [text[a - k : b - k] for k in range(order + 1)]
            pair = (before[2].astype(np.int64) << 8) | before[1]
            keys = SPREAD[pair].astype(U64)
            for k in (*range(3, order + 1), 0):
                keys = (keys << U64(8)) | before[k].astype(U64)
            keys <<= U64(64 - 8 * (order + 1))
            places = np.flatnonzero(text[a:b] != START)
            yield a, keys[places], places


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([np.empty(0, U64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    found, group = np.unique(keys, return_inverse=True)
    return found, np.bincount(group, counts, minlength=len(found)).astype(np.int64)


def gathered(texts: pa.ChunkedArray, training: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk, sorted, and how often each occurs in training texts."""
    keys, counts = [], []
    for learn in (True, False):
        for _, k, _ in Stream(texts, order, np.flatnonzero(training == learn)).slices():
            found, n = np.unique(k, return_counts=True)
            keys.append(found)
            counts.append(n if learn else np.zeros(len(found), np.int64))
            if len(keys) > 8:
                merged = _merged(keys, counts)
                keys, counts = [merged[0]], [merged[1]]
    return _merged(keys, counts)


class Level:
    """Contexts of one length: counts of symbols, and what an escape from the next longer context leaves out."""

    def __init__(self, entry: np.ndarray, total: np.ndarray):
        """``entry``: context and symbol of each key."""
        found, self.first, self.group = np.unique(entry, return_index=True, return_inverse=True)
        counts = np.bincount(self.group, total, minlength=len(found))
        context = np.cumsum(np.concatenate([[0], np.diff(found >> U64(8)) != 0])) if len(found) else found
        self.context = context.astype(np.int64)[self.group]
        self.entry_context = context.astype(np.int64)
        self.seen = counts > 0
        self.count = counts[self.group]
        self.n = np.bincount(self.entry_context, counts)
        self.symbols = np.bincount(self.entry_context, self.seen)

    def left_out(self, shorter: np.ndarray) -> np.ndarray:
        """Per context: how often its symbols occur after the shorter context. ``shorter``: that count per key."""
        return np.bincount(self.entry_context, np.where(self.seen, shorter[self.first], 0), minlength=len(self.n))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each key's symbol after its context. ``keys`` are sorted and distinct.

    From the longest context on that training has, a symbol with count c among n has the probability (c - 1/2) / n, and
    the q symbols seen share an escape of q / 2n (method D). After an escape the symbols seen in the longer context are
    excluded from n and q. Below order 0 all symbols left are equally likely. ``pairs`` are counts of (byte before,
    symbol) over the whole training corpus; orders 1 and 0 come from them.
    """
    symbol = (keys >> U64(64 - 8 * (order + 1))) & U64(255)
    last = GATHERED[(keys >> U64(48)).astype(np.int64)] & 255
    s = symbol.astype(np.int64)
    singles = pairs.sum(0)
    steps: list[tuple[np.ndarray, ...]] = []
    levels = [Level(((keys >> U64(48 - 8 * (k - 2))) << U64(8)) | symbol, counts) for k in range(order, 1, -1)]
    for level, shorter in zip(levels, [*[x.count for x in levels[1:]], pairs[last, s]], strict=True):
        out = level.left_out(shorter)
        steps.append((level.count, level.n[level.context], level.symbols[level.context], out[level.context]))
    seen = pairs > 0
    steps.append((pairs[last, s], pairs.sum(1)[last], seen.sum(1)[last], (seen * singles).sum(1)[last]))
    whole = np.ones(len(keys))
    steps.append((singles[s], whole * singles.sum(), whole * (singles > 0).sum(), whole))
    out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    less, fewer = np.zeros(len(keys)), np.zeros(len(keys))
    for c, n, q, excluded in steps:
        rest, kinds = n - less, q - fewer
        here = ~done & (rest > 0)
        hit, miss = here & (c > 0), here & (c == 0)
        out[hit] += np.log10((c[hit] - 0.5) / rest[hit])
        out[miss] += np.log10(kinds[miss] / (2 * rest[miss]))
        done |= hit
        less, fewer = np.where(n > 0, excluded, 0), np.where(n > 0, q, 0)
    if not done.all():
        out[~done] -= np.log10(SYMBOLS - (singles > 0).sum())
    return out


def by_pairs(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int, at_once: int = 0) -> np.ndarray:
    """``log_probabilities`` of many keys, some at a time: a piece ends between two byte pairs, so it cuts no context."""
    out = np.empty(len(keys), np.float32)
    a = 0
    while a < len(keys):
        b = min(len(keys), a + (at_once or KEYS_AT_ONCE))
        if b < len(keys):
            edge = (keys[b] >> U64(48)) << U64(48)
            before = int(np.searchsorted(keys, edge))
            if before > a:
                b = before
            else:  # one pair has more keys than that: take all of it
                b = len(keys) if edge >> U64(48) == U64(0xFFFF) else int(np.searchsorted(keys, edge + (U64(1) << U64(48))))
        out[a:b] = log_probabilities(keys[a:b], counts[a:b], pairs, order)
        a = b
    return out


class Lookup:
    """Values of sorted keys: a table with one place per key, and a binary search for those that share a place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = U64(64 - max(1, len(keys).bit_length() + 1))
        self.table = np.full(1 << (64 - int(self.shift)), U64(0), U64)
        self.of = np.zeros(len(self.table), values.dtype)
        place = self._place(keys)
        self.table[place], self.of[place] = keys, values

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        out = self.of[place]
        other = np.flatnonzero(self.table[place] != keys)
        out[other] = self.values[np.searchsorted(self.keys, keys[other])]
        return out


def text_scores(stream: Stream, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's positions."""
    out = np.zeros(len(stream.ends))
    if not len(out):
        return out
    value = Lookup(keys, values)
    for a, k, places in stream.slices():
        sums = np.concatenate([[0.0], np.cumsum(value(k).astype(np.float64))])
        first, last = np.searchsorted(stream.ends, a, "right"), np.searchsorted(stream.begins, a + SLICE)
        low, high = (np.searchsorted(places, x[first:last] - a) for x in (stream.begins, stream.ends))
        out[first:last] += sums[high] - sums[low]
    return out


def corpus_pairs(docs: DataFrame, text_col: str, training: Column) -> np.ndarray:
    """Counts of (byte before, symbol) over all training texts: 256 * 256 numbers whatever the size of the corpus."""
    texts = docs.filter(training).select(F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in C.pieces(batches):
            text = Stream(batch.column("text"), 1).bytes
            both = (text[:-1].astype(np.int64) << 8) | text[1:]
            total += np.bincount(both[text[1:] != START], minlength=1 << 16)
        rows = [x.tobytes() for x in total.reshape(256, 256)]
        yield pa.record_batch({"before": pa.array(range(256), pa.int32()), "counts": pa.array(rows, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"before": table.column("before")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "before int, counts binary"
    out = np.zeros((256, 256))
    for row in texts.mapInArrow(count, schema).groupBy("before").applyInArrow(add, schema).collect():  # 256 rows
        out[row["before"]] = np.frombuffer(row["counts"], np.int64)
    return out


class Words:
    """The distinct words of a chunk in the order of their hashes."""

    def __init__(self, texts: pa.ChunkedArray):
        ids, words, self.starts = C.words_of(texts, lower=True)
        first = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))
        order = np.argsort(first)
        if np.any(first[order][1:] == first[order][:-1]):  # order words of equal hash by their letters
            order = np.array(sorted(range(len(words)), key=lambda i: (first[i], words[i])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids, self.words, self.hashes = rank[ids], [words[i] for i in order.tolist()], first[order]


def _count_words(table: pa.Table) -> tuple[list[bytes], int, int]:
    """Answers to all chunks (the counts of their words), the number of training words, and of distinct ones."""
    total: Counter[str] = Counter()
    sent = [x.decode().split("\n") for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, COUNT) for x in table.column("more").to_pylist()]
    for words, n in zip(sent, counts, strict=True):
        for word, m in zip(words, n.tolist(), strict=True):
            if m:
                total[word] += m
    replies = [np.fromiter((total.get(w, 0) for w in words), np.int64, len(words)).tobytes() for words in sent]
    return replies, sum(total.values()), len(total)


def language_scores(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    order: int = ORDER,
) -> DataFrame:
    """(id, carried columns, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A text is lower-cased (A-Z) and cut into words at space and \\x09-\\x0D; an end follows. ``score`` is log10 of the
    probability of its words, joined by one space, and of the end, under prediction by partial matching: contexts of up
    to ``order`` bytes, escapes by method D, symbols of longer contexts excluded. ``base_score`` is that of a unigram
    model: per token log10((c + 1) / (N + V + 1)), c its count, N = ``train_tokens``, V the distinct tokens. ``n_known``
    counts tokens with c > 0. Both learn from all rows for which ``training`` holds (null: not).

    Every chunk sends its distinct contexts and words with their training counts; shards add them up over the whole
    corpus and answer with probabilities and counts, so neither a trie nor a vocabulary must fit one machine. A shard
    holds all contexts that end in the same two bytes; orders 1 and 0 are a table of fixed size, broadcast.

    A null or empty text has only the end. Without training rows all symbols are equally likely and no token is known.
    Repeated rows count and score like others; an empty table gives an empty result. Only named columns are read.
    """
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6")
    learning = F.coalesce(training, F.lit(False))
    flagged = docs.withColumn("_training", learning)
    parts, shards = C.chunked(flagged, id_col, text_col, ["_training", *carry], TEXT_PER_CHUNK)
    by_chunk = parts.groupBy("_chunk")
    pairs = corpus_pairs(docs, text_col, learning)
    ends = int(pairs[:, END].sum())
    shared = C.Shared(docs.sparkSession, pairs)

    def flags(table: pa.Table) -> np.ndarray:
        return table.column("carried_0").to_numpy().astype(bool)

    def send(table: pa.Table) -> pa.Table:
        chunk, training = C.chunk_of(table), flags(table)
        keys, counts = gathered(table.column("text"), training, order)
        grams = C.ask(chunk, keys, shards, counts.astype(COUNT), whole=48)  # all contexts of a pair in one shard
        words = Words(table.column("text"))
        seen = np.bincount(
            words.ids[np.repeat(training, np.diff(words.starts))], minlength=len(words.words)
        ).astype(COUNT)
        edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=U64)
        cuts = [0, *np.searchsorted(words.hashes, edges).tolist(), len(words.words)]
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        # Words go to shards with negative numbers, from -1 down.
        sent = C.asked_table(
            [-1 - i for i, _, _ in rows],
            chunk,
            ["\n".join(words.words[a:b]).encode() for _, a, b in rows],
            [seen[a:b].tobytes() for _, a, b in rows],
        )
        return pa.concat_tables([grams, sent])

    def answer(table: pa.Table) -> pa.Table:
        tokens = distinct = 0
        if table.column("_shard")[0].as_py() < 0:
            replies, tokens, distinct = _count_words(table)
        else:
            sent = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
            seen = [np.frombuffer(x, COUNT) for x in table.column("more").to_pylist()]
            keys = np.unique(np.concatenate(sent))
            total = np.zeros(len(keys), np.int64)
            for k, n in zip(sent, seen, strict=True):  # the keys of one chunk are distinct
                total[np.searchsorted(keys, k)] += n
            value = by_pairs(keys, total, shared.value, order)
            replies = [value[np.searchsorted(keys, k)].tobytes() for k in sent]
        out = C.answered_table(table, replies)
        first = [1] + [0] * (out.num_rows - 1)
        out = out.append_column("tokens", pa.array([tokens * x for x in first], pa.int64()))
        return out.append_column("words", pa.array([distinct * x for x in first], pa.int64()))

    asked = by_chunk.applyInArrow(send, C.ASKED)
    found = stored(asked.groupBy("_shard").applyInArrow(answer, C.ANSWERED + ", tokens long, words long"), "answers")
    sums = found.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()  # two numbers
    tokens, words_known = (sums["tokens"] or 0) + ends, (sums["words"] or 0) + (ends > 0)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text")
        below = pc.less(answers.column("_shard"), 0)
        grams = answers.filter(pc.invert(below))
        of_words = answers.filter(below)
        index = of_words.schema.get_field_index("_shard")
        of_words = of_words.set_column(index, "_shard", pc.negate(of_words.column("_shard")))
        words = Words(texts)
        count = C.answers(of_words, np.int64)
        each = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0)[words.ids])])
        known = np.concatenate([[0], np.cumsum((count > 0)[words.ids])])
        a, b = words.starts[:-1], words.starts[1:]
        n = b - a + 1
        base = each[b] - each[a] + np.log10(ends + 1) - n * np.log10(tokens + words_known + 1)
        keys, _ = gathered(texts, np.zeros(len(n), bool), order)
        total = text_scores(Stream(texts, order), keys, C.answers(grams, np.float32))
        rest = [table.column(f"carried_{i + 1}") for i in range(len(carry))]
        new = [
            pa.array(n, pa.int64()),
            pa.array(known[b] - known[a] + (ends > 0), pa.int64()),
            pa.array(np.full(len(n), tokens), pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(total, pa.float64()),
        ]
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays([table.column("id"), *rest, *new], ["id", *[f"c{i}" for i in range(len(carry))], *names])

    types = dict(docs.dtypes)
    columns = [f"id {types[id_col]}", *[f"c{i} {types[c]}" for i, c in enumerate(carry)]]
    numbers = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = found.select("_chunk", "_shard", "reply").groupBy("_chunk")
    out = by_chunk.cogroup(answers).applyInArrow(score, ", ".join([*columns, numbers]))
    return out.toDF(id_col, *carry, "n_tokens", "n_known", "train_tokens", "base_score", "score")
