"""Quality rules on documents, and the frequency of their lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.llm.ranks import named
from govlens.operators.common import join_dimension, stored

SYMBOLS = b"#*$%&|<>"
# Words of a window that counts as repeated.
WINDOW = 3

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SKETCH = FEATURES + ", text_key binary, lines array<long>, line_words array<long>"


@dataclass(frozen=True)
class Limits:
    """A line goes if more than ``min_documents`` documents of its host have it, and more than ``share`` of them.

    A document is depleted when the lines that go hold more than ``removed_share`` of its words.
    """

    min_documents: int = 10
    share: float = 0.02
    removed_share: float = 0.5


def normalised(lines: pa.Array) -> pa.Array:
    """Lines as they are compared: A-Z in lower case, digits as one 0, white space as one space, trimmed."""
    lines = pc.replace_substring_regex(pc.ascii_lower(lines), "[0-9]+", "0")
    return pc.utf8_trim(pc.replace_substring_regex(lines, "[\\x20\\x09-\\x0D]+", " "), " ")


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(ids: np.ndarray, starts: np.ndarray, n_words: int) -> np.ndarray:
    """Per text: words inside a window of three that its text has at least twice. ``ids``: words as numbers."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(owner[: -WINDOW + 1] == owner[WINDOW - 1 :]) if len(ids) >= WINDOW else np.empty(0, np.int64)
    covered = np.zeros(len(ids), bool)
    if len(at):
        head, tail = ids[at] * n_words + ids[at + 1], owner[at] * n_words + ids[at + 2]
        order = np.lexsort((head, tail))
        new = C.changes(head[order], tail[order])
        group = np.cumsum(new) - 1
        again = at[order[np.bincount(group)[group] > 1]]
        for k in range(WINDOW):
            covered[again + k] = True
    return _sums(covered, starts)


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lines that hold a word: the text of each, all different lines, and which one each is."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(normalised(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    keep = full[kind] if len(kind) else np.zeros(0, bool)
    return owner[keep], coded.dictionary, kind[keep]


def sketches(texts: pa.Array) -> dict[str, pa.Array]:
    """The counts of each text, its hash, and the hashes and sizes of its distinct normalised lines."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    ids, words, starts = C.words_of(texts)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = texts.cast(pa.large_binary())
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    owner, distinct, kind = _lines(texts)
    pairs = np.unique(np.stack([owner, kind]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
    dup = np.bincount(owner, minlength=n) - np.bincount(pairs[0], minlength=n)
    normal = normalised(distinct)
    size_of = pc.add(pc.count_substring(normal, " "), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    hash_of = _hashes(normal.to_pylist())
    order = np.lexsort((hash_of[kind], owner)) if len(owner) else np.zeros(0, np.int64)
    owner, key, size = owner[order], hash_of[kind[order]], size_of[kind[order]]
    new = np.flatnonzero(C.changes(owner, key))
    sizes = np.add.reduceat(size, new) if len(new) else np.zeros(0, np.int64)
    cuts = pa.array(np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32))
    return {
        "n_words": pa.array(np.diff(starts)),
        "word_chars": pa.array(_sums(lengths[ids] if len(ids) else np.zeros(0, np.int64), starts)),
        "n_symbols": pa.array(_sums(symbol[data[: offsets[-1]]], offsets)),
        "n_dup_lines": pa.array(dup.astype(np.int64)),
        "n_repeat_words": pa.array(repeated_words(ids, starts, max(1, len(words))).astype(np.int64)),
        "text_key": pa.array([xxhash.xxh3_128_digest(t) for t in texts.to_pylist()], pa.binary()),
        "lines": pa.ListArray.from_arrays(cuts, pa.array(key[new])),
        "line_words": pa.ListArray.from_arrays(cuts, pa.array(sizes)),
    }


def sketched(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """(carried columns as c0, c1, ..., counts, text_key, lines, line_words) of every row, in one narrow pass."""
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            found = sketches(batch.column("_text"))
            kept = {name: batch.column(name) for name in batch.schema.names if name != "_text"}
            yield pa.RecordBatch.from_pydict({**kept, **found})

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(carry)], SKETCH])
    return docs.select(*columns, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def frequent_lines(sketch: DataFrame, limits: Limits) -> DataFrame:
    """(line_key, host, line, documents) of the lines above the limits. ``sketch``: host, text_key, lines.

    A document counts once per host, however many copies of its text there are: copies are no sign of a frame around
    different texts. Counts are added up in each task before they are shuffled, so a line or a host that a third of all
    documents share costs one row per task.
    """
    texts = sketch.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    of_host = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    each = texts.select("host", F.explode("lines").alias("line"))
    often = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    often = stored(often.filter(F.col("documents") > limits.min_documents), "frequent-lines")
    hosts = stored(of_host.select(named(F.col("host")).alias("host_key"), "host_documents"), "host-documents")
    found = join_dimension(often.withColumn("host_key", named(F.col("host"))), hosts, "host_key", salt_by=["line"])
    return found.filter(F.col("documents") > limits.share * F.col("host_documents")).select(
        F.xxhash64("host_key", "line").alias("line_key"), "host", "line", "documents"
    )


def removed_lines(sketch: DataFrame, limits: Limits) -> DataFrame:
    """(place, n_removed_words, removed) per host and text that lose lines; ``removed`` lists the hashes of those lines."""
    found = stored(frequent_lines(sketch, limits).select("line_key"), "removed-lines")
    each = sketch.select("place", "host", F.inline(F.arrays_zip("lines", "line_words")))
    keyed = each.select(
        "place", F.col("lines").alias("line"), F.col("line_words").alias("words"),
        F.xxhash64(named(F.col("host")), F.col("lines")).alias("line_key"),
    )
    hit = join_dimension(keyed, found, "line_key", salt_by=["place"], how="left_semi")
    once = hit.groupBy("place", "line").agg(F.max("words").alias("words"))  # copies of a text have the same lines
    return once.groupBy("place").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed"))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limits: Limits = Limits(),
    min_words: int = 50,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row with its counts and verdict: (id, carried columns, counts, n_removed_words, removed, base_failed, kept).

    ``base_failed``: fewer than ``min_words`` words, or more than half of them in windows of three words that the text
    has at least twice. ``kept``: neither that, nor depleted. Lines are compared by 64 bits of hash after ``normalised``;
    a line without a word counts nowhere. A document is a distinct text of its host (null is a host of its own).

    The text is read once, into a sketch of some 8 bytes a line, which is stored; everything else works on that. A null
    or empty text has no words, so it fails. Repeated rows are judged alike. An empty table gives an empty result.
    """
    kept = [id_col, host_col, *carry]
    place = F.unhex(F.md5(F.concat(named(F.col("c1")).cast("binary"), F.col("text_key"))))
    raw = stored(sketched(docs, text_col, kept), "line-sketch")
    sketch = raw.withColumn("host", F.col("c1")).withColumn("place", place)
    gone = stored(removed_lines(sketch, limits), "removed-words")
    whole = join_dimension(sketch.drop("lines", "line_words", "host", "text_key"), gone, "place", salt_by=["c0"])
    counts = [c.split()[0] for c in FEATURES.split(", ")]
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = whole.select(
        *[F.col(f"c{i}") for i in (0, *range(2, len(kept)))], *counts, removed.alias("n_removed_words"),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed"), failed.alias("base_failed"),
        (~failed & (removed <= limits.removed_share * F.col("n_words"))).alias("kept"),
    )
    return out.toDF(id_col, *carry, *counts, "n_removed_words", "removed", "base_failed", "kept")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """(id, text) of the documents kept, without the lines above the limits; the other lines stay as they are."""
    found = judged(docs, id_col, text_col, host_col, carry=(text_col,), **options).filter("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            texts = []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                if removed:
                    lines = text.split("\n")
                    gone = np.isin(_hashes(normalised(pa.array(lines)).to_pylist()), removed)
                    text = "\n".join(line for line, out in zip(lines, gone.tolist(), strict=True) if not out)
                texts.append(text)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})

    rows = found.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "removed")
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, text string").toDF(id_col, text_col)
