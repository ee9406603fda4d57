"""Benchmark decontamination by greedy string tiling: documents that hold most of a test item, in any order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C

# Words of a seed, of the shortest tile, and the part of an item's words that tiles must cover.
SEED_WORDS = 5
TILE_WORDS = 3
COVERAGE = 0.8
# Bytes of benchmark text that are held at once, on the driver and in each task; more items are taken in turn.
BLOCK_BYTES = 32 << 20

# ASCII characters other than letters and digits separate words.
SEPARATED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
# Scripts without spaces (Thai, Lao, Burmese, Khmer, Kana, Han): every character is a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

FOUND = (
    "item_words long, covered_words long, coverage double, "
    "tiles array<struct<doc_start:long,item_start:long,words:long>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; a null text has none."""
    text = (text or "").lower()
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(SEPARATED).split()


def rolled(ids: np.ndarray, words: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``words`` word numbers."""
    n = max(0, len(ids) - words + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n].astype(np.uint64) + np.uint64(2))
    return out


@dataclass
class Index:
    """Test items as word numbers, and where their seeds occur: by length, sorted hashes and the item of each."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], seed: int, tile: int) -> Index:
        """An item shorter than a seed, but not than a tile, is one seed as a whole."""
        vocabulary: dict[bytes, int] = {}
        items = [
            np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64) for _, text in rows
        ]
        of_length: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            if len(x) >= min(seed, tile):
                of_length.setdefault(min(seed, len(x)), []).append(i)
        seeds = {}
        for n, those in of_length.items():
            hashes = [rolled(items[i], n) for i in those]
            found, owners = np.concatenate(hashes), np.repeat(those, [len(h) for h in hashes])
            order = np.argsort(found, kind="stable")
            seeds[n] = found[order], owners[order]
        return cls([i for i, _ in rows], items, vocabulary, seeds)

    def candidates(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, the document's word numbers) for pairs that share a seed."""
        known = self.vocabulary.get
        sizes = [len(d) + 1 for d in docs]
        every = np.fromiter((known(w, -1) for d in docs for w in (*d, b"")), np.int64, sum(sizes))
        starts = np.cumsum([0, *sizes])
        outside = np.concatenate([[0], np.cumsum(every < 0)])
        pairs = [np.empty((0, 2), np.int64)]
        for seed, (seeds, owners) in self.seeds.items():
            n = max(0, len(every) - seed + 1)
            whole = np.flatnonzero(outside[seed : seed + n] == outside[:n])
            hashes = rolled(every, seed)[whole]
            low, high = (np.searchsorted(seeds, hashes, side) for side in ("left", "right"))
            hit = high > low
            at, low, count = whole[hit], low[hit], (high - low)[hit]
            item = owners[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            doc = np.repeat(np.searchsorted(starts, at, "right") - 1, count)
            pairs.append(np.stack([doc, item], 1))
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            yield d, i, every[starts[d] : starts[d + 1] - 1]


class Runs:
    """Karp-Rabin hashes of all runs of one length, for any length, from two running products."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        n = len(ids)
        with np.errstate(over="ignore"):
            ahead = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BACK)]), dtype=np.uint64)
            of_word = C.mixed(ids.astype(np.uint64) + np.uint64(2))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(of_word * ahead[:n], dtype=np.uint64)])
        self.taken = np.zeros(n + 1, np.int64)  # how many words before a place are in tiles
        self.free = np.ones(n, bool)

    def hashes(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs without a taken word, and their hashes."""
        n = max(0, len(self.ids) - words + 1)
        at = np.flatnonzero(self.taken[words : words + n] == self.taken[:n])
        with np.errstate(over="ignore"):
            return at, C.mixed((self.sums[at + words] - self.sums[at]) * self.back[at])

    def take(self, places: list[int], words: int) -> None:
        for a in places:
            self.free[a : a + words] = False
        self.taken[1:] = np.cumsum(~self.free)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, words), longest first.

    The longest length at which free runs of both sides agree is found by halving, with Karp-Rabin hashes of all free runs
    of a length. All its matches are taken before shorter ones are looked for, those at the earlier place in the item
    first, then in the document. Pairs of equal runs are never listed: memory follows the words, also where one word is
    repeated a million times on both sides.
    """
    both = Runs(doc), Runs(item)
    chosen: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))  # no longer match is left

    def common(words: int) -> bool:
        of_doc, of_item = (runs.hashes(words)[1] for runs in both)
        return bool(np.isin(of_item, of_doc).any())

    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        if low < least:
            break
        found = _matches(*both, low)
        chosen += [(i, j, low) for i, j in found]
        both[0].take([i for i, _ in found], low)
        both[1].take([j for _, j in found], low)
        longest = low - 1
    return chosen


def _matches(doc: Runs, item: Runs, words: int) -> list[tuple[int, int]]:
    """(place in doc, place in item) of matches of the longest length: none overlaps, the earliest places first."""
    at_doc, of_doc = doc.hashes(words)
    at_item, of_item = item.hashes(words)
    order = np.argsort(of_doc, kind="stable")
    low, high = (np.searchsorted(of_doc[order], of_item, side) for side in ("left", "right"))
    free_doc, item_end, out = doc.free.copy(), -1, []
    next_of: dict[int, int] = {}  # places of a hash in the document that are used up
    for j, a, b in zip(at_item.tolist(), low.tolist(), high.tolist(), strict=True):
        if a == b or j < item_end:
            continue
        k = next_of.get(a, a)
        while k < b:
            i = int(at_doc[order[k]])
            k += 1
            if free_doc[i : i + words].all() and np.array_equal(doc.ids[i : i + words], item.ids[j : j + words]):
                free_doc[i : i + words] = False
                out.append((i, j))
                item_end = j + words
                break
        next_of[a] = k
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, seed: int, tile: int) -> Iterator[Index]:
    """The benchmark in parts of bounded size."""
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for i in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        yield Index.of([tuple(r) for r in part.collect()], seed, tile)


def _judged(texts: list, index: Index, tile: int, coverage: float) -> Iterator[tuple]:
    """(row, item, words of the item, covered words, tiles) of rows that hold enough of an item."""
    for row, i, doc in index.candidates([words_of(t) for t in texts]):
        item = index.items[i]
        found = tiles(doc, item, tile)
        covered = sum(n for _, _, n in found)
        if covered >= coverage * len(item):
            yield row, i, len(item), covered, found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = SEED_WORDS,
    tile: int = TILE_WORDS,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item of which it holds enough: doc id, item id, item_words, covered_words, coverage, tiles.

    Words are lower-cased runs of letters, digits and characters outside ASCII; in scripts without spaces every
    character is one. Documents and items that share a seed
    (a run of ``seed`` words) are tiled: matches of ``tile`` words and more, longest first, none overlapping. An item
    counts as found when tiles cover ``coverage`` of its words, whatever their order in the document.

    Documents are read once per block of the benchmark and never shuffled; blocks have a bounded size. An item of fewer
    words than a seed is a seed as a whole; one of fewer words than a tile is never found, nor one whose parts lie in
    pieces shorter than a seed. A null text has no words; null ids are returned as they are; repeated documents
    and items each give their rows; an empty table on either side gives an empty result. Only the named columns are
    read.
    """
    types = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark, item_col, item_text_col, seed, tile):
        shared = C.Shared(docs.sparkSession, index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in C.pieces(batches):
                found = list(_judged(batch.column("text").to_pylist(), shared.value, tile, coverage))
                if found:
                    row, item, words, covered, tiled = zip(*found, strict=True)
                    names = ("doc_start", "item_start", "words")
                    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
                    placed = [[dict(zip(names, t, strict=True)) for t in x] for x in tiled]
                    yield pa.record_batch(
                        {
                            "id": batch.column("id").take(pa.array(row)),
                            "item": pa.array([shared.value.ids[i] for i in item]),
                            "item_words": pa.array(words, pa.int64()),
                            "covered_words": pa.array(covered, pa.int64()),
                            "coverage": pa.array([c / w for c, w in zip(covered, words, strict=True)], pa.float64()),
                            "tiles": pa.array(placed, kind),
                        }
                    )

        found = rows.mapInArrow(find, f"id {types[0]}, item {types[1]}, {FOUND}")
        out = found if out is None else out.unionByName(found)
    return out.toDF(id_col, item_col, "item_words", "covered_words", "coverage", "tiles")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seed: int = SEED_WORDS,
    tile: int = TILE_WORDS,
    coverage: float = COVERAGE,
) -> DataFrame:
    """The documents, all columns, without those of which ``contaminated`` reports an item."""
    for index in _blocks(benchmark, item_col, item_text_col, seed, tile):
        shared = C.Shared(docs.sparkSession, index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in C.pieces(batches):
                texts = batch.column(text_col).to_pylist()
                bad = {x[0] for x in _judged(texts, shared.value, tile, coverage)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
