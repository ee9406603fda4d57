"""Substring dedup by seed and extend: passages that occur at two places or more lose every copy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from govlens.llm import chunks as C

# A passage has this many words at least; an anchor is a run of so many words inside it.
WINDOW_WORDS = 35
ANCHOR_WORDS = 8
# Low bits of a packed anchor hold its place in the chunk.
PLACE = 28

FULL = np.dtype([("full", "<u8"), ("n", "u1")])
WINDOW = np.dtype([("second", "<u8"), ("n", "u1")])
# What a chunk learns about an anchor: no partner; its whole reach repeats; compare it window by window; both.
ALONE, WHOLE, COMPARE, SHOWN = 0, 1, 2, 3


class Seeds:
    """The winnowed anchors of a chunk and the range of windows that each stands for.

    Of the runs of ``anchor`` words in a window, the one with the least hash is its anchor, the first if several are
    least. Equal windows have the same anchor at the same place, and windows with one anchor are neighbours.
    """

    def __init__(self, texts: pa.ChunkedArray, window: int, anchor: int):
        self.window = window
        ids, words, self.starts = C.words_of(texts)
        n = len(ids)
        self.hash, self.second = C.Rolling(ids, words, 1), C.Rolling(ids, words, 2)
        self.first = self.last = self.anchor = self.full = np.empty(0, np.int64)
        sizes = np.diff(self.starts)
        if n < window or sizes.max(initial=0) < window:
            self.keys = np.empty(0, np.uint64)
            self.of_key = np.empty(0, np.int64)
            return
        if n >> PLACE:
            raise ValueError("a chunk holds too many words")
        grams = np.arange(n - anchor + 1)
        anchors = self.hash(grams, grams + anchor)
        packed = (anchors >> np.uint64(PLACE) << np.uint64(PLACE)) | grams.astype(np.uint64)
        least, reach, wanted = packed, 1, window - anchor + 1
        while reach < wanted:  # minimum over `reach` neighbours, doubled until the window is covered
            step = min(reach, wanted - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        begin = np.arange(len(place))
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = text[begin] == text[begin + window - 1]
        begin, place = begin[inside], place[inside]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)])
        at = np.flatnonzero(new)
        self.first, self.anchor = begin[at], place[at]
        self.last = begin[np.concatenate([at[1:], [len(begin)]]) - 1]
        whole = self.hash(self.first, self.last + window)
        with np.errstate(over="ignore"):
            where = ((self.anchor - self.first) * window + (self.last - self.first)).astype(np.uint64)
            whole = C.mixed(whole + C.mixed(where + np.uint64(1)))
        key = anchors[self.anchor]
        order = np.lexsort((whole, key))
        key, whole = key[order], whole[order]
        new = C.changes(key, whole)
        self.keys, self.full = key[new], whole[new]
        self.counts = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        self.of_key = np.empty(len(order), np.int64)
        self.of_key[order] = np.cumsum(new) - 1
        self.example = order[new]

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the given runs, and the run of each."""
        lengths = self.last[runs] - self.first[runs] + 1
        run = np.repeat(runs, lengths)
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.first[run] + offset, run

    def compared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows to look for elsewhere: sorted first hashes, second hashes, weights, and starts' places among them."""
        chosen = np.flatnonzero(codes >= COMPARE)
        start, run = self.windows(self.example[chosen]) if len(chosen) else (np.empty(0, np.int64),) * 2
        first, second = (h(start, start + self.window) for h in (self.hash, self.second))
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = C.changes(first, second)
        group = np.cumsum(new) - 1
        weight = np.where(codes[self.of_key[run]] == SHOWN, 2, 1)[order]
        weights = np.minimum(np.bincount(group, weight), 2).astype(np.uint8) if len(order) else np.empty(0, np.uint8)
        places = np.empty((2, len(order)), np.int64)
        places[0], places[1] = start[order], group
        return first[new], second[new], weights, places


def _classes(keys: np.ndarray, more: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Per anchor: does it occur elsewhere, and does its whole reach occur elsewhere?"""
    order = np.lexsort((chunk, more["full"], keys))
    key, full, n = keys[order], more["full"][order], more["n"][order].astype(np.int64)
    new_key, new_full = C.changes(key), C.changes(key, full)
    of_key, of_full = np.cumsum(new_key) - 1, np.cumsum(new_full) - 1
    per_key, per_full = np.bincount(of_key, n), np.bincount(of_full, n)
    kinds = np.bincount(of_key, new_full)
    code = np.full(len(keys), COMPARE, np.uint8)
    code[per_full[of_full] >= 2] = WHOLE
    code[(per_full[of_full] >= 2) & (kinds[of_key] >= 2) & new_full] = SHOWN
    code[per_key[of_key] < 2] = ALONE
    out = np.empty_like(code)
    out[order] = code
    return out


def _repeats(keys: np.ndarray, more: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Per window: does it occur at two places or more?"""
    order = np.lexsort((more["second"], keys))
    key, second = keys[order], more["second"][order]
    new = C.changes(key, second)
    group = np.cumsum(new) - 1
    out = np.empty(len(keys), np.uint8)
    out[order] = (np.bincount(group, more["n"][order]) >= 2)[group]
    return out


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Iterable[str] = (),
    window: int = WINDOW_WORDS,
    anchor: int = ANCHOR_WORDS,
) -> DataFrame:
    """One row per row: id, text, carried columns, n_words, n_removed, ``spans`` of removed words, ``kept_text``.

    Words are runs of characters other than space and \\x09-\\x0D. A word is removed if a window of ``window`` words
    around it occurs at any other place of the input, in the same text included; adjoining windows form the maximal
    repeats in ``spans`` (first word, end). ``kept_text`` has the other words, joined by one space.

    Seeds are winnowed anchors: every window holds one, and equal windows hold the same. Chunks exchange their anchors
    with a hash of the whole reach of each (all windows it stands for). Where the whole reach occurs twice, all its
    windows repeat. Otherwise the anchor is extended to both sides window by window, against the other texts and one
    example of each repeated reach. Groups of copies are never paired: a passage in every text costs one entry per
    chunk. Window and reach are compared by 128 bits of hash.

    A null text has no words and an empty ``kept_text``. Repeated rows are different places, so copies of a row repeat
    each other. An empty table gives an empty result. Only the named columns are read; a carried column keeps its name.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has one word at least and fits the window")
    carry = list(carry)
    parts, shards = C.chunked(docs, id_col, text_col, carry)
    by_chunk = parts.groupBy("_chunk")

    def seeds(table: pa.Table) -> Seeds:
        return Seeds(table.column("text"), window, anchor)

    def anchors(table: pa.Table) -> pa.Table:
        s = seeds(table)
        more = np.empty(len(s.keys), FULL)
        if len(more):
            more["full"], more["n"] = s.full, np.minimum(s.counts, 2)
        return C.ask(C.chunk_of(table), s.keys, shards, more)

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        s = seeds(table)
        first, second, weights, _ = s.compared(C.answers(found, np.uint8))
        more = np.empty(len(first), WINDOW)
        more["second"], more["n"] = second, weights
        return C.ask(C.chunk_of(table), first, shards, more)

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        s = seeds(table)
        of_anchor = found.filter(pa.compute.greater_equal(found.column("_shard"), 0))
        of_window = found.filter(pa.compute.less(found.column("_shard"), 0))
        of_window = of_window.set_column(
            of_window.schema.get_field_index("_shard"), "_shard", pa.compute.negate(of_window.column("_shard"))
        )
        codes = C.answers(of_anchor, np.uint8)
        change = np.zeros(s.starts[-1] + 1, np.int64)
        if len(codes):
            whole = np.flatnonzero(np.isin(codes[s.of_key], (WHOLE, SHOWN)))
            np.add.at(change, s.first[whole], 1)
            np.add.at(change, s.last[whole] + window, -1)
            places = s.compared(codes)[3]
            again = C.answers(of_window, np.uint8)
            start = places[0][again[places[1]] > 0] if len(again) else places[0][:0]
            np.add.at(change, start, 1)
            np.add.at(change, start + window, -1)
        return _without(table, s.starts, np.cumsum(change[:-1]) > 0)

    asked = by_chunk.applyInArrow(anchors, C.ASKED)
    of_anchors = C.answered(asked, _classes, FULL)
    asked = by_chunk.cogroup(of_anchors.groupBy("_chunk")).applyInArrow(extend, C.ASKED)
    of_windows = C.answered(asked, _repeats, WINDOW)
    # Answers about windows have negative shards, from -1 down.
    found = of_anchors.unionByName(of_windows.selectExpr("_chunk", "-1 - _shard AS _shard", "reply"))
    types = dict(docs.select(id_col, *carry).dtypes)
    carried = [f"carried_{i} {types[name]}" for i, name in enumerate(carry)]
    schema = ", ".join(
        [
            f"id {types[id_col]}, text string",
            *carried,
            "n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept_text string",
        ]
    )
    out = by_chunk.cogroup(found.groupBy("_chunk")).applyInArrow(remove, schema)
    return out.toDF(id_col, text_col, *carry, "n_words", "n_removed", "spans", "kept_text")


def _without(table: pa.Table, starts: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The table without the chunk number, with counts, spans and the kept words of each text."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    texts = table.column("text").to_pylist()
    kept, spans, removed = [], [], []
    sums = np.concatenate([[0], np.cumsum(gone)])
    for i, text in enumerate(texts):
        a, b = starts[i], starts[i + 1]
        n = int(sums[b] - sums[a])
        removed.append(n)
        words = (text or "").encode().split()
        if n:
            words = [w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
            lo, hi = np.searchsorted(edge, (a, b), "left")
            # Runs may touch at the border of two texts: cut them there.
            inner = np.unique(np.concatenate([edge[lo:hi], [a] * bool(gone[a]), [b] * bool(gone[b - 1])])).astype(int)
            inner = [int(x) for x in inner if not (x == a and not gone[a]) and not (x == b and not gone[b - 1])]
            spans.append([{"first": x - int(a), "end": y - int(a)} for x, y in zip(inner[::2], inner[1::2], strict=True)])
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    out = table.drop_columns(["_chunk"])
    out = out.append_column("n_words", pa.array(np.diff(starts), pa.int64()))
    out = out.append_column("n_removed", pa.array(removed, pa.int64()))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return out.append_column("spans", pa.array(spans, kind)).append_column("kept_text", pa.array(kept, pa.string()))
