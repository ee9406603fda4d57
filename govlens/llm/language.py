"""Language identification: a bidirectional gated recurrent network over bytes labels every position of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.operators.common import stored

# State of each direction, bytes that one run of the network reads, and runs that are computed together.
UNITS = 12
WINDOW_BYTES = 96
TOGETHER = 2048
# The training sample: rows of each language, and windows of each row.
ROWS_PER_LANGUAGE = 300
WINDOWS_PER_ROW = 6
EPOCHS = 5
SEED = 7

UNKNOWN = "und"


def softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)), in place: the network's squashing function, several times cheaper than tanh."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


@dataclass
class Direction:
    """One gated recurrent layer.

    gates = softsign(bytes_gates[x] + h @ state_gates), reset = 1 + gates[:, :UNITS], keep = (1 + gates[:, UNITS:]) / 2,
    new = softsign(bytes_new[x] + reset * (h @ state_new)), h = new + keep * (h - new).
    """

    bytes_gates: np.ndarray
    bytes_new: np.ndarray
    state_gates: np.ndarray
    state_new: np.ndarray

    @classmethod
    def start(cls, rng: np.random.Generator) -> Direction:
        shapes = ((256, 2 * UNITS), (256, UNITS), (UNITS, 2 * UNITS), (UNITS, UNITS))
        return cls(*(rng.normal(0, 0.3, s).astype(np.float32) for s in shapes))

    def states(self, x: np.ndarray, inside: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States after each byte of x (steps, runs). ``inside``: 1 where a run has a byte; others leave it at 0."""
        steps, runs = x.shape
        out = np.empty((steps, runs, UNITS), np.float32)
        h = np.zeros((runs, UNITS), np.float32)
        for t in range(steps):
            gates = self.bytes_gates.take(x[t], axis=0, mode="clip")
            gates += h @ self.state_gates
            softsign(gates)
            inner = h @ self.state_new
            new = (gates[:, :UNITS] + 1) * inner
            new += self.bytes_new.take(x[t], axis=0, mode="clip")
            softsign(new)
            stay = gates[:, UNITS:] * np.float32(0.5)
            stay += np.float32(0.5)
            if keep is not None:
                keep.append((h, gates, inner, new))
            h = h - new
            h *= stay
            h += new
            if inside is not None:
                h *= inside[t]
            out[t] = h
        return out

    def gradients(
        self, x: np.ndarray, inside: np.ndarray, kept: list, to_states: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """Backpropagation through time: gradients of the four parameters, in their order."""
        grads = tuple(np.zeros_like(p) for p in self.parameters())
        to_h = np.zeros_like(to_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, gates, inner, new = kept[t]
            to_h = (to_h + to_states[t]) * inside[t]
            stay = 0.5 + 0.5 * gates[:, UNITS:]
            to_new = to_h * (1 - stay) * (1 - np.abs(new)) ** 2
            reset = 1 + gates[:, :UNITS]
            to_inner = to_new * reset
            to_gates = np.concatenate([to_new * inner, to_h * (h - new) * 0.5], 1) * (1 - np.abs(gates)) ** 2
            np.add.at(grads[0], x[t], to_gates)
            np.add.at(grads[1], x[t], to_new)
            grads[2][...] += h.T @ to_gates
            grads[3][...] += h.T @ to_inner
            to_h = to_h * stay + to_inner @ self.state_new.T + to_gates @ self.state_gates.T
        return grads

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes_gates, self.bytes_new, self.state_gates, self.state_new]


@dataclass
class Network:
    """Both directions and the softmax layer that labels a position from both states."""

    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray
    moments: list = field(default_factory=list)

    @classmethod
    def start(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        out = rng.normal(0, 0.3, (2 * UNITS, len(languages))).astype(np.float32)
        return cls(languages, Direction.start(rng), Direction.start(rng), out, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.parameters(), *self.backward.parameters(), self.out, self.bias]

    def labelled(self, x: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
        """Probabilities (steps, runs, languages) of every position."""
        before = self.forward.states(x, inside)
        after = self.backward.states(x[::-1], None if inside is None else inside[::-1])[::-1]
        return self._softmax(before @ self.out[:UNITS] + after @ self.out[UNITS:] + self.bias)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def step(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray, rate: float) -> None:
        """One Adam step on the mean cross entropy of all positions."""
        kept: tuple[list, list] = ([], [])
        before = self.forward.states(x, inside, kept[0])
        after = self.backward.states(x[::-1], inside[::-1], kept[1])[::-1]
        p = self._softmax(before @ self.out[:UNITS] + after @ self.out[UNITS:] + self.bias)
        p[:, np.arange(len(label)), label] -= 1
        p *= inside / inside.sum()
        to_before, to_after = p @ self.out[:UNITS].T, p @ self.out[UNITS:].T
        flat = p.reshape(-1, p.shape[2])
        to_out = np.concatenate([s.reshape(-1, UNITS).T @ flat for s in (before, after)])
        grads = [
            *self.forward.gradients(x, inside, kept[0], to_before),
            *self.backward.gradients(x[::-1], inside[::-1], kept[1], to_after[::-1]),
            to_out,
            flat.sum(0),
        ]
        if not self.moments:
            self.moments = [[np.zeros_like(g), np.zeros_like(g)] for g in grads]
            self.steps = 0
        self.steps += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for value, g, moment in zip(self.parameters(), grads, self.moments, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-12))
            moment[0] += 0.1 * (g - moment[0])
            moment[1] += 0.001 * (g * g - moment[1])
            a, b = moment[0] / (1 - 0.9**self.steps), moment[1] / (1 - 0.999**self.steps)
            value -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)

    def train(self, windows: list[bytes], labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        data = np.frombuffer(b"".join(windows), np.uint8)
        sizes = np.array([len(w) for w in windows])
        starts = np.cumsum(sizes) - sizes
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 128):
                part = order[i : i + 128]
                x, inside = _block(data, starts[part], sizes[part])
                inside = np.ones((*x.shape, 1), np.float32) if inside is None else inside
                self.step(x, inside, labels[part], 0.02 if epoch < EPOCHS - 2 else 0.005)
        self.moments = []

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Per text the mean of its positions' probabilities; 0 for an empty text. Every byte is read."""
        binary = pc.fill_null(texts, "").cast(pa.large_string())
        starts = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
        size = np.diff(starts)
        windows = -(-size // WINDOW_BYTES)
        text = np.repeat(np.arange(len(size)), windows)
        number = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = starts[:-1][text] + number * WINDOW_BYTES
        length = np.minimum(WINDOW_BYTES, size[text] - number * WINDOW_BYTES)
        out = np.zeros((len(size), len(self.languages)))
        order = np.argsort(-length, kind="stable")  # full windows first: they need no mask
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            x, inside = _block(data, begin[part], length[part])
            p = self.labelled(x, inside)
            sums = p.sum(0) if inside is None else (p * inside).sum(0)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(text[part], sums[:, k], minlength=len(size))
        return out / np.maximum(1, size)[:, None]


def _block(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Bytes (steps, runs) of some windows, and 1 where a window has a byte; None if all have the same length."""
    steps = np.arange(length.max())[:, None]
    at = np.minimum(begin + steps, len(data) - 1)
    inside = None if length.min() == length.max() else (steps < length)[:, :, None].astype(np.float32)
    return data[at].astype(np.intp), inside


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, training: Column) -> DataFrame:
    """(lang, windows) of ROWS_PER_LANGUAGE rows per language, picked by hash; windows lie all over a text.

    A language's rows are first thinned by their hash to a few times the number wanted, so that few are ranked however
    many there are.
    """
    named = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter(F.coalesce(training, F.lit(False)) & F.col("lang").isNotNull())
    narrow = named.select("id", "lang", F.xxhash64("id", F.lit(SEED)).alias("draw"))
    counts = stored(narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    few = C.thinned(narrow.join(counts, "lang"), F.col("draw"), F.col("rows"), ROWS_PER_LANGUAGE)
    picked = stored(few.withColumn("_rank", rank).filter(F.col("_rank") <= ROWS_PER_LANGUAGE), "sample")
    rows = named.join(picked.select("id", "lang").distinct(), ["id", "lang"], "left_semi")
    rows = rows.dropDuplicates(["id", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            found = []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                if not data:
                    found.append([])
                    continue
                n = max(1, len(data) // WINDOW_BYTES)
                places = np.unique(np.linspace(0, n - 1, WINDOWS_PER_ROW).astype(int)) * WINDOW_BYTES
                found.append([data[a : a + WINDOW_BYTES] for a in places.tolist()])
            yield pa.record_batch({"lang": batch.column("lang"), "windows": pa.array(found, pa.list_(pa.binary()))})

    return rows.select("lang", "text").mapInArrow(cut, "lang string, windows array<binary>")


def fit(
    docs: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Network | None:
    """Train on rows for which ``training`` holds and that have text and a language: ROWS_PER_LANGUAGE rows of each
    language, WINDOWS_PER_ROW windows of each row. None without such rows."""
    rows = _sampled(docs, id_col, text_col, lang_col, F.lit(True) if training is None else training).collect()
    pairs = sorted((r["lang"], bytes(w)) for r in rows for w in r["windows"])
    if not pairs:
        return None
    languages = sorted({lang for lang, _ in pairs})
    network = Network.start(languages)
    network.train([w for _, w in pairs], np.array([languages.index(lang) for lang, _ in pairs]))
    return network


def identified(
    docs: DataFrame, network: Network | None, text_col: str = "text", carry: Iterable[str] = ("doc_id",)
) -> DataFrame:
    """The carried columns with ``lang_pred`` and ``score``, the mean probability of that language over all positions.

    The network reads a text in windows of WINDOW_BYTES, from both ends of each, and labels every byte; the text gets the
    language with the highest mean, the first in order among equals. A text that is null, empty or without any letter,
    and any text where no language was learned, is ``und`` with score 0. Texts are read where they lie, without a
    shuffle. Repeated rows get equal results; an empty table gives an empty result.
    """
    carry = list(carry)
    shared = C.Shared(docs.sparkSession, network)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in carry])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in C.pieces(batches):
            texts = pc.fill_null(batch.column("_text"), "")
            letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            if network is None:
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                pooled = network.pooled(texts)
                top = pooled.argmax(1)
                best = [network.languages[i] if ok else UNKNOWN for i, ok in zip(top.tolist(), letters, strict=True)]
                score = np.where(letters, np.clip(pooled[np.arange(len(top)), top], 0, 1), 0.0)
            arrays = [*batch.columns[1:], pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "lang_pred", "score"])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], "lang_pred string", "score double"])
    return rows.mapInArrow(name, schema)
