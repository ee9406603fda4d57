"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C
from govlens.operators.common import stored

# Character n-grams share this many vectors of this length.
BUCKETS = 1 << 17
DIMENSIONS = 4
GRAMS = (3, 4, 5, 6)
# A text is judged by passages of so many words, each starting half a passage after the one before.
PASSAGE_WORDS = 8
# The training sample: labelled rows of each class, and passages of each row.
ROWS_PER_CLASS = 1_500
PASSAGES_PER_ROW = 64
SEED = 5
# Weight of passages of toxic rows against those of others while it is open which of them are toxic.
TOXIC_SHARE = 0.2
# Calibration: log odds that the highest of many passages gains by chance, and the weight of that assumption.
CHANCE = 1.25
PRIOR_ROWS = 5.0


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the word of each, in the order of words. A space marks both ends of a word."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8) if words else np.empty(0, np.uint8)
    space = np.cumsum(text == 32)
    found, owners = [], []
    for n in GRAMS:
        m = max(0, len(text) - n + 1)
        code = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + text[k : k + m]
        inside = space[n - 2 : n - 2 + m] == space[:m]  # no space between the first and the last character
        found.append((C.mixed(code[inside]) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append((space[:m][inside] - 1).astype(np.int32))
    code, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], owner[order]


def passages(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of a text of n words; the last one ends with the text."""
    starts = np.arange(0, max(1, n - PASSAGE_WORDS // 2), PASSAGE_WORDS // 2)
    ends = np.minimum(starts + PASSAGE_WORDS, n)
    return np.maximum(0, ends - PASSAGE_WORDS), ends


@dataclass
class Model:
    """Per bucket what it adds to the log odds of a passage, and what calibration makes of a text's highest odds."""

    weights: np.ndarray
    slope: float
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, owner = grams_of(words)
        n = np.maximum(1, np.bincount(owner, minlength=len(words)))
        return np.bincount(owner, self.weights[bucket], minlength=len(words)) / n

    def highest(self, texts: pa.Array) -> np.ndarray:
        """Log odds of a text's most toxic passage, without the layer's constant; -inf without words."""
        ids, words, starts = C.words_of(texts, lower=True)
        sums = np.concatenate([[0.0], np.cumsum(self.word_scores(words)[ids])])
        out = np.full(len(starts) - 1, -np.inf)
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if b > a:
                first, end = passages(b - a)
                out[i] = ((sums[a + end] - sums[a + first]) / (end - first)).max()
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1; 0 for a text without words."""
        best = self.highest(texts)
        odds = np.clip(self.slope * np.where(np.isinf(best), 0, best) + self.bias, -500, 500)
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-odds)))


class Trainer:
    """Vectors of the n-grams and the softmax layer, trained together by AdaGrad on passages."""

    def __init__(self, rows: list[list[list[str]]], labels: np.ndarray):
        """``rows``: for each row its passages, as lists of words."""
        flat = [p for r in rows for p in r]
        every = sorted({w for p in flat for w in p})
        number = {w: i for i, w in enumerate(every)}
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.label = labels[self.row]
        lengths = np.array([len(p) for p in flat])
        self.lengths, self.begin = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.words = np.fromiter((number[w] for p in flat for w in p), np.int64, self.begin[-1])
        self.gram, owner = grams_of(every)
        self.gram_begin = np.searchsorted(owner, np.arange(len(every) + 1))
        rng = np.random.default_rng(SEED)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.squares = [np.full(x.shape, 1e-6, np.float32) for x in (self.vectors, self.out, self.bias)]
        self.rng = rng

    def _bags(self, chosen: np.ndarray):
        n = self.lengths[chosen]
        seat = np.repeat(np.arange(len(chosen)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[chosen], n)
        word, place = np.unique(self.words[at], return_inverse=True)
        count = self.gram_begin[word + 1] - self.gram_begin[word]
        of = np.repeat(np.arange(len(word)), count)
        gram = self.gram[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.gram_begin[word], count)]
        mean = self._sum(of, self.vectors[gram], len(word)) / np.maximum(1, count)[:, None]
        bags = self._sum(seat, mean[place], len(chosen)) / n[:, None]
        return bags, (seat, place, n, of, gram, count)

    @staticmethod
    def _sum(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, values[:, d], minlength=n) for d in range(values.shape[1])], 1)

    def probabilities(self, chosen: np.ndarray) -> np.ndarray:
        parts = [self._bags(chosen[i : i + 4096])[0] for i in range(0, len(chosen), 4096)]
        logits = np.concatenate(parts) @ self.out + self.bias
        return 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))

    def epoch(self, chosen: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One pass over the chosen passages; ``weight`` per class."""
        for i in range(0, len(chosen), 256):
            part = chosen[i : i + 256]
            bags, (seat, place, n, of, gram, count) = self._bags(part)
            logits = bags @ self.out + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), self.label[part]] -= 1
            p *= (weight[self.label[part]] / len(part))[:, None]
            to_bags = p @ self.out.T
            to_words = self._sum(place, (to_bags / n[:, None])[seat], len(count)) / np.maximum(1, count)[:, None]
            used, at = np.unique(gram, return_inverse=True)
            steps = (self._sum(at, to_words[of], len(used)), bags.T @ p, p.sum(0))
            for x, s, g, rows in zip((self.vectors, self.out, self.bias), self.squares, steps, (used, ..., ...), strict=True):
                s[rows] += g * g
                x[rows] -= rate * g / np.sqrt(s[rows])

    def fit(self) -> None:
        """First every passage has its row's label. Then a toxic row keeps the passages that look toxic, one at least.

        A toxic row holds harmless passages as well; once the two kinds can be told apart, these are left out. A small
        sample is passed more often.
        """
        chosen = np.arange(len(self.label))
        count = np.bincount(self.label, minlength=2)
        # As if most passages of any kind were harmless, whatever the shares of the classes in the sample.
        harmless = np.array([1.0, min(4.0, TOXIC_SHARE * count[0] / max(1, count[1]))])
        passes = max(1, min(10, 240 * 256 // max(1, len(chosen))))
        for rate in (0.1,) * (2 * passes) + (0.05,) * passes:
            self.rng.shuffle(chosen)
            self.epoch(chosen, harmless, rate)
        for rate in (0.1,) * (2 * passes) + (0.05,) * (2 * passes):
            toxic = np.flatnonzero(self.label == 1)
            p = self.probabilities(toxic)
            order = np.lexsort((-p, self.row[toxic]))
            best = C.changes(self.row[toxic][order]) | (p[order] >= 0.5)
            chosen = np.concatenate([toxic[order][best], np.flatnonzero(self.label == 0)])
            self.rng.shuffle(chosen)
            self.epoch(chosen, self._balance(chosen), rate)

    def _balance(self, chosen: np.ndarray) -> np.ndarray:
        """Weights that lift the rarer class a little."""
        count = np.maximum(1, np.bincount(self.label[chosen], minlength=2))
        return (count.max() / count) ** 0.25

    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def _calibrated(best: np.ndarray, labels: np.ndarray, weight: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and bias of the logistic curve that fits rows kept out of training, by Newton's method
    with shortened steps.

    A few rows must not decide alone: PRIOR_ROWS draw the curve to the passages' own odds, less what the highest of many
    passages gains by chance.
    """
    x = np.stack([best, np.ones(len(best))], 1)
    prior = np.array([1.0, bias - CHANCE])

    def loss(theta: np.ndarray) -> float:
        odds = x @ theta
        return float((weight * (np.logaddexp(0, odds) - labels * odds)).sum() + PRIOR_ROWS / 2 * ((theta - prior) ** 2).sum())

    theta, now = prior, loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        slope = x.T @ (weight * (p - labels)) + PRIOR_ROWS * (theta - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and (after := loss(theta - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - after < 1e-9:
            break
        theta, now = theta - size * step, after
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, float(prior[1]))


def _sampled(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, training: Column
) -> tuple[dict[int, int], DataFrame]:
    """Rows of each class, and (id, label, passages) of a bounded number of them, picked by hash."""
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    there = docs.filter(training & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    usable = stored(known.join(there, "_id", "left_semi"), "labelled").withColumn("_draw", F.xxhash64("_id", F.lit(SEED)))
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}  # two rows
    few = [
        C.thinned(usable.filter(F.col("_label") == c), F.col("_draw"), counts.get(c, 0), ROWS_PER_CLASS) for c in (0, 1)
    ]
    parts = [rows.orderBy("_draw", "_id").limit(ROWS_PER_CLASS) for rows in few]
    picked = F.broadcast(parts[0].unionByName(parts[1]).select("_id", "_label"))  # at most 2 * ROWS_PER_CLASS rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(picked, "_id")
    rows = rows.dropDuplicates(["_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            found = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().lower().split()
                words = [w.decode() for w in words]
                first, end = passages(len(words))
                keep = np.unique(np.linspace(0, len(first) - 1, PASSAGES_PER_ROW).astype(int))
                found.append([" ".join(words[a:b]) for a, b in zip(first[keep], end[keep], strict=True) if b > a])
            yield pa.record_batch(
                {"id": batch.column("_id"), "label": batch.column("_label"), "passages": pa.array(found, pa.list_(pa.string()))}
            )

    kind = dict(docs.dtypes)[id_col]
    return counts, rows.select("_id", "_label", "text").mapInArrow(
        cut, f"id {kind}, label int, passages array<string>"
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    training: Column | None = None,
) -> Model:
    """Train on labelled rows for which ``training`` holds: ROWS_PER_CLASS of each class at most, picked by hash.

    Labels other than 0 and 1 and rows without text do not count; a row labelled both ways counts as 1. A fifth of the
    rows is kept out and calibrates the scores, weighted by the true numbers of both classes. If a class has no rows,
    the model gives every text the label of the other one, 0 without any labels.
    """
    counts, picked = _sampled(docs, labels, id_col, text_col, label_col, F.lit(True) if training is None else training)
    rows = sorted((r for r in picked.collect() if r["passages"]), key=lambda r: (r["id"], r["passages"]))
    label = np.array([r["label"] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 1.0, 500.0 if label.any() else -500.0)
    apart = np.zeros(len(rows), bool)
    for c in (0, 1):
        apart[np.flatnonzero(label == c)[4::5]] = True
    once: dict[str, str] = {}  # one object for each distinct word: the driver holds the whole sample
    words = [
        [[once.setdefault(w, w) for w in p.split(" ")] for p in rows[i]["passages"]] for i in np.flatnonzero(~apart)
    ]
    trainer = Trainer(words, label[~apart])
    del words, once
    trainer.fit()
    bias = float(trainer.bias[1] - trainer.bias[0])
    model = Model(trainer.weights(), 1.0, bias - CHANCE)
    if len(set(label[apart].tolist())) == 2:
        flat = pa.array([p for i in np.flatnonzero(apart) for p in rows[i]["passages"]])
        ends = np.cumsum([len(rows[i]["passages"]) for i in np.flatnonzero(apart)])
        best = np.maximum.reduceat(model.highest(flat), np.concatenate([[0], ends[:-1]]))
        share = np.array([counts[c] / max(1, (label[apart] == c).sum()) for c in (0, 1)])
        weight = share[label[apart]] * len(best) / share[label[apart]].sum()
        model.slope, model.bias = _calibrated(best, label[apart], weight, bias)
    return model


def scored(
    docs: DataFrame, model: Model, text_col: str = "text", carry: Iterable[str] = ("doc_id",), least: float | None = None
) -> DataFrame:
    """The carried columns with ``score``, the probability of label 1. With ``least``: only rows that score below it.

    A text is lower-cased (A-Z) and cut at white space; a word is the mean vector of its character n-grams, a passage
    the mean of its words, and the softmax layer judges the passage. A text scores as its most toxic passage, so a long
    text is judged as strictly as a short one; every word is read. Texts are scored where they are read, without a
    shuffle. A null text or one without words scores 0. Repeated rows score alike; an empty table gives an empty result.
    """
    carry = list(carry)
    shared = C.Shared(docs.sparkSession, model)  # BUCKETS numbers
    rows = docs.select(F.col(text_col).cast("string").alias("_scored_text"), *[F.col(c) for c in carry])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            found = shared.value.scores(batch.column("_scored_text"))
            arrays = [*batch.columns[1:], pa.array(found, pa.float64())]
            out = pa.RecordBatch.from_arrays(arrays, names=[*carry, "score"])
            yield out if least is None else out.filter(pa.array(found < least))

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], "score double"])
    return rows.mapInArrow(score, schema)
