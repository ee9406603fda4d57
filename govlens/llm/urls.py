"""URL filter: rules on host and path, and a ratio of two character models for what no rule judges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm import chunks as C
from govlens.llm.ranks import ranked
from govlens.operators.common import running_total, stored

# Bytes of the longest context of the models; 5 at most.
ORDER = 4
# Models with so many entries at most go to every task. Of larger ones the shorter contexts do, and the others are joined.
MOST_ENTRIES = 1_000_000
# One URL in so many sets the threshold. More than MOST_ENTRIES different scores are summed up by ranges of 1 / STEPS.
APART = 5
STEPS = 1 << 14
# Bits of the number of URLs in a chunk, where contexts are joined.
CHUNK_BITS = 14
SEED = 11
# Marks before and after a URL; UTF-8 text holds neither.
START, END = 0xFE, 0xFF

ALLOW, BLOCK = "allow", "block"
MODELS = {"accepted": ALLOW, "rejected": BLOCK}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, with A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does. For a list that fits an expression."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _contexts(urls: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per context length from 0 on: context and symbol of every position; the URL of each position; symbols per URL."""
    lowered = pc.ascii_lower(pc.fill_null(urls, "")).cast(pa.large_string())
    starts = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)
    size = np.diff(starts) + 1
    url = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)

    def byte(back: int) -> np.ndarray:
        at = place - back
        inside = (at >= 0) & (at < size[url] - 1)
        out = np.full(len(at), START, np.uint64)
        out[inside] = data[(starts[:-1][url] + at)[inside]]
        out[at == size[url] - 1] = END
        return out

    key = byte(0)
    found = [key]
    for k in range(1, order + 1):
        key = key | (byte(k) << np.uint64(8 * k))
        found.append(key)
    return found, url, size


class Markov:
    """A variable-order Markov model of bytes: counts for contexts of up to ``order`` bytes.

    The estimate for a context is interpolated with that of the next shorter one: with n occurrences and q different
    symbols, (c + q * shorter) / (n + q) (Witten and Bell); below the empty context all bytes are equally likely.
    """

    def __init__(self, urls: pa.Array, order: int):
        self._count(*np.unique(_contexts(urls, order)[0][-1], return_counts=True), order)

    @classmethod
    def of_counts(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Markov:
        """From the distinct longest contexts with their symbols, and how often each occurs."""
        model = cls.__new__(cls)
        model._count(keys, counts, order)
        return model

    def _count(self, keys: np.ndarray, counts: np.ndarray, order: int) -> None:
        self.order = order
        self.tables = []
        for k in range(order + 1):
            entry, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, counts, len(entry)).astype(np.int64)
            context, first = np.unique(entry >> np.uint64(8), return_index=True)
            n = np.add.reduceat(count, first) if len(first) else count
            kinds = np.diff(np.concatenate([first, [len(entry)]]))
            self.tables.append((entry, count, context, n, kinds))

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of symbols after their contexts, which may be longer than those of the model."""
        p = np.full(len(keys), 1 / 256)
        for k, (entry, count, context, n, kinds) in enumerate(self.tables):
            key = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            total, q = (self._look(context, x, key >> np.uint64(8)) for x in (n, kinds))
            p = np.where(total > 0, (self._look(entry, count, key) + q * p) / np.maximum(1, total + q), p)
        return p

    def log_likelihoods(self, urls: pa.Array) -> np.ndarray:
        """Natural logarithm per URL, the end included."""
        keys, url, size = _contexts(urls, self.order)
        return np.bincount(url, np.log(self.probabilities(keys[-1])), minlength=len(size))


@dataclass
class Ratio:
    """Models of accepted and rejected URLs. The score is their difference of log-likelihoods per symbol.

    ``longer`` has the counts (verdict, key, n) of contexts of ``order`` bytes, where those are too many for the two
    models, which end with shorter contexts then. ``placed`` uses both.
    """

    accepted: Markov | None
    rejected: Markov | None
    threshold: float = 0.0
    longer: DataFrame | None = None
    order: int = ORDER

    def differences(self, urls: pa.Array) -> np.ndarray:
        """Above the threshold: accept. With examples of one kind only, all are of that kind; with none, accepted."""
        if self.accepted is None or self.rejected is None:
            return np.full(len(urls), -1.0 if self.accepted is None and self.rejected is not None else 1.0)
        size = pc.binary_length(pc.fill_null(urls, "")).to_numpy(zero_copy_only=False) + 1
        return (self.accepted.log_likelihoods(urls) - self.rejected.log_likelihoods(urls)) / size


def counted(known: DataFrame, order: int) -> DataFrame:
    """(verdict, key, n): how often each byte follows each context of ``order`` bytes in the URLs of a verdict.

    A batch sends each of its contexts once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            for verdict in (ALLOW, BLOCK):
                urls = batch.column("url").filter(pc.equal(batch.column("verdict"), verdict))
                if len(urls):
                    keys, n = np.unique(_contexts(urls, order)[0][-1], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"verdict": [verdict] * len(keys), "key": keys.astype(np.int64), "n": n})

    found = known.select("url", "verdict").mapInArrow(count, "verdict string, key long, n long")
    return found.groupBy("verdict", "key").agg(F.sum("n").alias("n"))


def _estimates(keys: DataFrame, ratio: Ratio) -> DataFrame:
    """(key, accepted, rejected): the probabilities that the two models give each key, a context with its next byte."""
    shared = C.Shared(keys.sparkSession, replace(ratio, longer=None))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().astype(np.uint64)
            both = [pa.array(m.probabilities(key)) for m in (shared.value.accepted, shared.value.rejected)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *both], names=["key", "accepted", "rejected"])

    out = keys.mapInArrow(begin, "key long, accepted double, rejected double")
    for k in range(ratio.accepted.order + 1, ratio.order + 1):
        own = F.lit((1 << 8 * (k + 1)) - 1)
        entries = ratio.longer.groupBy(F.col("key").bitwiseAND(own).alias("entry")).agg(
            *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(f"{m}_c") for m, v in MODELS.items()]
        )
        contexts = entries.groupBy(F.shiftright("entry", 8).alias("context")).agg(
            *[F.sum(f"{m}_c").alias(f"{m}_n") for m in MODELS], *[F.count_if(F.col(f"{m}_c") > 0).alias(f"{m}_q") for m in MODELS]
        )
        out = out.withColumn("entry", F.col("key").bitwiseAND(own)).withColumn("context", F.shiftright("entry", 8))
        out = out.join(entries, "entry", "left").join(contexts, "context", "left")
        estimates = []
        for m in MODELS:
            shorter, (c, n, q) = F.col(m), (F.col(f"{m}_{x}") for x in "cnq")
            here = (F.coalesce(c, F.lit(0)) + q * shorter) / (n + q)
            estimates.append(F.when(n > 0, here).otherwise(shorter).alias(m))
        out = out.select("key", *estimates)
    return out


def _placed_by_chunks(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """As ``placed``, with models that do not fit a task: a chunk of URLs asks for its distinct contexts and gets those."""
    order, names = ratio.order, rows.columns
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    rows = stored(rows.withColumn("_chunk", chunk), "url-chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            for n in pc.unique(batch.column("_chunk")):
                key = np.unique(_contexts(batch.column("url").filter(pc.equal(batch.column("_chunk"), n)), order)[0][-1])
                yield pa.RecordBatch.from_pydict({"_chunk": pa.repeat(n, len(key)), "key": key.astype(np.int64)})

    asked = stored(rows.select("_chunk", "url").mapInArrow(ask, "_chunk long, key long").distinct(), "url-asked")
    answers = asked.join(_estimates(asked.select("key").distinct(), ratio), "key")

    def answer(urls: pa.Table, found: pa.Table) -> pa.Table:
        keys = found.column("key").to_numpy()
        by_key = np.argsort(keys)
        keys = keys[by_key]
        logs = [np.log(found.column(m).to_numpy()[by_key]) for m in MODELS]
        out = []
        for piece in C.pieces(urls.select(names).combine_chunks().to_batches()):
            key, url, size = _contexts(piece.column("url"), order)
            at = np.searchsorted(keys, key[-1].astype(np.int64))
            accepted, rejected = (np.bincount(url, log[at], minlength=len(size)) for log in logs)
            out.append(piece.append_column("at", pa.array((accepted - rejected) / size)))
        return pa.Table.from_batches(out)

    schema = T.StructType([*(f for f in rows.schema.fields if f.name in names), T.StructField("at", T.DoubleType())])
    return rows.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(answer, schema)


def placed(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """Add ``at``, the difference of the two models for the column ``url``."""
    if ratio.longer is not None:
        return _placed_by_chunks(rows, ratio)
    shared = C.Shared(rows.sparkSession, ratio)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            yield batch.append_column("at", pa.array(shared.value.differences(batch.column("url"))))

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("at", T.DoubleType())]))


def _best_cuts(found: DataFrame) -> tuple[float, float]:
    """As in ``_threshold``, for more differences than the driver takes: running sums over ranges, and single numbers."""
    totals = found.agg(*[F.sum(v).alias(v) for v in (ALLOW, BLOCK)], F.min("at").alias("first")).first()
    ranges = {"_range": F.floor(F.col("at") * STEPS)}
    for v in (ALLOW, BLOCK):
        found = running_total(found, [], ranges, ["at"], F.col(v), f"{v}_below")
    good = (1 - F.col(f"{ALLOW}_below") / totals[ALLOW] + F.col(f"{BLOCK}_below") / totals[BLOCK]).alias("good")
    found = stored(found.select("at", good), "url-cuts")
    # Where nothing lies below the cut, it is 1.
    least = max(1.0, found.agg(F.max("good")).first()[0]) - 1e-12
    low, high = found.filter(F.col("good") >= least).agg(F.min("at"), F.max("at")).first()

    def after(at: float) -> float:
        following = found.filter(F.col("at") > at).agg(F.min("at")).first()[0]
        return at + 1e-9 if following is None else (at + following) / 2

    first = totals["first"] - 1e-9
    return first if low is None or least <= 1 else after(low), first if high is None else after(high)


def _threshold(ratio: Ratio, known: DataFrame) -> float:
    """The difference with the best balanced accuracy on URLs of both verdicts; among equal ones, in the middle."""
    found = placed(known.select("url", "verdict"), ratio).groupBy("at")
    found = stored(found.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (ALLOW, BLOCK)]), "url-differences")
    if found.count() > MOST_ENTRIES:
        low, high = _best_cuts(found)
        return (low + high) / 2
    table = found.toArrow().sort_by("at")
    at = table.column("at").to_numpy()
    below = [np.concatenate([[0], np.cumsum(table.column(v).to_numpy())]) for v in (ALLOW, BLOCK)]
    cuts = np.concatenate([at[:1] - 1e-9, (at[1:] + at[:-1]) / 2, at[-1:] + 1e-9])
    good = 1 - below[0] / below[0][-1] + below[1] / below[1][-1]
    best = cuts[good >= good.max() - 1e-12]
    return float((best[0] + best[-1]) / 2)


def fit(urls: DataFrame, url_col: str, verdict_col: str, order: int = ORDER) -> Ratio:
    """Train on all URLs with a verdict but every fifth in the order of a hash, which sets the threshold.

    Tasks count contexts and differences; the driver gets the counts of distinct ones. With more than ``MOST_ENTRIES``
    contexts it gets those of contexts shorter by a byte, or more, and the long ones stay a table, ``longer``: every URL
    and every context counts in any case. A verdict with fewer than ``APART`` URLs uses all of them for both.
    """
    known = urls.select(F.col(url_col).alias("url"), F.col(verdict_col).alias("verdict")).filter("url IS NOT NULL")
    # A URL counts once, however many pages share it.
    known = known.filter(F.col("verdict").isin(ALLOW, BLOCK)).distinct()
    known = ranked(known.withColumn("_draw", F.xxhash64("url", F.lit(SEED))), "verdict", ["_draw", "url"], "judged-urls")
    apart, few = F.col("position") % APART == 0, F.col("members") < APART
    longest = counts = stored(counted(known.filter(~apart | few), order), "url-contexts")
    in_tasks = order
    while in_tasks > 1 and counts.count() > MOST_ENTRIES:
        shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * in_tasks) - 1)).alias("key")
        in_tasks -= 1
        counts = stored(counts.groupBy("verdict", shorter).agg(F.sum("n").alias("n")), "url-contexts")
    table = counts.toArrow()
    models = []
    for verdict in (ALLOW, BLOCK):
        own = table.filter(pc.equal(table.column("verdict"), verdict))
        keys, n = own.column("key").to_numpy().astype(np.uint64), own.column("n").to_numpy()
        models.append(Markov.of_counts(keys, n, in_tasks) if len(keys) else None)
    ratio = Ratio(*models, order=order)
    if all(models):
        ratio.longer = longest if in_tasks < order else None
        ratio.threshold = _threshold(ratio, known.filter(apart | few))
    return ratio


def judged(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row.

    ``rule`` is the longest rule that fits the URL (see ``Rule``), else null, and then the verdict comes from the
    models: character models of the URLs that rules allow and block, and the difference of their log-likelihoods per
    symbol (``score``, less the calibrated threshold): allow from 0 on. A null URL counts as an empty text; its host and
    path, and those of a text without ://, are empty. Repeated rows are judged alike; an empty table gives an empty
    result. Only the named columns are read. URLs are judged where they are read, without a shuffle, as long as the models
    go to every task (see ``MOST_ENTRIES``).
    """
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    split = split.withColumns({"rule": rule, "by_rule": verdict})
    ratio = fit(split, "url", "by_rule", order)
    score = F.col("at") - F.lit(ratio.threshold)
    verdict = F.coalesce("by_rule", F.when(score >= 0, ALLOW).otherwise(BLOCK))
    out = placed(split, ratio).select("id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
    return out.toDF(id_col, "host", "path", "rule", "verdict", "score")
