"""Toxicity, language identification: held-out accuracy, gradients and odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govlens.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_of_held_out_rows(spark):
    """On a size at which some hundred rows are held out; a share of the labels is wrong on purpose."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = queries.QUERIES["op10_toxicity"](spark, sf_dir)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    one, zero = ([r.score for r in rows if r.toxic == x] for x in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert len(rows) > 700 and right >= 0.93 and auc >= 0.92
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.04 * len(zero)


def tiny(spark):
    clean = [f"the {a} of {b} is a {c}" for a in ("house", "tree", "river") for b in ("wood", "stone") for c in ("fact", "joy")]
    bad = [f"{t} you gruesome {w}" for t in clean for w in ("blockhead", "blockheads")]
    rows = [(i, t, int(t in bad)) for i, t in enumerate([*clean * 4, *bad])]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_unseen_spellings_and_long_texts(spark):
    table = tiny(spark)
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    clean = "the tree of stone is a fact " * 400
    texts = ["you gruesome blockhead", "gruesom blockheadd", clean, clean + "you gruesome blockhead " + clean, "", None]
    a, b, c, d, e, f = model.scores(pa.array(texts))
    assert a > 0.5 and b > 0.5 and d > 0.5 and c < 0.5
    assert e == f == 0


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, 0), (8, 7), (5, None), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.scored(odd, model, carry=odd.columns[:1] + ["_chunk"]).collect()
    assert len(out) == odd.count()
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 for r in out if r.doc_id in (1, 2, 3))
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        none = toxicity.fit(odd, some)
        assert all(r.score < 0.5 for r in toxicity.scored(odd, none).collect())
    assert toxicity.scored(odd.limit(0), model).collect() == []
    kept = toxicity.scored(odd, toxicity.Model(model.weights, 1.0, 500.0), carry=["doc_id"], least=0.5)
    assert {r.doc_id for r in kept.collect()} <= {1, 2, 3, None}


def test_language_of_held_out_rows(spark, more):
    out = queries.QUERIES["op9_language_id"](spark, SF).join(more.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_gradients_of_the_network():
    """Backpropagation through time against differences of the loss."""
    network = language.Network.start(["x", "y", "z"])
    for p in network.parameters():
        p *= 0.7
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 4)).astype(np.intp)
    inside = (np.arange(7)[:, None] < np.array([7, 5, 7, 2])).astype(np.float32)[:, :, None]
    label = np.array([0, 1, 2, 1])
    places = [(0, (int(x[1, 0]), 3)), (1, (int(x[2, 1]), 2)), (2, (1, 4)), (3, (0, 1)), (6, (2, 3)), (7, (3, 0)), (8, (5, 1)), (9, (2,))]

    def loss():
        p = network.labelled(x, inside)
        return -(np.log(p[:, np.arange(4), label]) * inside[:, :, 0]).sum() / inside.sum()

    before = [p.copy() for p in network.parameters()]
    network.step(x, inside, label, 0.0)
    grads = [m[0] / 0.1 for m in network.moments]
    size = np.sqrt(sum((g * g).sum() for g in grads))
    assert size < 1 - 1e-6  # else the gradient was cut
    for k, at in places:
        p = network.parameters()[k]
        p[...] = before[k]
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        down = loss()
        p[...] = before[k]
        assert grads[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_every_byte_is_read_once():
    """Windows do not depend on the other texts of a batch."""
    network = language.Network.start(["x", "y"])
    texts = ["abc" * 200, "", "é", "Q" * language.WINDOW_BYTES, None, "z" * (language.WINDOW_BYTES + 1)]
    together = network.pooled(pa.array(texts))
    for text, row in zip(texts, together, strict=True):
        assert network.pooled(pa.array([text], pa.string()))[0] == pytest.approx(row, abs=1e-5)
    assert together[0].sum() == pytest.approx(1, abs=1e-4) and together[1].sum() == 0


def test_language_odd_rows(spark, odd):
    network = language.fit(odd)
    out = language.identified(odd, network, carry=["doc_id", "text"]).collect()
    assert len(out) == odd.count()
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in ("en", "de", "fr") and 0 < r.score <= 1
    assert language.fit(odd, training=F.lit(False)) is None
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}
    assert language.identified(odd.limit(0), network).collect() == []


@pytest.mark.parametrize("gap, scale", [(12.0, 1.0), (300.0, 40.0), (2.0, 1.0)])
def test_calibration_finds_the_border(gap, scale):
    """Also for odds far from what a step of Newton's method can take."""
    rng = np.random.default_rng(0)
    labels = np.repeat([0, 1], [360, 40])
    best = rng.normal(0, 1, 400) * scale + gap * labels
    slope, bias = toxicity._calibrated(best, labels, np.ones(400), 0.0)
    wrong = (slope * best + bias >= 0) != labels
    assert slope > 0 and wrong.mean() <= (0.12 if gap < 5 else 0.005)
