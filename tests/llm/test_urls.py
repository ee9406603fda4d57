"""URL filter: hosts, paths, rules, and the models against counts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from govlens.llm import queries, urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def rule_of(host, path):
    fits = [
        r
        for r in queries.URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.text), default=None)


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/EN/x", "http://www.example.com/en/1?x=/y#z", "http://com/",
    "http://com", "x://a.com?b/c", "http://example.com/en", "http://b.example.com/en/", "ftp://ÄB.net/fr/é", "a://b://c/d",
    "http://notexample.com/en/2", "http://x.net/es/#", "http://x.net/de/\nmore", "//y.com/", "http://" + "a." * 5000 + "org/",
]


def test_rules_hosts_and_paths(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = [(i, u, "rule") for i, u in enumerate([*ODD, *ODD[:3]], 10_000)]
    more = spark.createDataFrame([*rows, (None, ODD[4], None)], "page_id long, url string, host string")
    out = urls.judged(pages.unionByName(more.select("page_id", "url")), queries.URL_RULES).collect()
    url = {r.page_id: r.url for r in [*pages.collect(), *more.collect()]}
    assert len(out) == len(url) and {r.verdict for r in out} == {"allow", "block"}
    for r in out:
        host, path = split(url[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == (rule.verdict if rule else "allow" if r.score >= 0 else "block")
    assert [r.host for r in urls.judged(more, queries.URL_RULES).filter("page_id is null").collect()] == ["www.example.com"]
    assert urls.judged(more.limit(0), queries.URL_RULES).collect() == []


def test_model_equals_counts():
    known, order = ["http://a.com/x", "http://b.com/xy", "", "http://a.com/x"], 3
    model = urls.Markov(pa.array(known), order)
    counts = [Counter(), Counter()]

    def symbols(url):
        data = [urls.START] * order + list(url.lower().encode()) + [urls.END]
        return [(tuple(data[i - order : i]), data[i]) for i in range(order, len(data))]

    for url in known:
        for context, s in symbols(url):
            for k in range(order + 1):
                counts[0][context[order - k :], s] += 1
                counts[1][context[order - k :]] += 1
    kinds = Counter(context for context, _ in counts[0])

    def log(url):
        out = 0.0
        for context, s in symbols(url):
            p = 1 / 256
            for k in range(order + 1):
                c = context[order - k :]
                if counts[1][c]:
                    p = (counts[0][c, s] + kinds[c] * p) / (counts[1][c] + kinds[c])
            out += math.log(p)
        return out

    asked = ["HTTP://a.com/x", "http://c.org/é", "", "x"]
    assert model.log_likelihoods(pa.array(asked)) == pytest.approx([log(u) for u in asked])
    assert model.log_likelihoods(pa.array([None], pa.string())) == pytest.approx([log("")])


def test_the_ratio_separates_what_rules_do(spark):
    good = [(f"http://site{i}.org/news/{i}", "allow") for i in range(300)]
    bad = [(f"http://win-{i}.casino.org/bet{i}", "block") for i in range(100)]
    ratio = urls.fit(spark.createDataFrame([*good, *bad], "url string, verdict string"), "url", "verdict")
    score = ratio.differences(pa.array(["http://site777.org/news/5", "http://win-777.casino.org/bet9"])) - ratio.threshold
    assert score[0] > 0 > score[1]
    only = spark.createDataFrame(good, "url string, verdict string")
    assert np.all(urls.fit(only, "url", "verdict").differences(pa.array(["x", None])) > 0)
    flipped = only.selectExpr("url", "'block' AS verdict")
    assert np.all(urls.fit(flipped, "url", "verdict").differences(pa.array(["x", None])) < 0)
    assert np.all(urls.fit(only.limit(0), "url", "verdict").differences(pa.array(["x", None])) > 0)


def test_every_url_counts(spark, monkeypatch):
    """More URLs than any sample: all but those set apart are counted, also with shortened contexts."""
    rows = spark.range(50_000).selectExpr(
        "concat('http://site', id % 25000, '.org/', id % 7) AS url", "if(id % 25000 < 24000, 'allow', 'block') AS verdict"
    )
    distinct = Counter(r.verdict for r in rows.distinct().collect())

    def learned(ratio, model):
        entry, count, *_ = getattr(ratio, model).tables[0]
        return count[entry == urls.END].sum()

    whole = urls.fit(rows, "url", "verdict")
    for model, verdict in (("accepted", "allow"), ("rejected", "block")):
        assert learned(whole, model) == distinct[verdict] - -(-distinct[verdict] // urls.APART)
    assert whole.accepted.order == urls.ORDER
    monkeypatch.setattr(urls, "MOST_ENTRIES", 1_000)
    short = urls.fit(rows, "url", "verdict")
    assert 0 < short.accepted.order < urls.ORDER and learned(short, "accepted") == learned(whole, "accepted")
    exact = urls._threshold(short, rows.distinct())
    monkeypatch.setattr(urls, "MOST_ENTRIES", 10)
    assert urls._threshold(short, rows.distinct()) == pytest.approx(exact, abs=2 / urls.STEPS)
    for got, same in zip(short.accepted.tables, whole.accepted.tables, strict=False):
        assert all(np.array_equal(a, b) for a, b in zip(got, same, strict=True))


def test_models_too_large_for_a_task_judge_alike(spark, sf_dir, monkeypatch):
    """Contexts that tasks cannot hold are joined, not shortened, and the threshold is that of all differences."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    more = [(i, u) for i, u in enumerate([*ODD, *ODD], 10_000)] + [(None, ODD[4]), (None, None)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))

    def judged():
        rows = urls.judged(pages, queries.URL_RULES).collect()
        return sorted(((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict), r.score) for r in rows)

    whole = judged()
    monkeypatch.setattr(urls, "MOST_ENTRIES", 20)
    monkeypatch.setattr(urls, "CHUNK_BITS", 5)
    for same, got in zip(whole, judged(), strict=True):
        assert got[0] == same[0] and got[1] == pytest.approx(same[1], abs=1e-12)


@pytest.mark.parametrize("kind", ["mixed", "apart", "swapped", "equal"])
def test_best_cuts_of_many_differences(spark, monkeypatch, kind):
    """Also where the best cut is below or above all of them."""
    draw = np.random.default_rng(3)
    allow = {"mixed": 0.2, "apart": 5.0, "swapped": -5.0, "equal": 0.0}[kind]
    known = [(float(x), "allow") for x in draw.normal(allow, 1, 300).round(2)] + [(float(x), "block") for x in draw.normal(0, 1, 90).round(2)]
    rows = spark.createDataFrame([(str(x), v) for x, v in known] if kind != "equal" else [("1", v) for _, v in known], "url string, verdict string")
    monkeypatch.setattr(urls, "placed", lambda df, ratio: df.withColumn("at", df["url"].cast("double")))
    exact = urls._threshold(None, rows)
    monkeypatch.setattr(urls, "MOST_ENTRIES", 0)
    assert urls._threshold(None, rows) == pytest.approx(exact, abs=1e-12)


def test_threshold_separates_with_few_urls(spark):
    rows = [("http://a.org/1", "allow"), ("http://b.casino.org/x", "block"), ("http://b.casino.org/y", "block"), ("no", None)]
    ratio = urls.fit(spark.createDataFrame(rows, "url string, verdict string"), "url", "verdict")
    score = ratio.differences(pa.array([u for u, _ in rows[:3]])) - ratio.threshold
    assert score[0] > 0 > score[1] and score[2] < 0
