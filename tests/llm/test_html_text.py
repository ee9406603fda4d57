"""HTML extraction: blocks, the field against all label sequences, and pages of other sites."""

from __future__ import annotations

import html
import itertools
import math
import random
import re

import pytest

from govlens.llm import html_text as H


def texts(page):
    return [b.text for b in H.blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<i>d</i> e<p>f<br>g") == ["a bcd e", "f g"]
    assert texts("x &amp;&lt;b&gt; &eacute;&#233;&nbsp; \n y") == ["x &<b> éé y"]
    assert texts('<script>var t="</p>";</script>a<style>p{}</style><!-- <p>no</p> -->b') == ["ab"]
    assert texts("<script>never closed <p>x") == []
    assert texts("a < b <p title='x>y'>c</p> d") == ["a < b", "c", "d"]
    assert texts("<title>no</title><textarea>no</textarea><p>yes") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("") == texts(None) == texts("<p></p> <div>\n</div>") == []
    assert texts("<a href=x" * 2000) == []


def test_hidden_elements_end():
    assert texts("<article><p>a<svg class='i'/>b</p><p>c</p></article><svg><text>no</text></svg><p>d") == ["ab", "c", "d"]
    assert texts('<p>a<math/>b<svg href="x=y" />c') == ["abc"]
    assert texts("<div>a<svg class=i/><path d=x></div><p>b</p><svg>no</svg>") == ["a", "b"]
    assert texts("<div>a<svg><p>b</p></div>c") == ["a", "b", "c"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject><svg>no</svg>no</svg>a") == ["a"]
    for tag in ("noscript", "object", "select", "template"):
        assert texts(f"<div>a<{tag}>no<div>no</div>no</div><p>b</p><{tag}><p>no</p></{tag}>c") == ["a", "b", "c"]
        assert texts(f"<div>a<{tag}>no<script>'</{tag}></div>'</script>no</{tag}>b</div>") == ["ab"]
    assert len(texts("<div>a<svg><g>" * 20_000 + "</x>" * 20_000)) == 20_000


def test_sampled_blocks_keep_the_features_of_the_page():
    page = "<article>" + "<p>" + "many words " * 60 + "<a href=x>end.</a></p>" + "<p>b.</p>" * 200 + "</article>"
    few = H.sampled(page)
    assert len(few) == H.BLOCKS_PER_PAGE and max(len(b["text"]) for b in few) == H.CHARS_PER_BLOCK
    assert [b["features"] for b in few] == H.features(H.blocks_of(page))[: len(few)]
    assert "stop:True" in few[0]["features"] and "to:3" in few[-1]["features"] and few[-1]["label"] == 1


def test_paths():
    blocks = H.blocks_of('<div id="main-Content"><p><b>a<br><p>b</div><nav class=topMenu><a href=x>c</a></nav>')
    assert [("t:div" in b.path, "c:content" in b.path, "c:menu" in b.path) for b in blocks] == [
        (True, True, False),
        (True, True, False),
        (False, False, True),
    ]
    assert [b.linked for b in blocks] == [0, 0, 1]


def test_decoding_and_marginals_equal_all_sequences():
    rng = random.Random(3)
    for n in range(1, 6):
        chain = H.Field({f"f{i}": rng.gauss(0, 1) for i in range(n)}, [[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"])
        feats = [[f"f{i}", "unknown"] for i in range(n)]
        scores = chain.scores(feats)

        def total(ys, scores=scores, chain=chain):
            moves = sum(chain.moves[a][b] for a, b in itertools.pairwise(ys))
            return sum(s * y for s, y in zip(scores, ys, strict=True)) + moves

        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(chain.decoded(feats)) == max(every, key=total)
        weight = {ys: math.exp(total(ys)) for ys in every}
        one, pairs = chain.marginals(scores)
        for i in range(n):
            assert one[i] == pytest.approx(sum(w for ys, w in weight.items() if ys[i]) / sum(weight.values()))
        for i, p in enumerate(pairs):
            both = sum(w for ys, w in weight.items() if ys[i : i + 2] == (1, 0)) / sum(weight.values())
            assert p[1][0] == pytest.approx(both)
    assert chain.decoded([]) == []


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def chain(pages):
    return H.fit(pages)


def test_whole_articles(pages, chain):
    for r in H.extracted(pages, chain, carry=["page_id", "url", "html"]).collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", inside)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


PARAGRAPHS = ["The first paragraph tells a long story about a river.", "Short one.", "A third, with & signs and “quotes”."]


@pytest.mark.parametrize("body", ["article", 'div class="post-content"', 'div id="main"', "main", 'section class="story"'])
def test_pages_of_other_sites(chain, body):
    inside = "<h1>Heading of it</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in PARAGRAPHS)
    page = (
        '<html><head><title>t</title></head><body><div class="cookie-notice"><p>We use cookies. Accept them?</p></div>'
        "<header><p>The Daily Site</p></header><ul class='menu'><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
        f"<{body}>{inside}</{body.split()[0]}>"
        '<div class="comments"><p>I liked this a lot, well done. It was a long story about a river.</p></div>'
        '<div class="sidebar"><p>Other stories you may like.</p></div><form><label>Mail</label><button>Go</button></form>'
        "<footer>&copy; 2020 The Daily Site</footer></body></html>"
    )
    assert H.main_text(page, chain) == " ".join(["Heading of it", *PARAGRAPHS])


def test_held_out_layouts(chain):
    """Blocks of generated pages that training did not see."""
    rng, right, n = random.Random(99), 0, 0
    sentences = ["Several words make a sentence.", "It goes on, and on, for a while.", "Short.", "No end"]
    for _ in range(200):
        page, labels = H.Layout(sentences, rng).page()
        blocks = H.blocks_of(page)
        if len(blocks) == len(labels):
            got = chain.decoded(H.features(blocks))
            right += sum(a == b for a, b in zip(got, labels, strict=True))
            n += len(labels)
    assert n > 2000 and right / n >= 0.93


def test_odd_rows(spark, chain):
    long = "<article>" + "<p>many words in it.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "t"), (2, "", "u", "t"), (None, "<article><p>x y</p></article>", None, "t"), (4, long, "u", "t"), (4, long, "u", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    out = H.extracted(df, chain).collect()
    assert len(out) == 5
    by_id = {r.page_id: r for r in out}
    assert by_id[1].text == by_id[2].text == "" and by_id[1].n_chars == 0
    assert by_id[None].text == "x y" and by_id[4].n_chars == 20_000 * 18 - 1
    assert H.extracted(df.limit(0), chain).collect() == []
    assert H.main_text("<article><p>a b c</p></article>", H.fit(df.limit(0))) == "a b c"
