"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm import chunks as C

# The training sample: pages of the table, blocks of each page and characters of each block; and pages that are laid
# out anew from their sentences.
PAGES = 300
BLOCKS_PER_PAGE = 120
CHARS_PER_BLOCK = 400
LAID_OUT = 1_500
EPOCHS = 6
SEED = 17

# HTML element kinds (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title svg math object select".split())
# Those of RAW that hold elements rather than text alone, those written in XML, and what in the latter holds HTML.
NESTING = frozenset("template noscript svg math object select".split())
FOREIGN = frozenset("svg math".split())
HTML_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p"
    " pre search section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the key closes an open element of the value that no element of the third kind separates from it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_STAYS = frozenset("button label legend option summary caption td th tr tbody thead tfoot dd dt li body head html".split())

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names(attributes: str) -> tuple[str, ...]:
    """Parts of class, id, role and itemprop: an element's features beside its tag."""
    found = []
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for part in NAME_PART.findall(a or b or c):
            part = part.lower()
            found += [f"c:{part}", f"c3:{part[:3]}", f"c4:{part[:4]}"]
    return tuple(dict.fromkeys(found))


@dataclass
class Block:
    """A leaf block: its text, the tags and names of its ancestors, its own tag, and characters inside links."""

    text: str
    path: tuple[str, ...]
    tag: str
    linked: int = 0


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash of its own; one behind an unquoted value belongs to the value."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def _end_of_text(page: str, at: int, tag: str) -> int:
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def _end_of_hidden(page: str, at: int, tag: str, parents: set[str]) -> int:
    """Where an element of NESTING that opens before ``at`` ends: at its closing tag, or where a parent closes before
    that. An HTML block in svg or math ends these, as in browsers."""
    inner: list[str] = []
    count: Counter[str] = Counter()
    foreign = int(tag in FOREIGN)
    while match := TOKEN.search(page, at):
        at = match.end()
        closing, name, attributes = match.group(1, 2, 3)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if count[name]:
                while True:
                    last = inner.pop()
                    count[last] -= 1
                    foreign -= last in FOREIGN
                    if last == name:
                        break
            elif name == tag or name in parents:
                return match.start()
            continue
        if tag in FOREIGN and name in BLOCK and not any(count[x] for x in HTML_IN_FOREIGN):
            return match.start()
        if name in VOID or (foreign and _closes_itself(attributes)):
            continue
        if name in RAW and name not in NESTING and not foreign:
            at = _end_of_text(page, at, name)
            continue
        inner.append(name)
        count[name] += 1
        foreign += name in FOREIGN
    return len(page)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Elements that are never shown (scripts, styles, ...) have none.

    An svg or math tag that closes itself is empty. A hidden element that is never closed ends with its parent; one that
    holds only text (script, style, iframe, textarea, title) goes on to the end of the page, as in browsers.
    """
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    out: list[Block] = []
    parts: list[str] = []
    linked, links, owner = 0, 0, stack[0]

    def add(text: str) -> None:
        nonlocal linked, owner
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if not parts or not any(map(str.strip, parts)):
            owner = stack[-1]
        parts.append(text)
        if links:
            linked += len(text.strip())

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, owner[1], owner[0], linked))
            parts.clear()
        linked = 0

    at = 0
    while match := TOKEN.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match.group(1, 2, 3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if tag in FOREIGN and _closes_itself(attributes):
                continue
            if tag in NESTING:
                at = _end_of_hidden(page, at, tag, {e[0] for e in stack if e[0] in BLOCK})
            else:
                at = _end_of_text(page, at, tag)
            continue
        if tag in RAW:
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            end()
        if tag in VOID:
            continue
        if closing:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if place and tag in BLOCK:
                links -= sum(e[0] == "a" for e in stack[place:])
                del stack[place:]
            elif place:
                links -= tag == "a"
                del stack[place]
            continue
        if tag in IMPLIED:
            closed, border = IMPLIED[tag]
        else:
            closed, border = ({"p"}, P_STAYS) if tag in BLOCK and tag not in P_STAYS else ((), ())
        if closed:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in closed:
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    if tag != "tr":
                        break
                elif tag not in IMPLIED and stack[i][0] in BLOCK:
                    break
        names = _names(attributes) if "=" in attributes else ()
        path = stack[-1][1]
        stack.append((tag, tuple(dict.fromkeys((*path, f"t:{tag}", *names)))))
        links += tag == "a"
    add(page[at:])
    end()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block: ancestors' tags and names, and what the text looks like."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        text = b.text
        size, words = len(text), text.count(" ") + 1
        own = [
            "bias",
            f"own:{b.tag}",
            f"size:{min(9, size.bit_length())}",
            f"words:{min(6, words.bit_length())}",
            f"linked:{min(4, 4 * b.linked // max(1, size))}",
            f"from:{min(3, i)}",
            f"to:{min(3, n - 1 - i)}",
            f"stop:{text[-1] in '.!?…'}",
        ]
        if "©" in text or "copyright" in text.lower():
            own.append("rights")
        if words <= 6:
            own.append(f"short:{sum(w[:1].isupper() for w in text.split())}")
        out.append([*own, *b.path])
    return out


@dataclass
class Field:
    """A linear chain over two labels: 1 (main text) and 0. Weights count for label 1; moves are by (from, to)."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, feats: list[list[str]]) -> list[float]:
        weight = self.weights.get
        return [sum(weight(f, 0.0) for f in fs) for fs in feats]

    def decoded(self, feats: list[list[str]]) -> list[int]:
        """The best labels of all blocks together (Viterbi); among equals the one with 0 first from the end."""
        back: list[tuple[int, int]] = []
        zero = one = None
        (m00, m01), (m10, m11) = self.moves
        for s in self.scores(feats):
            if zero is None:
                zero, one = 0.0, s
                continue
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + s
        if zero is None:
            return []
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[list[float]]]]:
        """Probability of label 1 per block, and of each pair of labels per step (forward-backward)."""
        n, move = len(scores), [[math.exp(x) for x in row] for row in self.moves]
        local = [(1.0, math.exp(max(-30.0, min(30.0, s)))) for s in scores]
        ahead = []
        a = [1.0, 1.0]
        for i in range(n):
            a = [
                local[i][y] * (1.0 if i == 0 else ahead[-1][0] * move[0][y] + ahead[-1][1] * move[1][y]) for y in (0, 1)
            ]
            total = a[0] + a[1]
            a = [a[0] / total, a[1] / total]
            ahead.append(a)
        behind = [[1.0, 1.0]]
        for i in range(n - 1, 0, -1):
            b = [sum(move[x][y] * local[i][y] * behind[-1][y] for y in (0, 1)) for x in (0, 1)]
            total = b[0] + b[1]
            behind.append([b[0] / total, b[1] / total])
        behind.reverse()
        one = []
        for a, b in zip(ahead, behind, strict=True):
            one.append(a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]))
        pairs = []
        for i in range(1, n):
            p = [[ahead[i - 1][x] * move[x][y] * local[i][y] * behind[i][y] for y in (0, 1)] for x in (0, 1)]
            total = sum(map(sum, p))
            pairs.append([[v / total for v in row] for row in p])
        return one, pairs

    def train(self, pages: list[tuple[list[list[str]], list[int]]]) -> None:
        """Maximise the conditional likelihood of the labels: AdaGrad, a page at a time, with a little decay."""
        rng, squares = random.Random(SEED), {}
        move_squares = [[1e-2, 1e-2], [1e-2, 1e-2]]
        for _ in range(EPOCHS):
            rng.shuffle(pages)
            for feats, labels in pages:
                one, pairs = self.marginals(self.scores(feats))
                step: dict[str, float] = {}
                for fs, p, y in zip(feats, one, labels, strict=True):
                    for f in fs:
                        step[f] = step.get(f, 0.0) + y - p
                for f, g in step.items():
                    g -= 1e-3 * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-2) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + 0.3 * g / math.sqrt(squares[f])
                for i, p in enumerate(pairs):
                    for x in (0, 1):
                        for y in (0, 1):
                            g = ((labels[i], labels[i + 1]) == (x, y)) - p[x][y]
                            move_squares[x][y] += g * g
                            self.moves[x][y] += 0.1 * g / math.sqrt(move_squares[x][y])


# What label an ancestor gives a block of a page whose mark-up says what it is; of several the innermost counts, and of
# one element's names the first listed here.
OUTSIDE = frozenset(
    "t:nav t:header t:footer t:aside t:form t:menu t:button t:dialog c:ad c:ads c:advert c:sidebar c:comments c:cookie"
    " c:notice c:menu c:nav c:footer c:header".split()
)
INSIDE = frozenset("t:article t:main".split())


def marked(blocks: list[Block]) -> list[int] | None:
    """Labels from a page's own mark-up; None if no element says that it holds the main text."""
    if not any(INSIDE & set(b.path) for b in blocks):
        return None
    labels = []
    for b in blocks:
        label = 0
        for name in b.path:
            label = 1 if name in INSIDE else 0 if name in OUTSIDE else label
        labels.append(label)
    return labels


# Layouts of training pages: (opening, closing) tags around main text, and around what is not.
BODIES = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ('<div class="post">', "</div>"),
    ('<div class="article">', "</div>"),
    ('<div class="story-body">', "</div>"),
    ('<div id="main">', "</div>"),
    ('<div id="article-content">', "</div>"),
    ('<main id="main"><article class="post">', "</article></main>"),
    ('<div class="content">', "</div>"),
    ('<div id="content"><div class="inner">', "</div></div>"),
    ('<div id="main-content">', "</div>"),
    ('<div class="post-body entry-content">', "</div>"),
    ('<div class="article-text" itemprop="articleBody">', "</div>"),
    ('<section class="story">', "</section>"),
    ('<div role="main"><section>', "</section></div>"),
    ('<div class="page"><div class="text">', "</div></div>"),
    ("<div>", "</div>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ("", ""),
)
MENUS = (
    ("<nav>", "</nav>"),
    ('<div class="menu">', "</div>"),
    ('<ul class="navigation">', "</ul>"),
    ('<div id="navbar">', "</div>"),
    ('<div class="breadcrumbs">', "</div>"),
    ('<div class="tags links">', "</div>"),
    ('<div class="related">', "</div>"),
    ('<div class="share social">', "</div>"),
    ('<div class="pagination">', "</div>"),
    ('<div role="navigation">', "</div>"),
)
HEADS = (
    ("<header>", "</header>"),
    ('<div class="header">', "</div>"),
    ('<div id="masthead">', "</div>"),
    ('<div class="top-bar site-title">', "</div>"),
    ('<div role="banner">', "</div>"),
)
FEET = (
    ("<footer>", "</footer>"),
    ('<div class="footer">', "</div>"),
    ('<div id="page-footer">', "</div>"),
    ('<div class="copyright legal">', "</div>"),
    ('<div role="contentinfo">', "</div>"),
)
SIDES = (
    ("<aside>", "</aside>"),
    ('<div class="sidebar">', "</div>"),
    ('<div id="side-bar-right">', "</div>"),
    ('<div class="widget">', "</div>"),
    ('<div class="teaser">', "</div>"),
)
ADVERTS = (
    ('<div class="ad">', "</div>"),
    ('<div class="ads">', "</div>"),
    ('<div class="advert banner">', "</div>"),
    ('<div class="advertisement">', "</div>"),
    ('<div class="adsense">', "</div>"),
    ('<ins class="adsbygoogle">', "</ins>"),
    ('<div class="sponsored">', "</div>"),
    ('<div id="promo">', "</div>"),
    ('<section class="promotion">', "</section>"),
    ('<div class="ad-slot">', "</div>"),
)
NOTICES = (
    ('<div class="cookie-notice">', "</div>"),
    ('<div id="cookies" class="consent">', "</div>"),
    ('<div class="notice">', "</div>"),
    ('<div class="alert">', "</div>"),
    ('<div role="alert" class="message">', "</div>"),
    ('<div class="popup modal">', "</div>"),
    ('<div class="paywall">', "</div>"),
    ('<div class="disclaimer">', "</div>"),
    ("<dialog>", "</dialog>"),
)
FORMS = (
    ("<form>", "</form>"),
    ('<form class="search">', "</form>"),
    ('<div class="newsletter signup"><form>', "</form></div>"),
    ('<div class="subscribe">', "</div>"),
    ('<div id="login-form">', "</div>"),
)
COMMENTS = (
    ('<section class="comments">', "</section>"),
    ('<div id="comments">', "</div>"),
    ('<div class="comment-list">', "</div>"),
    ('<ol class="commentlist">', "</ol>"),
    ('<div class="comment">', "</div>"),
    ('<div id="disqus_thread" class="discussion">', "</div>"),
    ('<div class="responses replies">', "</div>"),
    ('<div class="user-reviews">', "</div>"),
)


class Layout:
    """Training pages: sentences of real pages in other mark-up, and the label of each block."""

    def __init__(self, sentences: list[str], rng: random.Random):
        self.sentences, self.rng = sentences, rng
        self.html: list[str] = []
        self.labels: list[int] = []

    def text(self, least: int, most: int) -> str:
        words = " ".join(self.rng.choice(self.sentences) for _ in range(3)).split()
        return " ".join(words[: self.rng.randint(least, most)]) or "x"

    def put(self, tag: str, text: str, label: int, linked: bool = False) -> None:
        text = html.escape(text, quote=False)
        text = f'<a href="/x">{text}</a>' if linked else text
        self.html.append(f"<{tag}>{text}</{tag}>" if tag else text)
        self.labels.append(label)

    def outside(self, kinds: tuple, shape: str) -> None:
        start, stop = self.rng.choice(kinds)
        self.html.append(start)
        rng = self.rng
        if shape == "links":
            self.html.append("<ul>" if not start.startswith("<ul") else "")
            for _ in range(rng.randint(1, 7)):
                self.put("li", self.text(1, 3), 0, True)
            self.html.append("</ul>" if not start.startswith("<ul") else "")
        elif shape == "line":
            self.put(rng.choice(("", "p", "div", "span")), self.text(2, 25), 0)
        elif shape == "comments":
            for _ in range(rng.randint(1, 4)):
                self.put(rng.choice(("p", "div", "li")), self.text(3, 60), 0)
        else:
            self.put(rng.choice(("label", "p", "button")), self.text(1, 8), 0)
            if rng.random() < 0.5:
                self.put("button", self.text(1, 2), 0)
        self.html.append(stop)

    def body(self) -> None:
        rng = self.rng
        start, stop = rng.choice(BODIES)
        self.html.append(start)
        if rng.random() < 0.8:
            self.put("h1", self.text(2, 12), 1)
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.75:
                self.put("p", self.text(1, 90), 1)
            elif kind < 0.82:
                self.put(rng.choice(("h2", "h3", "blockquote", "pre")), self.text(2, 20), 1)
            elif kind < 0.88:
                self.html.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.put("li", self.text(2, 20), 1)
                self.html.append("</ul>")
            elif kind < 0.93:
                self.outside(ADVERTS, "line")
            elif kind < 0.96:
                self.outside(MENUS, "links")
            else:
                self.outside(SIDES, "line")
        if rng.random() < 0.2:
            self.outside(COMMENTS, "comments")
        if rng.random() < 0.1:
            self.outside(FORMS, "form")
        self.html.append(stop)

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        if rng.random() < 0.03:  # no mark-up at all
            self.put("", self.text(3, 90), 1)
            return self.html[0], self.labels
        for kinds, shape, chance in (
            (NOTICES, "line", 0.3), (HEADS, "line", 0.5), (MENUS, "links", 0.7), (FORMS, "form", 0.3),
            (ADVERTS, "line", 0.4), (SIDES, "line", 0.2),
        ):
            if rng.random() < chance:
                self.outside(kinds, shape)
        self.body()
        for kinds, shape, chance in (
            (COMMENTS, "comments", 0.5), (SIDES, "links", 0.3), (ADVERTS, "line", 0.3), (MENUS, "links", 0.3),
            (FORMS, "form", 0.2), (NOTICES, "line", 0.3), (FEET, "line", 0.7),
        ):
            if rng.random() < chance:
                self.outside(kinds, shape)
        return "<html><body>" + "".join(self.html) + "</body></html>", self.labels


def sampled(page: str | None) -> list[dict]:
    """The first blocks of a page with shortened texts; features and labels are those of the whole page."""
    blocks = blocks_of(page)
    labels = marked(blocks) or [None] * len(blocks)
    few = zip(blocks[:BLOCKS_PER_PAGE], features(blocks), labels, strict=False)
    return [{"text": b.text[:CHARS_PER_BLOCK], "features": f, "label": y} for b, f, y in few]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Field:
    """Train on labelled pages: PAGES of the table, picked by hash, and LAID_OUT more.

    A page of the table that marks its main text (article, main) is labelled by its own mark-up. The others are laid out
    from the same sentences in the mark-up of other sites, where the label of every block is known; so the field also
    learns pages without such marks, and text inside the main element that is not main text.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL")
    ids = pages.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("draw"))
    few = C.thinned(ids, F.col("draw"), ids.count(), PAGES)
    picked = few.orderBy("draw", "id").limit(PAGES).select("id")
    chosen = rows.join(F.broadcast(picked), "id", "left_semi")  # at most PAGES ids

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.string())), ("label", pa.int32())]))
        for batch in C.pieces(batches):
            found = [sampled(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch({"blocks": pa.array(found, kind)})

    schema = "blocks array<struct<text:string,features:array<string>,label:int>>"
    found = chosen.select("html").mapInArrow(parse, schema).limit(PAGES).collect()
    real = sorted((r["blocks"] for r in found), key=lambda bs: [b["text"] for b in bs])
    known = [([b["features"] for b in bs], [b["label"] for b in bs]) for bs in real if bs and bs[0]["label"] is not None]
    sentences = sorted({s for bs in real for b in bs for s in re.findall(r"[^.!?]+[.!?]?", b["text"]) if s.strip()})
    rng = random.Random(SEED)
    for _ in range(LAID_OUT):
        page, labels = Layout(sentences or ["Text."], rng).page()
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            known.append((features(blocks), labels))
    out = Field()
    out.train([(f, y) for f, y in known if f])
    return out


def main_text(page: str | None, chain: Field) -> str:
    """The blocks that the field labels as main text, joined by one space."""
    blocks = blocks_of(page)
    labels = chain.decoded(features(blocks))
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extracted(
    pages: DataFrame, chain: Field, html_col: str = "html", carry: Iterable[str] = ("page_id", "url")
) -> DataFrame:
    """The carried columns with ``text``, the main text of the whole page, and ``n_chars``, its code points.

    A page is cut into leaf blocks: runs of text between block elements. Character references are decoded, white space
    in a block becomes one space, br counts as white space, other inline tags as nothing. The field labels all blocks of
    a page together; main text keeps the page's order. A null or empty page has the text ''. Pages are read where they
    lie, without a shuffle. Repeated rows give equal results; an empty table gives an empty result.
    """
    carry = list(carry)
    shared = C.Shared(pages.sparkSession, chain)
    rows = pages.select(F.col(html_col).cast("string").alias("_html"), *[F.col(c) for c in carry])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.pieces(batches):
            texts = [main_text(page, shared.value) for page in batch.column("_html").to_pylist()]
            arrays = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "text", "n_chars"])

    types = dict(pages.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], "text string", "n_chars long"])
    return rows.mapInArrow(extract, schema)
