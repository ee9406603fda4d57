"""Counts and verdicts equal plain loops over whole texts; lines above the limits go, others stay."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from govlens.llm import line_rules as L
from govlens.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def normal(line):
    lower = line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return " ".join(WORD.findall(re.sub("[0-9]+", "0", lower)))


def plain(rows, limits, min_words=50):
    """(id, counts, words removed, failed, kept) of rows (id, host, text)."""
    texts = {(host, text or "") for _, host, text in rows}
    hosts = Counter(host for host, _ in texts)
    lines = Counter((host, line) for host, text in texts for line in {normal(x) for x in text.split("\n")} if line)
    out = []
    for i, host, text in rows:
        c = counts(text)
        gone = 0
        for line in (text or "").split("\n"):
            n = lines.get((host, normal(line)), 0)
            if n > limits.min_documents and n > limits.share * hosts[host]:
                gone += len(WORD.findall(line))
        failed = c[0] < min_words or 100 * c[4] > 50 * c[0]
        out.append((i, *c, gone, failed, not failed and gone <= limits.removed_share * c[0]))
    return sorted(out, key=str)


def judged(df, **options):
    return sorted((tuple(r) for r in L.judged(df, **options).drop("removed").collect()), key=str)


def texts(seed, n):
    draw = random.Random(seed)
    frame = ["Home | About | Contact", "Page 1 of 9", "  cookie   NOTICE & terms"]
    for i in range(n):
        lines = [draw.choice(frame).replace("1", str(i)) for _ in range(draw.randint(0, 4))]
        lines += [" ".join(f"w{draw.randint(0, 400)}" for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 4))]
        lines += draw.choice([[], ["", "\t"], ["é ü x <b>"], ["a b c a b c"]])
        draw.shuffle(lines)
        yield i, draw.choice(["h1", "h1", "h2", None]), "\n".join(lines)


SCHEMA = "doc_id long, source string, text string, lines int, place string, kept string, c0 string"


def test_equals_plain_loops(spark):
    rows = list(texts(3, 300)) + [(400, "h1", None), (401, None, ""), (None, "h2", "x"), (None, "h2", "x")]
    rows += [(500 + i, "h2", "one text that many copies share\n" + "word " * 60) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "p", "k", "c") for r in rows], SCHEMA).repartition(7)
    limits = L.Limits(min_documents=5, share=0.1)
    assert judged(df, limits=limits, min_words=6) == plain(rows, limits, 6)
    assert judged(df) == plain(rows, L.Limits())


def test_copies_of_a_text_are_one_document(spark):
    rows = [(i, "h", "a line of its own\n" + "and more words here " * 20) for i in range(100)]
    df = spark.createDataFrame([(*r, 1, "p", "k", "c") for r in rows], SCHEMA)
    assert {r.n_removed_words for r in L.judged(df).collect()} == {0}


def test_lines_go_and_depleted_documents_too(spark):
    body = "\n".join(f"{i}1x {i}y {i}z" for i in "abcdefghij")
    rows = [(i, "h", f"Menu of the site\n{body} {'q' * (i + 1)}\nlast {'r' * (i + 1)}line") for i in range(12)]
    rows += [(99, "h", "Menu  of the SITE\n" * 5 + "short rest here")]
    df = spark.createDataFrame([(*r, 1, "p", "k", "c") for r in rows], SCHEMA)
    cleaned = {r.doc_id: r.text for r in L.cleaned(df, limits=L.Limits(min_documents=12), min_words=10).collect()}
    assert 99 not in cleaned and set(cleaned) == set(range(12))
    assert cleaned[0] == rows[0][2].split("\n", 1)[1]


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("text", ["a " * 50_000, "x" * 200_000, "\n" * 9_000 + "é " * 9_000, "a b c d\n" * 20_000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(1, "h", text, 1, "p", "k", "c")], SCHEMA)
    assert judged(df) == plain([(1, "h", text)], L.Limits())


def test_statement(spark, sf_dir):
    """The DuckDB statement of the query gives the same rows."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(ORACLES["op11_line_rules"])
    columns = [c[0] for c in found.description]
    got = QUERIES["op11_line_rules"](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
