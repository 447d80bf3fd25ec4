"""Main text of planted pages."""

import html
import random
import re

import pytest

from preflens.llm import mainblock

ARTICLE = ["Titel &amp; mehr", "Erster  Absatz\n mit <b>fettem</b> Text und <a href='/x?a=1&b=2'>Verweis</a>.", "Zweiter Absatz, drei &lt;vier&gt; &#8364; &nbsp; Ende."]
WANT = "Titel & mehr\nErster Absatz mit fettem Text und Verweis.\nZweiter Absatz, drei <vier> € Ende."
JUNK = """<header><p>Seitenkopf hier</p></header><nav><ul><li><a href="/">Start</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, a long sentence with many words that looks like text, honestly.</p></div>
<div class="ad">Buy this now or never, with all these many fine words.</div><aside><p>Related story about it.</p></aside>"""
TAIL = """<div id="comments"><p>A reader says many words here, all of them wrong, and goes on and on.</p><div><p>Reply</p></div></div>
<form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; host &middot; words</footer><script>var t = "</p>" < 3;</script>"""


def page(lead="<article>", end="</article>", body=None, junk=JUNK, tail=TAIL):
    body = body or f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{p}</p>" for p in ARTICLE[1:])
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{junk}<!-- x <p>no</p> -->{lead}{body}{end}{tail}</body></html>"


CASES = {
    "marked": page(),
    "main": page("<main>", "</main>"),
    "unmarked": page('<div class="post-content">', "</div>"),
    "inner junk": page(body=f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><aside>no</aside><script>x()</script><form><p>no no</p></form><div class='share'>no</div><p>{ARTICLE[2]}"),
    "unclosed": page(body=f"<h1>{ARTICLE[0]}</h1><p><b>{ARTICLE[1]}<br><p>{ARTICLE[2]}"),
    "upper case": page("<ARTICLE CLASS=x>", "</ARTICLE>"),
    "cut off": page().split("<form>")[0] + "<script>var a = 'never closed <p>words",
    "cut in a tag": page(tail="<footer>x</footer><a href='/half"),
    "sidebar in the wrapper's name": page('<div class="content-with-sidebar">', "</div>"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_planted(spark, name):
    rows = [(i, "u", CASES["marked"] if i % 2 else CASES["main"]) for i in range(30)] + [(99, "v", CASES[name])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, id int, text string").repartition(2)
    got = {r["page_id"]: r for r in mainblock.extract(table).collect()}
    assert got[99]["text"] == WANT and got[99]["n_chars"] == len(WANT)
    assert all(r["text"] == WANT for r in got.values()) and len(got) == 31


def test_odd_pages(spark):
    long = "<article>" + "<p>wort &amp; satz</p>" * 50_000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain words < no tags"), (None, None, "<p>a</p>"), (5, "u", long), (5, "u", long), (7, "u", "<<<>>><p"), (8, "u", "<a '" * 2000)]
    out = mainblock.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 8 and got[1] == got[2] == "" and got[3] == "plain words < no tags" and got[None] == "a"
    assert got[5] == "\n".join(["wort & satz"] * 50_000)
    assert mainblock.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_best_region():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 15))]
        lo, hi = mainblock.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[lo:hi]) == best


def test_tables_pages(spark):
    """On the given pages: exactly what stands in their article, which the scan finds without looking for it."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in mainblock.extract(table).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
