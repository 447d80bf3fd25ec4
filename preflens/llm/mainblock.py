"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive where pages with a marked article have their article, tags score
negative, and one linear scan finds the contiguous run of highest total: the content region. The weights are counted in Spark on
labelled pages: those that mark their article with ``<article>``, ``<main>`` or ``itemprop=articleBody``. A word's weight goes by
its context (innermost container and its classes, and the block it stands in), a tag's by its name and classes.

What a page itself declares not to be text is left out before the scan and inside the region: scripts, styles, forms, navigation,
asides, footers, headers outside an article, hidden elements, and containers whose class, id or role names such a part or reader
comments.

Null, empty and wordless pages give an empty text; whole pages are read; repeated rows and null ids are rows like others; a page
cut off inside a tag or a script ends there. Without labelled pages the default weights hold. Other columns are left aside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import most_frequent

#: Labelled pages to learn from (about; a share by hash), and weights kept, the most frequent ones.
LEARN_PAGES, LEARN_WEIGHTS = 50_000, 50_000
WORD_DEFAULT, TAG_DEFAULT, TAG_LEAST, MOST = 1.0, -0.5, -0.05, 6.0

# Names of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav aside footer form button select option datalist dialog menu iframe object embed "
                    "svg math canvas audio video map textarea title xmp noembed noframes fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div header hgroup ul ol dl table tbody thead tfoot tr td th blockquote figure figcaption "
                       "details summary center pre address".split()) | (DROPPED - VOID)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tablist form".split())
# Words of class and id names that say what a container is.
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist "
                          "consent cookie cookies disqus footer form gdpr login masthead menu menus modal nav navbar navigation navi "
                          "newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion "
                          "promoted recommended related reply replies respond share sharing sharebar shares sidebar sidenav signup skip social "
                          "sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split())
OUTER_NAMES = frozenset("header head".split())  # dropped outside an article only
CONTENT_NAMES = frozenset("article articlebody body content entry main page post story text wrapper container layout has with no".split())

_ATTRIBUTES = r"""((?:[^>"']|"[^"]*"|'[^']*')*+)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:" + _ATTRIBUTES + r">|[^>]*(?:>|\Z))", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=100_000)
def tag_facts(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Of a start tag: its name with its classes, and whether it is dropped, dropped outside an article, or marks an article."""
    found = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape(a or b or c))
    classes = found.get("class", "").split()
    role, prop = found.get("role", "").lower(), found.get("itemprop", "").lower()
    marked = name in ("article", "main") or role in ("main", "article") or prop == "articlebody"
    words = {w.lower() for part in (found.get("class", ""), found.get("id", "")) for w in _NAME.findall(part)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    named = name in CONTAINERS and not words & CONTENT_NAMES
    top = name in ("html", "body")
    drop = name in DROPPED or not top and not marked and (hidden or role in DROPPED_ROLES or named and bool(words & DROPPED_NAMES))
    outer = name == "header" or named and bool(words & OUTER_NAMES)
    return ".".join([name, *sorted(classes)])[:200], drop, outer and not marked, marked


def tokens(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, text or tag, context, is a block edge, inside a marked article) in page order; dropped parts are left out.

    kind is ``w`` for text (unescaped, white space kept) and ``t`` for a tag.
    """
    at, stack, dropped, marked, block = 0, [], 0, 0, ""  # stack: (name, facts, dropped?, marked?)
    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at and not dropped:
            context = f"{stack[-1][1] if stack else ''} {block}"
            yield "w", html.unescape(page[at:end]), context, False, marked > 0
        if not found:
            return
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if found[1]:  # an end tag closes what it names and all that is still open inside
            if name in CONTAINERS:
                level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if level is None:
                    continue
                was = dropped
                for _, _, d, m in stack[level:]:
                    dropped, marked = dropped - d, marked - m
                del stack[level:]
                block = ""
                if not was:
                    yield "t", f"/{name}", "", True, marked > 0
            elif not dropped:
                if name not in INLINE:
                    block = ""
                yield "t", f"/{name}", "", name not in INLINE, marked > 0
            continue
        key, drop, outer, mark = tag_facts(name, (found[3] or "").rstrip("/ "))
        drop = drop or outer and not marked
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            if not dropped and not drop:
                yield "t", key, "", name == "hr", marked > 0
            continue
        if name in CONTAINERS or drop and name not in INLINE | {"p", "li"}:
            stack.append((name, key, int(drop), int(mark)))
            dropped, marked, block = dropped + drop, marked + mark, ""
        elif name not in INLINE:
            block = name
        if not dropped:
            yield "t", key, "", name not in INLINE, marked > 0


def word_keys(context: str) -> tuple[str, str]:
    """A context, and its block in any container: what decides where the context was never seen."""
    return context, "* " + context.rsplit(" ", 1)[1]


def count_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and tags of labelled pages, inside and outside their articles."""
    inside, outside = Counter(), Counter()

    def rows():
        every = list(inside.keys() | outside.keys())
        kind, key = [k[0] for k in every], [k[1] for k in every]
        counts = [pa.array([c[k] for k in every], pa.int64()) for c in (inside, outside)]
        inside.clear()
        outside.clear()
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.string()), *counts], ["kind", "key", "i", "o"])

    for batch in batches:
        for page in batch.column(0).to_pylist():
            seen = list(tokens(page or ""))
            if not any(t[4] for t in seen):
                continue
            for kind, text, context, _, marked in seen:
                side = inside if marked else outside
                if kind == "t":
                    side[kind, text] += 1
                else:
                    for key in word_keys(context):
                        side[kind, key] += len(text.split())
        if len(inside) + len(outside) > LEARN_WEIGHTS:
            yield rows()
    yield rows()


def learn_weights(pages: DataFrame, text: str = "html", sample: int = LEARN_PAGES) -> dict[tuple[str, str], float]:
    """Weights by (kind, key): log odds of being inside a marked article; tags stay below zero."""
    rows = pages.select(F.col(text).cast("string").alias("html"))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("html"), F.lit(n)) < sample)
    counted = rows.mapInArrow(count_weights, "kind string, key string, i long, o long")
    counted = counted.groupBy("kind", "key").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    counted = most_frequent(counted.withColumn("n", F.col("i") + F.col("o")), LEARN_WEIGHTS)
    out = {}
    for r in counted.collect():  # LEARN_WEIGHTS rows at most
        odds = max(-MOST, min(MOST, math.log((r["i"] + 1) / (r["o"] + 1))))
        out[r["kind"], r["key"]] = odds if r["kind"] == "w" else min(TAG_LEAST, (odds - MOST) / 2 if odds < 0 else TAG_DEFAULT)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run [lo, hi) of highest total above zero, found in one scan; the first and shortest of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """Blocks of the best region, joined by line ends; white space inside a block is one space."""
    seen, scores = list(tokens(page or "")), []
    for kind, text, context, _, _ in seen:
        if kind == "w":
            known = (weights.get(("w", key)) for key in word_keys(context))
            scores.append(len(text.split()) * next((w for w in known if w is not None), WORD_DEFAULT))
        else:
            scores.append(weights.get(("t", text), TAG_DEFAULT))
    lo, hi = best_region(scores)
    blocks, block = [], []
    for kind, text, _, edge, _ in seen[lo:hi]:
        if kind == "w":
            block.append(text)
        elif edge:
            blocks.append(block)
            block = []
        elif text.split(".", 1)[0] in ("br", "/br", "img"):
            block.append(" ")
    joined = (" ".join("".join(b).split()) for b in [*blocks, block])
    return "\n".join(b for b in joined if b)


def extract(pages: DataFrame, page_id="page_id", url="url", text="html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = learn_weights(pages, text)
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def read(batches):
        for batch in batches:
            found = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["id", "at", "text"])

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("at"), F.col(text).cast("string").alias("html"))
    out = rows.mapInArrow(read, f"id {kinds[0]}, at {kinds[1]}, text string")
    return out.select(F.col("id").alias(page_id), F.col("at").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
