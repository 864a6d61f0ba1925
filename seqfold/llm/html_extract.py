"""Main text of web pages as the maximum-scoring run of their blocks.

A page is a sequence of words and tags. Words score by the kind of block they stand in (paragraph, heading, list
item, ..., mostly link or not) and by the class and id of the nearest element that has any; tags cost. All weights are
log-odds counted on labelled pages, those that mark their main part themselves with one ``article`` or ``main``
element. A linear scan finds the contiguous run of blocks with the highest sum. The mark itself has no weight: it only
tells a heading's ``header`` from the page's.

Containers that are never main text (navigation, footers, asides, forms, adverts, notices, comments and the like,
by tag, role, class or id, or not shown) cost and are left out even inside the run. If that leaves nothing of a page,
names of classes and ids alone speak against no container of it.

The counts come from at most ``MAX_PAGES`` labelled pages, the first by a hash of the id; extraction covers every
page, whole.

Defined results: a null or empty html, or one without text, gives an empty text; a page cut off within a tag or
comment ends there; without labelled pages the prior weights decide; repeated rows give repeated results; other
columns than page_id, url and html aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from math import log
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MAX_PAGES = 4000
#: Words that must stand under a name for it to have a weight.
MIN_NAME_WORDS = 200
#: Bound of learned weights, and what a word that is left out costs.
MOST, NOISE = 3.0, -0.1

TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z))",
    re.S,
)
#: One name and its value; a value in quotes is passed whole, so nothing in it is taken for a name.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("nav footer aside form noscript template button select svg canvas object audio video dialog menu head fieldset search".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
NOISE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners sidebar sidebars "
    "menu menus nav navs navbar navigation topbar breadcrumb breadcrumbs footer footers header masthead cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup share sharing social socials related recommended recommendations popup modal overlay widget widgets toolbar "
    "pagination pager login search copyright legal disclaimer alert alerts skip paywall teaser outbrain taboola".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: An open element of the first kind is closed by a start tag of the second.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
CLOSES_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}


class Block(NamedTuple):
    text: str
    kind: str  # nearest block element, "/link" after it if most of the text is in links
    noise: bool
    struck: bool  # noise by more than a name
    main: bool
    name: str  # of the nearest element with a class or id
    tags: tuple[str, ...]  # start tags since the block before


class Weights(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]
    names: dict[str, float] = {}

    def word(self, kind: str) -> float:
        return self.words.get(kind, -1.0 if kind.endswith("/link") else 1.0)

    def tag(self, tag: str) -> float:
        return self.tags.get(tag, -0.2)


def _names(attributes: str) -> tuple[set[str], set[str], bool, bool]:
    """Name parts of class and id, roles, whether hidden, whether marked as the article's body."""
    names, roles, hidden, body = set(), set(), False, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "class" or key == "id":
            names.update(re.split(r"[^a-z]+", value))
        elif key == "role":
            roles.update(value.split())
        elif key == "itemprop":
            body |= value == "articlebody"
        elif key == "hidden" or key == "aria-hidden":
            hidden |= value != "false"
        elif key == "style":
            hidden |= bool(UNSEEN.search(value))
    return names, roles, hidden, body


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; tags, comments and raw elements are gone, references decoded."""
    found: list[Block] = []
    # Open elements: tag, noise from here on, main from here on.
    stack: list[tuple[str, bool, bool, bool, str]] = []
    parts: list[str] = []
    linked = 0
    tags: list[str] = []
    links = 0
    at, n = 0, len(html)

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            kind = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "body")
            kind = "h" if kind in ("h1", "h2", "h3", "h4", "h5", "h6") else kind
            _, noise, struck, main, name = stack[-1] if stack else ("", False, False, False, "")
            found.append(Block(text, kind + "/link" * (2 * linked > len(text)), noise, struck, main, name, tuple(tags)))
            tags.clear()
        parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text:
            decoded = entities.unescape(text)
            parts.append(decoded)
            if links:
                linked += len(decoded)

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        if m["tag2"] and html[at - 1 : at] != ">":
            break  # cut off within a tag
        tag = tag.lower()
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in BLOCK:
                flush()
            if depth is not None:
                links -= sum(x[0] == "a" for x in stack[depth:])
                del stack[depth:]
            continue
        tags.append(tag)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = close.start() if close else n
            if tag in ("textarea", "iframe"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            open_tag = stack[k][0]
            if tag in CLOSES.get(open_tag, ()):
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                break
            if tag in CLOSES_WITHIN and open_tag in CLOSES_WITHIN[tag] or open_tag in ("div", "section", "article", "main", "body", "table") and tag not in ("tr", "td", "th"):
                break
        _, noise, struck, main, name = stack[-1] if stack else ("", False, False, False, "")
        names, roles, hidden, body = _names(m["attributes"] or m["attributes2"] or "")
        if tag in ("html", "body"):
            pass
        elif tag in ("article", "main"):
            struck |= hidden
            noise |= bool(names & COMMENT_NAMES) or hidden
            main |= not noise
        else:
            struck |= tag in NOISE_TAGS or (tag == "header" and not main) or bool(roles & NOISE_ROLES) or hidden
            noise |= struck or bool(names & NOISE_NAMES and not (main and names & {"header"} and tag in ("header", "h1")))
            main |= (body or "main" in roles) and not noise
            name = " ".join(sorted(names - {""})) or name
        stack.append((tag, noise, struck, main, name))
        links += tag == "a"
    flush()
    return found


def counts(html: str) -> Counter:
    """(what, name, inside the main part or not) of a labelled page, else nothing."""
    if len(re.findall(r"<(?:article|main)\b", html, re.I)) != 1:
        return Counter()
    c: Counter = Counter()
    for b in blocks(html):
        inside = b.main and not b.noise
        if not b.noise:
            c["word", b.kind, inside] += len(b.text.split())
            c["name", b.name, inside] += len(b.text.split())
        for t in b.tags:
            if t not in ("article", "main"):
                c["tag", t, inside] += 1
    return c


def weights(c: Counter) -> Weights:
    """Log-odds of being inside; words lean to the positive and tags always cost."""
    words, tags, names = {}, {}, {}
    for what, name in {k[:2] for k in c}:
        odds = log((c[what, name, True] + 1) / (c[what, name, False] + 1))
        if what == "word":
            words[name] = max(-MOST, min(MOST, odds + (-1.0 if name.endswith("/link") else 1.0)))
        elif what == "tag":
            tags[name] = max(-1.0, min(-0.05, odds / MOST))
        elif c[what, name, True] + c[what, name, False] >= MIN_NAME_WORDS:
            names[name] = max(-MOST, min(MOST, odds)) / 2
    return Weights(words, tags, names)


def extract(html: str, w: Weights) -> str:
    """The best run of blocks, without the noise in it."""
    found = blocks(html)
    if not any(not b.noise for b in found):
        found = [b._replace(noise=b.struck) for b in found]  # nothing but containers that their names alone speak against
    best, best_run, total, start = 0.0, (0, 0), 0.0, 0
    for k, b in enumerate(found):
        n = len(b.text.split())
        if b.noise:
            score = NOISE * n
        else:
            score = n * (w.word(b.kind) + w.names.get(b.name, 0.0)) + sum(map(w.tag, b.tags))
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, best_run = total, (start, k + 1)
    return "\n\n".join(b.text for b in found[slice(*best_run)] if not b.noise)


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Weights from a bounded sample of labelled pages; only their counts reach the driver."""
    labelled = pages.where(F.lower("html").rlike(r"<(article|main)\b"))
    ids = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).withColumnRenamed("page_id", "chosen")
    chosen = labelled.join(F.broadcast(ids), F.col("page_id") == F.col("chosen")).select("html")
    rows = common.flat_map_rows(chosen, lambda: lambda h: [(*k, v) for k, v in counts(h).items()], "what string, name string, inside boolean, n long")
    return weights(Counter({(r.what, r.name, r.inside): r.n for r in rows.groupBy("what", "name", "inside").agg(F.sum("n").alias("n")).collect()}))


def extract_pages(pages: DataFrame, w: Weights) -> DataFrame:
    def make():
        def of(page_id, url, html):
            text = extract(html or "", w)
            return page_id, url, text, len(text)

        return of

    return common.map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))
