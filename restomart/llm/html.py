"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import materialize

MIN_PAGES = 5  # different pages of a host that make a subtree part of its template

RUNNING = 60  # characters that make a block running text

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
              "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead figcaption".split())
_DROPPED = set("head script style noscript template nav footer aside form button select option textarea "
               "iframe object svg canvas dialog menu".split())
_DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
_DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "cookie cookies consent gdpr notice notices comment comments respond replies discussion disqus "
    "newsletter subscribe share sharing social related breadcrumb breadcrumbs menu nav navbar "
    "navigation popup modal widget login signup footer".split())
_PARAGRAPH_CLOSERS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
                         "header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "select", "article", "main", "body"}
# Names of several words count only as these compounds: 'cookie-notice' is dropped, 'with-sidebar' is not.
_PARTS = _DROPPED_WORDS | set("area bar block body bottom box button buttons container form icons inner item items link "
                              "links list message overlay panel section site slot text top unit widgets wrap wrapper".split())
# These words count anywhere in a name, unless it speaks of having or not having them.
_ANYWHERE = set("comment comments sponsor sponsored advert adverts advertisement related disqus".split())
_SENSES = set("no not with without has have open opened closed enabled disabled allowed off".split())
# On the way to a dish list or a notice: no reason to drop what stands inside an article.
_SUBJECTS = set("menu notice notices".split())
_WORDS = re.compile(r"[a-z]+")
_HEAD = set("title base link meta style script noscript template".split())


def _dropped_name(token: str, inside: bool) -> bool:
    """Whether a class or id names something beside the main text: it begins or ends with such a word and
    holds no word of another sense, or speaks of comments or adverts. ``inside``: of an article."""
    words = _WORDS.findall(token)
    if not words or inside and set(words) <= _SUBJECTS | {"list", "section", "block", "item", "items"}:
        return False
    if set(words) & _ANYWHERE and not set(words) & _SENSES:
        return True
    return bool({words[0], words[-1]} & _DROPPED_WORDS) and set(words) <= _PARTS


class _Element:
    __slots__ = ("tag", "label", "parts", "article", "main", "dropped", "holder", "first", "marked", "hard")

    def __init__(self, tag, label, article, main, dropped, first, marked, hard=False):
        self.tag, self.label, self.parts = tag, label, []
        self.article, self.main, self.dropped = article, main, dropped
        self.holder = tag in ("html", "body", "main", "article")  # holds the main text: no template
        self.first, self.marked, self.hard = first, marked, hard  # hard: dropped, and not by a name only


class PageReader(HTMLParser):
    """Reads one page into text blocks and hashes of its element subtrees.

    Subtrees whose hash is in ``templates`` are deleted. Running text of an article or main element
    (paragraphs, headings, items) is never a template by itself, since pages may share passages;
    marked or grouping elements in it may be.
    """

    def __init__(self, templates: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.templates = templates
        self.open = [_Element("", "", False, False, False, 0, False)]
        self.count: Counter[str] = Counter()  # open elements by tag, so that no end tag looks for one in vain
        self.blocks: list[tuple[str, bool, bool]] = []
        self.run: list[str] = []
        self.hashes: set[int] = set()
        self.articles = False

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                top = self.open[-1]
                self.blocks.append((text, top.article, top.main))

    def _close(self) -> None:
        if self.open[-1].tag not in _INLINE:
            self._flush()
        done = self.open.pop()
        self.count[done.tag] -= 1
        above = self.open[-1]
        above.holder |= done.holder
        digest = xxhash.xxh3_64_intdigest("\x1f".join([done.tag, done.label, *done.parts])) - (1 << 63)
        above.parts.append(str(digest))
        inside = done.article or done.main
        if done.parts and not done.holder and done.tag not in _INLINE and (
                not inside or done.marked or done.tag not in _TEXT):
            self.hashes.add(digest)
            if digest in self.templates:
                del self.blocks[done.first:]

    def _end_head(self, tag: str) -> None:
        """Content that no head can hold, or a body, ends a head that was left open."""
        if self.open[-1].tag == "head" and tag not in _HEAD or tag == "body":
            while self.count["head"]:
                self._close()

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag in _VOID:
            if tag not in _INLINE:
                if tag in ("br", "hr"):
                    self.run.append(" ")
                else:
                    self.open[-1].parts.append(tag)
            return
        closes = {t for t in (*_CLOSES.get(tag, ()), *(("p",) if tag in _PARAGRAPH_CLOSERS else ())) if self.count[t]}
        for i in range(len(self.open) - 1, 0, -1) if closes else ():
            if self.open[i].tag in closes:
                while len(self.open) > i:
                    self._close()
                break
            if self.open[i].tag in _SCOPES:
                break
        if tag not in _INLINE:
            self._flush()
        top = self.open[-1]
        named = {k: v or "" for k, v in attrs}
        label = f"{named.get('id', '')} {named.get('class', '')}".lower()
        article = top.article or tag == "article"
        main = top.main or tag == "main" or named.get("role") == "main"
        hard = (top.hard or tag in _DROPPED or named.get("role", "").lower() in _DROPPED_ROLES
                or "hidden" in named or tag == "header" and not (top.article or top.main))
        by_name = any(_dropped_name(t, top.article or top.main) for t in label.split())
        # A name never drops what holds the main text, nor a wrapper of it; later articles may be comments.
        if tag in ("html", "body", "main") or tag == "article" and not self.articles and (not by_name or not top.dropped):
            dropped = hard
        else:
            dropped = hard or top.dropped or by_name
        if not dropped:
            self.articles |= tag == "article"
        self.open.append(_Element(tag, label, article, main, dropped, len(self.blocks), bool(label.strip()), hard))
        self.count[tag] += 1

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._close()
                return
        if tag in ("p", "br"):
            self._flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        text = " ".join(data.split())
        if text:
            self._end_head("")
        top = self.open[-1]
        if text:
            top.parts.append(text)
        if not top.dropped:
            self.run.append(data)

    def read(self, page: str) -> "PageReader":
        self.feed(page)
        self.close()
        while len(self.open) > 1:
            self._close()
        self._flush()
        return self

    def text(self) -> str:
        """The blocks inside articles, or else inside the main element, unless more running text than they hold
        stands outside when the templates are gone; then all of them."""
        for inside in (1, 2):
            kept = [block[0] for block in self.blocks if block[inside]]
            outside = sum(len(block[0]) for block in self.blocks if not block[inside] and len(block[0]) >= RUNNING)
            if kept and sum(map(len, kept)) >= outside:
                return " ".join(kept)
        return " ".join(block[0] for block in self.blocks)


def _subtrees(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        read = [PageReader().read(page) for page in part]
        yield pd.DataFrame({
            "page": [xxhash.xxh3_64_intdigest("\x1f".join(r.open[0].parts)) - (1 << 63) for r in read],
            "hashes": [sorted(r.hashes) for r in read]})


def _texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[bytes, frozenset[int]] = {}
    for pages, templates in parts:
        out = []
        for page, hashes in zip(pages, templates):
            key = hashes.tobytes()
            if key not in known:
                known = {key: frozenset(hashes.tolist())} if len(known) > 1_000 else known | {
                    key: frozenset(hashes.tolist())}
            out.append(PageReader(known[key]).read(page).text())
        yield pd.Series(out, dtype=object)


def host_of(url) -> F.Column:
    """Host of a url in lower case, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host`` and ``subtree``: hashes of element subtrees on at least ``min_pages`` pages of the host, however
    many it has.

    Pages of equal content count once, so copies of a page are no template. Counts are summed
    before each shuffle, and a page of a subtree is one row, so a large host is no hot group.
    """
    found = F.pandas_udf(_subtrees, "page long, hashes array<long>")
    read = materialize(pages.select(
        host_of(F.col("url")).alias("host"), found(F.coalesce("html", F.lit(""))).alias("found"),
    ).select("host", "found.*").distinct(), "subtrees")
    return read.select("host", F.explode("hashes").alias("subtree")).groupBy("host", "subtree").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages).select("host", "subtree")


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of every page, without the site's template.

    The reference data of this library has no web pages, so the operator is general: ``pages`` has
    ``page_id``, ``url`` and ``html``; gives per row ``page_id``, ``url``, ``text`` and ``n_chars``.

    Element subtrees are hashed, counted per host, and deleted where they recur on at least
    ``min_pages`` different pages. Scripts, styles, menus, page headers, footers, sidebars, notices,
    adverts, forms and comments that vary from page to page go by their elements, roles and names. The text is
    what is left inside articles, or else inside the main element, unless more running text stands outside;
    then it is all: character references decoded, white space in a block one space, blocks joined by one.

    Null or empty html has empty text. A null url counts as a host of its own. Repeated rows stay
    as they are; a null page_id is kept; other columns are ignored; an empty table gives an empty
    result. The templates of a host travel to its pages in a join that Spark broadcasts only if the
    stored table is small enough, and otherwise splits at a large host.
    """
    templates = materialize(template_subtrees(pages, min_pages).groupBy("host").agg(
        F.array_sort(F.collect_set("subtree")).alias("subtrees")), "templates")
    text = F.pandas_udf(_texts, "string")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                        host_of(F.col("url")).alias("host"))
    out = rows.join(templates, "host", "left").select(
        "page_id", "url", text("html", F.coalesce("subtrees", F.array().cast("array<long>"))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
