"""Main text of web pages by the maximum-scoring subsequence (operator 4).

A page is a sequence of tags and texts. Words score by where they stand, tags
by their name; both weights are log odds of being inside the content, counted on
pages that label themselves: those with an article or main element. Words beside
the content or in links may score below 0, plain words never; a tag never scores
above a small negative value. One linear scan finds the contiguous run of
tokens with the largest sum; its texts are the content, but for those inside
elements that are no part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments), which are named by
their tag, role, class or id. Names that articles also write about (a legal
history, a section's header) don't count as such. Parsing takes time in proportion
to the page, however deep or broken it is.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by a line feed; a line-break tag is
white space. Null and empty pages, and pages without words outside such elements,
have an empty text. Each row has its result, repeated ids too; one without an id is
left out. The weights are fitted on ``sample_rows`` self-labelled pages,
those with the smallest hashes of their ids; without any the defaults hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches

SAMPLE_ROWS = 2000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: All that can come after the last ``>`` of a page.
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements whose content is not markup, and those without content.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head"} | _RAW
_OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Parts of a class or id that name such an element wherever they stand in it.
_OUTSIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "masthead", "cookie", "cookies", "gdpr", "popup", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "pagination", "pager",
}
#: Parts that also name what articles write about: they count only if every part of the name is one of these, of those above, or says where on a page it is.
_OUTSIDE_ALONE = {
    "banner", "promotion", "menu", "aside", "header", "footer", "consent", "notice", "notification", "alert", "modal", "overlay", "subscription", "login", "share", "sharing", "social", "related", "recommended", "replies", "reply", "respond", "widget", "search", "copyright", "legal", "hidden", "skip",
}
_WHERE = {"site", "page", "global", "top", "bottom", "left", "right", "main", "primary", "secondary", "sticky", "fixed", "bar", "box", "block", "wrap", "wrapper", "container", "inner", "outer", "list", "links", "buttons", "form", "area", "items", "item", "link", "posts", "content"}
_CONTENT = {"article", "main"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


@dataclass
class Text:
    """A text between two tags: decoded, with its block, whether it stands in an excluded element, and what it stands in."""

    text: str
    block: int
    outside: bool
    place: str


@dataclass
class Page:
    """Texts and tag names ("<p", "</p") in page order."""

    tokens: list[Text | str] = field(default_factory=list)
    labelled: bool = False


def _names_outside(value: str, inside: bool) -> bool:
    """Whether a class or id names an element that is no part of an article."""
    parts = set(_PARTS.findall(value))
    if not _OUTSIDE_NAMES.isdisjoint(parts):
        return True
    alone = parts & _OUTSIDE_ALONE
    return bool(alone) and parts <= _OUTSIDE_ALONE | _WHERE and not (inside and alone == {"header"})


def _excluded(name: str, attributes: str, inside: bool) -> bool:
    if name in _OUTSIDE:
        return not (inside and name == "header")  # an article's own header holds its title
    if not attributes or name in ("html", "body", "article", "main") and "omment" not in attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _OUTSIDE_ROLES:
            return True
        if key in ("class", "id") and any(_names_outside(x, inside) for x in value.split()):
            return True
    return False


def parse(source: str) -> Page:
    """The tokens of a page; unclosed and unopened elements are borne with."""
    page = Page()
    stack: list[tuple[str, bool, int]] = []  # (element, excluded, place of the paragraph that a block element would close, or -1)
    places: dict[str, list[int]] = {}  # of the open elements of each name
    at = block = outside = inside = links = 0
    length, last = len(source), source.rfind(">")

    def put(piece: str) -> None:
        if piece:
            text = html.unescape(piece) if "&" in piece else piece
            place = ("link" if links else "text") + ("-in" if inside else "")
            page.tokens.append(Text(text, block, outside > 0, place))

    def leave(depth: int) -> None:
        nonlocal outside, inside, links
        for name, excluded, _ in stack[depth:]:
            outside -= excluded
            inside -= name in _CONTENT
            links -= name == "a"
            places[name].pop()
        del stack[depth:]

    while at < length:
        found = _TOKEN.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
        if not found:
            put(source[at:])
            break
        put(source[at : found.start()])
        at = found.end()
        close, name, attributes = ((found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])) if found.re is _TOKEN else ("", "", "")
        if not name:
            continue
        name = name.lower()
        if not outside and name not in _RAW and (close or not _excluded(name, attributes, inside > 0)):  # tags of excluded elements are left out like their texts
            page.tokens.append(f"<{close}{name}")
        if name not in _INLINE:
            block += 1
        elif name == "br":
            put(" ")
        if close:
            if places.get(name):
                leave(places[name][-1])
            continue
        if name in _VOID or attributes.endswith("/") and name not in _INLINE and name in ("svg", "path"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else length
            continue
        if name in _CLOSES_P and stack and stack[-1][2] >= 0:
            leave(stack[-1][2])
        elif name == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)
        excluded = _excluded(name, attributes, inside > 0)
        page.labelled |= name in _CONTENT and not excluded
        here = len(stack)
        stack.append((name, excluded, here if name == "p" else stack[-1][2] if stack and name in _INLINE else -1))
        places.setdefault(name, []).append(here)
        outside += excluded
        inside += name in _CONTENT
        links += name == "a"
    return page


#: Weights that hold for tags and places that the labelled pages don't have.
DEFAULT_WEIGHTS = {"text": 1.0, "text-in": 1.5, "link": -0.5, "link-in": 0.5, "text-beside": -1.5, "link-beside": -2.0}
DEFAULT_TAG = -0.3


def _place(item: Text, labelled: bool) -> str:
    """Where a text stands; beside the content if the page has a content element elsewhere."""
    return f"{item.place}-beside" if labelled and not item.place.endswith("-in") else item.place


def content_range(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """The tokens [first, last) with the largest sum of scores: one scan."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(page.tokens):
        if isinstance(item, str):
            total += min(weights.get(item, DEFAULT_TAG), -0.01)
        elif not item.outside:  # texts in excluded elements are left out anyway: they neither join nor part
            place = _place(item, page.labelled)
            total += len(item.text.split()) * weights.get(place, DEFAULT_WEIGHTS[place])
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = parse(source)
    first, last = content_range(page, weights)
    blocks: dict[int, list[str]] = {}
    for item in page.tokens[first:last]:
        if isinstance(item, Text) and not item.outside:
            blocks.setdefault(item.block, []).append(item.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each tag and each place of words stands inside and outside the content of labelled pages."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = parse(source)
            if not page.labelled:
                continue
            depth = 0
            for item in page.tokens:
                if isinstance(item, str):
                    name = item.lstrip("</")
                    depth += (name in _CONTENT) * (-1 if item.startswith("</") else 1)
                    counts.setdefault(item, [0, 0])[depth <= 0] += 1
                else:
                    within, n = item.place.endswith("-in"), len(item.text.split())
                    for place in (_place(item, True), item.place.removesuffix("-in")):  # the latter: as if the page had no label
                        counts.setdefault(place, [0, 0])[not within or item.outside] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([v[i] for v in counts.values()], pa.int64()) for i in (0, 1))], names=["token", "inside", "outside"])


def fit(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights from a sample of the pages that have a content element; log odds, smoothed towards the defaults."""
    import math

    bounded_batches(pages.sparkSession)
    own = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = own.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows)
    rows = own.select("page_id", "html").join(F.broadcast(chosen), "page_id").select("html")  # sample_rows numbers bound the broadcast
    counted = rows.mapInArrow(_count_rows, "token string, inside long, outside long").groupBy("token").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    kind = lambda token: "<" if token[0] == "<" else "unlabelled" if token in ("text", "link") else "words"
    sums = {k: (sum(r.inside for r in counted if kind(r.token) == k) + 1, sum(r.outside for r in counted if kind(r.token) == k) + 1) for k in ("<", "unlabelled", "words")}
    out = dict(DEFAULT_WEIGHTS)
    for r in counted:
        inside, outside = sums[kind(r.token)]
        odds = math.log((r.inside + 1) / inside) - math.log((r.outside + 1) / outside)
        if r.token[0] == "<":
            out[r.token] = max(-1.0, min(-0.01, odds / 4))
        else:  # a word's sign is learned with its weight, but plain words of a page without labels, which score above 0
            out[r.token] = max(0.25 if r.token == "text" else -2.0, min(2.0, odds))
    return out


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Other columns are ignored; a row without an id is left out."""
    bounded_batches(pages.sparkSession)
    weights = fit(pages) if weights is None else weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
