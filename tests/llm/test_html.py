import time
from html.parser import HTMLParser

import pytest

from lorekeep.llm.html import DEFAULT_WEIGHTS, content_range, extract, fit, main_text, op4_html, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><!-- <p>no</p> -->
<article><header><h1>A &amp; B</h1></header><p>First  para<br>goes on.<p>Second <b>bold</b> one&nbsp;here.
<aside>See also this long list of other things to read</aside><div class="newsletter"><form><label>Mail</label></form></div><p>Ti.</article>
<section id="comments"><p>Nice post indeed, thank you so much for it</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE, DEFAULT_WEIGHTS) == "A & B\nFirst para goes on.\nSecond bold one here.\nTi."


def test_without_content_element():
    page = PAGE.replace("<article>", "<div id='x'>").replace("</article>", "</div>").replace("<header>", "").replace("</header>", "")
    assert main_text(page, DEFAULT_WEIGHTS) == "A & B\nFirst para goes on.\nSecond bold one here.\nTi."


@pytest.mark.parametrize(
    ("source", "text"),
    [(None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>open", "open"), ("a < b &lt; c", "a < b < c"), ("<p>x</div></p>y", "x\ny"), ("<script>never closed", ""), ("<p title='a>b'>q</p>", "q"), ('<p title="broken>words</p>', "words"), ("<nav>only</nav>", ""), ("<!-- open comment <p>x", "")],
)
def test_edges(source, text):
    assert main_text(source, DEFAULT_WEIGHTS) == text


def test_scan_finds_the_largest_sum():
    page = parse(PAGE)
    scores = []
    for x in page.tokens:
        if isinstance(x, str):
            scores.append(-0.3)
        elif x.outside:
            scores.append(0.0)
        else:
            place = x.place if x.place.endswith("-in") else f"{x.place}-beside"
            scores.append(len(x.text.split()) * DEFAULT_WEIGHTS[place])
    first, last = content_range(page, DEFAULT_WEIGHTS)
    best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
    assert sum(scores[first:last]) == pytest.approx(best)


def test_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    weights = fit(pages)
    assert all(v < 0 for k, v in weights.items() if k[0] == "<") and weights["text-in"] > 0 > weights["text-beside"]
    more = pages.unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", "x" * 500_000)], pages.schema)).selectExpr("*", "1 AS text", "2 AS n_chars")
    made = {r.page_id: r for r in extract(more, weights).collect()}
    assert len(made) == more.count() and made[10**6].text == "" and made[10**6 + 1].n_chars == 500_000
    for r in pages.collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert len(made[r.page_id].text.split()) == len(__import__("re").sub(r"<[^>]+>", " ", body).split())
    assert extract(pages.limit(0), weights).count() == 0
    assert fit(pages.limit(0)) == DEFAULT_WEIGHTS


class _Article(HTMLParser):
    """The blocks of text inside article elements, but for elements that are no part of them; for well-formed pages."""

    GONE = {"script", "style", "nav", "aside", "footer", "form", "title", "noscript", "button"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "br", "u", "small", "sub", "sup", "q"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks = [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.stack.append((tag, tag in self.GONE or dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append([])
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(gone for _, gone in self.stack):
            self.blocks[-1].append(data)


def test_table_equals_an_independent_extractor(spark, data):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    made = {r.page_id: (r.text, r.n_chars) for r in op4_html(spark, data).collect()}
    assert set(made) == set(rows)
    for page, source in rows.items():
        reader = _Article()
        reader.feed(source or "")
        lines = (" ".join("".join(x).split()) for x in reader.blocks)
        text = "\n".join(x for x in lines if x)
        assert made[page] == (text, len(text)), page


@pytest.mark.parametrize("name", ["section-header", "legal-history", "notice-of-death", "search-party", "header"])
def test_names_that_articles_write_about(name):
    page = f"<html><body><article><h1>Title</h1><div class='{name}'><p>Part of it</p></div><p id='{name}'>And this too.</p></article></body></html>"
    assert main_text(page, DEFAULT_WEIGHTS) == "Title\nPart of it\nAnd this too."


@pytest.mark.parametrize("name", ["site-footer", "legal-notice", "comment-list", "ad-slot", "share-buttons", "cookie-banner", "reply"])
def test_names_of_other_elements(name):
    page = f"<html><body><article><h1>Title</h1><p>And the text.</p><div class='{name}'><p>No part of it</p></div></article></body></html>"
    assert main_text(page, DEFAULT_WEIGHTS) == "Title\nAnd the text."


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "w", "<a <a " * 60_000, "<p><button>" + "<b>" * 40_000 + "<div></div>" * 40_000, "<div>" * 40_000 + "</b>" * 40_000, "<!--" * 60_000, "<a ' " * 60_000 + ">"])
def test_broken_pages_take_no_longer_than_their_length_asks(source):
    began = time.process_time()
    main_text(source, DEFAULT_WEIGHTS)
    assert time.process_time() - began < 5
