"""Main text of pages, against a parser of the standard library that knows the tables' layout, and on other layouts."""

import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillgraph.llm import html_text
from quillgraph.llm.html_text import main_text, main_texts, op3_html_text, stretches, threshold


class Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.on &= tag != "article"

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def plain(source):
    parser = Article()
    parser.feed(source)
    parser.close()
    return "\n\n".join(x for b in parser.blocks if (x := re.sub(r"\s+", " ", b).strip()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op3_html_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain(p.html or "") and got[p.page_id].url == p.url
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header>Site name</header><div class="cookie-notice"><p>We use <b>cookies</b>.</p></div>
<ul class=menu><li><a href="/">Home</a></li><li><a href="/a">All</a></li></ul>
<div id="content" class="with-sidebar"><h2>Head &amp; line</h2><p>First   paragraph of some length, long enough.<p>Second
paragraph&nbsp;here, &lt;b&gt; &eacute;&#233; x < y.</p><div class="advert">Buy <p>now</p></div><p>Short.</p><table><tr><td>cell</td></tr></table></div>
<aside><p>Other stories</p></aside><section id="comments"><p>Nice post, said a reader at length and in detail, more than once.</p></section>
<form><input type=text>Send us mail</form><script>var a = "<p>no</p>";</script><footer>&copy; all</footer></body></html>"""


def test_other_layout():
    assert main_text(PAGE) == "Head & line\n\nFirst paragraph of some length, long enough.\n\nSecond paragraph here, <b> éé x < y.\n\nShort.\n\ncell"


def test_odd_pages():
    assert main_text("") == "" and main_text("<nav>only</nav>") == "" and main_text("plain words") == "plain words"
    assert main_text("<p>open <b>bold<p>next") == "open bold\n\nnext"
    assert main_text("<!-- <p>no</p> --><p>yes</p><!-- open <p>no") == "yes"
    assert main_text("<script>if (a < b) { '</p>' }</script><p>t</p>") == "t"
    assert main_text('<p title="a > b">x</p><p title=it\'s>y</p>') == "x\n\ny"
    assert len(main_text("<p>" + "long word " * 200_000)) == 1_999_999


def paragraphs(n, what="Paragraph"):
    return [f"{what} {k} has many words and goes on for a good while, as the paragraphs of articles do." for k in range(n)]


def joined(*parts):
    return "\n\n".join(parts)


BODY = paragraphs(5)
LINKS = '<a href="/">Home</a> <a href="/about">About us</a> <a href="/contact">Contact</a>'
RIGHTS = "© 2024 Example Company, all rights reserved"
STORIES = '<ul><li><a href="x">Share on X</a><li><a href="n">Next story</a></ul>'

LAYOUTS = {
    "plain divs without any names": (f"<div>{LINKS}</div><div>The title</div>" + "".join(f"<div>{p}</div>" for p in BODY) + f"<div>{RIGHTS}</div>", joined("The title", *BODY)),
    "unclosed paragraphs": (f"<article><p class=share>Share this<p>{BODY[0]}<p>{BODY[1]}</article>", joined(BODY[0], BODY[1])),
    "unclosed list items in an article": (f"<main><p>{BODY[0]}<ul><li>One thing<li>Another<p>with a paragraph</ul><p>{BODY[1]}</main>", joined(BODY[0], "One thing", "Another", "with a paragraph", BODY[1])),
    "lists of links inside an article": (f"<article><ul><li><a>Part one</a><li><a>Part two</a></ul><h1>T</h1><p>{BODY[0]}<p>{BODY[1]}{STORIES}</article>", joined("T", BODY[0], BODY[1])),
    "names that contain unwanted words": (f'<article><p class="share-price">{BODY[0]}</p><p class="search-results-study">Short.</p><section id="comments-on-policy"><p>{BODY[1]}</p></section></article>', joined(BODY[0], "Short.", BODY[1])),
    "a table": (f"<body>{LINKS}<div><p>{BODY[0]}<table><tr><td>a<td>b<tr><td>1<td>2</table><p>{BODY[1]}</div>", joined(BODY[0], "a", "b", "1", "2", BODY[1])),
    "main": (f"<main><header><h1>T</h1></header><p>{BODY[0]}<p>Yes.<p>No.<p>Why?<p>{BODY[1]}</main><div>outside</div>", joined("T", BODY[0], "Yes.", "No.", "Why?", BODY[1])),
    "a card beside the text": (f"<div><p>{joined(*BODY)}</p></div><article><p>A card</p></article>", " ".join(BODY)),
    "a last paragraph behind a form": (f"<body><div>{BODY[0]}</div><form>Mail <input></form><div>Short last one.</div></body>", joined(BODY[0], "Short last one.")),
    "comments and a sidebar of prose": (f"<div class=post>{''.join(f'<p>{p}' for p in BODY)}</div><div class='post-comments'>{''.join(f'<p>{p}' for p in paragraphs(2, 'Comment'))}</div><div id=sidebar><p>{BODY[0]}</div>", joined(*BODY)),
    "short lines far from the text": (f"<div>{''.join(f'<p>{p}' for p in BODY)}</div><div><p>Tags<p>one<p>two<p>three</div>", joined(*BODY)),
    "short sentences behind a row of links": (f"<div>{''.join(f'<p>{p}' for p in BODY)}</div><div>{LINKS}</div><div><p>Call us.<p>Open daily.</div>", joined(*BODY)),
    "a layout class of the wrapper": (f'<div class="right-sidebar"><article>{"".join(f"<p>{p}" for p in BODY)}</article></div><footer>{BODY[0]}</footer>', joined(*BODY)),
    "a layout class of the page": (f'<div id="page" class="left-sidebar">{"".join(f"<p>{p}</p>" for p in BODY)}</div>', joined(*BODY)),
    "the word hidden in a value": (f'<article><p title="The hidden cost">{BODY[0]}</p><p>There is <a title="a hidden gem" href=x>one</a> more.</p></article>', joined(BODY[0], "There is one more.")),
    "a hidden element": (f"<div><p>{BODY[0]}<p>{BODY[1]}<p hidden>Not shown.<p style='display: none'>Nor this.<p>Seen <span aria-hidden=true>no</span>text.</div>", joined(BODY[0], BODY[1], "Seen text.")),
    "a page that is shown by a script": (f"<body style='display:none'><div style='visibility:hidden'>{''.join(f'<p>{p}' for p in BODY)}</div>", joined(*BODY)),
    "two articles": (f"<article><p>{BODY[0]}<p>{BODY[1]}</article><article><p>{BODY[2]}<p>{BODY[3]}</article>", joined(*BODY[:4])),
    "an article beside a division": (f"<article>{''.join(f'<p>{p}' for p in BODY)}</article><div>{''.join(f'<p>{p}' for p in paragraphs(4, 'Other'))}</div>", joined(*BODY, *paragraphs(4, "Other"))),
    "a paragraph that is a link before a list of links": (f"<article><p>{BODY[0]}<p>{BODY[1]}<p><a href=x>The full report is here</a></p>{STORIES}</article>", joined(BODY[0], BODY[1], "The full report is here")),
    "a header class in an article": (f"<article><div class='post-header'><h1>T</h1><p>A lead.</div><p>{BODY[0]}<p>{BODY[1]}</article>", joined("T", "A lead.", BODY[0], BODY[1])),
    "a form around the page": (f"<form id=aspnet><div>{LINKS}</div><div class=text><h1>T</h1>{''.join(f'<p>{p}' for p in BODY)}</div></form>", joined("T", *BODY)),
    "more comments than text": (f"<div class=post><h1>T</h1><p>{BODY[0]}<p>{BODY[1]}</div><div class='comments'>{''.join(f'<p>{p}' for p in paragraphs(9, 'Comment'))}</div>", joined("T", *BODY[:2])),
    "comments that are articles": (f"<article><h1>T</h1><p>{BODY[0]}<p>{BODY[1]}</article><ol class='comment-list'>{''.join(f'<li><article class=comment-body><p>{p}</article>' for p in paragraphs(9, 'Comment'))}</ol>", joined("T", *BODY[:2])),
    "an advert between paragraphs": (f"<div><p>{BODY[0]}<div class=ad><p>{paragraphs(1, 'Advert')[0]}</div><p>Short.<p>{BODY[1]}</div>", joined(BODY[0], "Short.", BODY[1])),
    "a class of a link in a sentence": (f"<div><p>{BODY[0]}<p>See <a class='nav-link' href=x>the other</a> page.<p>{BODY[1]}</div>", joined(BODY[0], "See the other page.", BODY[1])),
    "an item that ends elements far above": (f"<main><p>{BODY[0]}<ul><li>One {'<b>' * 100}thing<li>Another</ul><p>{BODY[1]}</main>", joined(BODY[0], "One thing", "Another", BODY[1])),
    "a link alone in the text": (f"<div><p>{BODY[0]}<p><a href=x>The full report is here</a><p>{BODY[1]}</div>", joined(BODY[0], "The full report is here", BODY[1])),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    source, want = LAYOUTS[layout]
    assert main_text(source) == want


def test_surge_and_dive_decide(monkeypatch):
    """On the table's own pages: without them text comes back that is none of the article's, from every page."""
    mass = np.array([0, 3, 400, 300, 2, 0, 0, 5, 500, 0], float)
    assert threshold(mass) == 100 and stretches(mass) == [(1, 5), (7, 10)] and stretches(mass[:0]) == []
    assert stretches(np.array([400, -1, 30, 0, 0], float)) == [(0, 1), (2, 3)] and stretches(np.array([-1.0, 0])) == []
    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()]
    want = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "stretches", lambda mass: [(0, len(mass))])
    assert sum(main_text(p) != w for p, w in zip(pages, want, strict=True)) > len(pages) / 2
    changed = [name for name, (source, text) in LAYOUTS.items() if main_text(source) != text]
    assert "short sentences behind a row of links" in changed


def test_elements_are_not_needed():
    """Nearly all pages give the same text when their article element is a mere division."""
    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()]
    changed = sum(main_text(p) != main_text(p.replace("<article", "<div").replace("</article>", "</div>")) for p in pages)
    assert changed < 0.02 * len(pages)


@pytest.mark.parametrize("piece", ["<a ", "<a b='", '<a ">', "<p>", "<p></b>", "<!--", "<script>", "</", "<", "<b><p></p>", "<a x=y>", "&#"])
def test_broken_pages_take_time_in_proportion(piece):
    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 15


def test_deep_pages():
    began = time.process_time()
    assert main_text("<div>" * 100_000 + "deep" + "</span>" * 100_000) == "deep"
    assert time.process_time() - began < 15


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "v", "<p>é</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, main_texts(df).collect()), key=repr) == sorted([(1, "u", "", 0), (1, None, "", 0), (None, "v", "é", 1)], key=repr)
    assert main_texts(df.limit(0)).count() == 0
