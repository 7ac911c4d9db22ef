"""Main text: the articles of the given pages by a plain parse, hand-made layouts, broken and hostile pages."""
import html
import re
import time

import pytest

from lotwise.llm import html_text as H
from lotwise.llm.common import table

LONG = "A paragraph of the article that goes on for long enough to be seen as a surge of text by any measure."


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(text for text in (" ".join(html.unescape(b).split()) for b in blocks) if text)


def test_given_pages(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages")
    pages = {r.page_id: r for r in rows.collect()}
    got = H.extract(rows).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_page_without_named_article():
    page = (f'<body><div id="siteHeader">My site</div><ul><li><a href="/">Home page and all of its many links to other places that are long</a></li></ul>'
            f'<div class="content"><h1>Head</h1><p>{LONG}<br>Second&nbsp;&amp; line</p><div class="ad-box">{LONG}</div><p>Short end.</p></div>'
            f'<div class="comments"><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div><form><p>{LONG}</p></form><footer>{LONG}</footer>')
    assert H.main_text(page) == f"Head\n{LONG} Second & line\nShort end."


@pytest.mark.parametrize("page,want", [
    (f"<div class='with-sidebar'><main><header><h1>T</h1></header><p>a <b>b</b>\n c</p><aside>no</aside><p>d</p><section id=comments><article>no</article></section></main></div>", "T\na b c\nd"),
    (f"<aside><article>related</article></aside><article><p>x</p><div class=cookieNotice>no</div><ul><li>1<li>2</ul></article>", "x\n1\n2"),
    ("<article><p>one<p>two<div hidden>no</div><p>3 &lt; 4 &#8364;</article>tail", "one\ntwo\n3 < 4 €"),
    ("<p>if a < b and c > d</p>", "if a < b and c > d"),
    ("just text", "just text"), ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<script>var a='<p>x</p>'", ""), ("<!-- open", ""), ("<p>x<!-- open", "x"),
])
def test_layouts(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>t</title><body><article><p>body text</p></article></body></html>", "body text"),
    ("<head><title>t</title><style>p {}</style><article><p>body text</p></article>", "body text"),
    ("<article><head-line>one</head-line><select_x>two</select_x><p>three</p></article>", "one\ntwo\nthree"),
    ("<article><p>a<select><option>b<p>c</article>", "a\nb\nc"), ("<article><svg class=x>a<p>b<svg><text>no</text></svg>c</article>", "a\nb\nc"),
    ("<article><svg/>a<noscript><p>b</article>", "a\nb"), ("<article><object><object>no</object>no</object><p>b</article>", "b"),
    ("<article><p>a<textarea>no<p>no</article>", "a"), ("<article><p>a<SCRIPT>no</script >b</article>", "a\nb"),
    ("<p>if a < b then more", "if a < b then more"), ("plain 1 < 2 text", "plain 1 < 2 text"), ("<p>x < y <b", "x < y"),
])
def test_omitted_end_tags_and_loose_brackets(page, want):
    assert H.main_text(page) == want


def test_hostile_hidden_elements_take_linear_time():
    began = time.time()
    for piece in ("<svg>", "<svg ", "</svg ", "<select><p>", "<title>", "<script>x", "<iframe></iframe ", "<a" + "b" * 9, "<noscript></noscript>"):
        H.main_text(piece * 50_000)
    H.main_text("<" + "a" * 500_000)
    assert time.time() - began < 20


def test_hostile_pages_take_linear_time():
    began = time.time()
    for piece in ("<a '", "<", '<p title="', "<!--", "<script ", "<div>", "</div>", "<p>x", "<b class='ad'>"):
        H.main_text(piece * 50_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("page,want", [
    (f"<article><p>x</p><div class='widget-content'><p>{LONG}</p><p>more</p></div><div class=widget>Vote now</div></article>", f"x\n{LONG}\nmore"),
    ("<article><p>an <span class='alert'>urgent</span> word</p></article>", "an urgent word"),
    (f"<article><p>x</p><div class='ad widget'>{LONG}</div></article>", "x"),
    (f"<article class=card><p>Teaser</p></article><div id=story><p>{LONG}</p><p>{LONG}</p></div><p>tail</p><footer>{LONG}</footer>", f"Teaser\n{LONG}\n{LONG}\ntail"),
    (f"<article><p>{LONG}</p></article><p>{LONG}</p>", LONG),
    (f"<article><p>{LONG}</p></article><div>Call us</div><article>short</article>", f"{LONG}\nshort"),
])
def test_the_distribution_decides_inside_and_outside_of_articles(page, want):
    assert H.main_text(page) == want


def test_the_surge_decides_on_given_pages_with_a_widget(spark):
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        own = article(r.html)
        page = r.html.replace("</article>", "<div class=widget>Vote now</div></article><p>Call us today</p>")
        assert H.main_text(page) == own
        assert H.main_text(page, surge=1) != own


def test_deep_pages_take_linear_time():
    began = time.time()
    for opened, closed in (("<div>", "</section>"), ("<div>", "</div>"), ("<li><div><b class=ad>", "<li></li>"), ("<div><p>", "</li>"), ("<b class=ad>", "<dt></dt>")):
        H.main_text(opened * 50_000 + closed * 50_000)
        H.main_text("<li><div>" + opened * 50_000 + closed * 50_000)
    assert time.time() - began < 20


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None, 5), (None, "u", "<main>x</main>", 6), (None, "u", "<main>x</main>", 6), (2, "v", "<main>" + "word " * 400_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = H.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 1_999_999), ("None", 1), ("None", 1)]
    assert H.extract(df.limit(0)).count() == 0
