import re
from html import unescape

import pytest

from tickloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><form><input value="x">Search the site for the words you want</form></header>
<nav><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></nav>
<div class="notice">We use cookies on this site and that is all there is to it, so please accept them now.</div>
<article class="post"><header><h1>A short title</h1></header>
<p>The first <b>para</b>graph of the article is long enough to be decided &amp; has   many\n words.<br>New line
<p>Short.
<ul><li>An item</li><li>Another <i>item</i></li></ul>
<script>var s = "</p><p>not text</p>";</script>
<!-- <p>hidden comment that is long enough to be decided if it were text</p> -->
<blockquote>&ldquo;Quoted&rdquo; &#233;t&eacute;</blockquote>
<p>See <a href="/x">this link</a> for more of the words that are in it.</p></article>
<section class="comments"><p>I am a reader and this is the comment that I have to make about it.</p></section>
<aside><p>Related reading that is in the side bar of the page with many words.</p></aside>
<div id="ad-1">Buy the best of the things that we have for you at a low price.</div>
<footer>&copy; all of the rights of this page are with the owners</footer></body></html>"""


def test_whole_page():
    assert html_text.main_text(PAGE) == (
        "A short title The first paragraph of the article is long enough to be decided & has many words. New line Short. An item Another item"
        " “Quoted” été See this link for more of the words that are in it."
    )


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("just text without any tag that is long enough for the rules", "just text without any tag that is long enough for the rules"),
        ("<p>unclosed <b>bold and the text that goes on to the end of it", "unclosed bold and the text that goes on to the end of it"),
        ("<script>var a = 1", ""),
        ("<!-- open comment <p>the text that is in it is not to be seen</p>", ""),
        ("<article><p>Tiny.</p></article>", "Tiny."),
        ("<nav><p>The menu of the site with all the words that are in it.</p></nav>", ""),
        ('<p title="a > b">The attribute of this element has a sign that ends tags.</p>', "The attribute of this element has a sign that ends tags."),
        ("<p>5 < 6 and the rest of it is still here &lt;p&gt; &unknown; &#x41;", "5 < 6 and the rest of it is still here <p> &unknown; A"),
        ("<div style='display: none'>This is not to be seen by the readers of it at all.</div>", ""),
        ("<p>the one that is first in the page and long</p><div class=ads>x</div><p>the two that is next in the page and long</p>", "the one that is first in the page and long the two that is next in the page and long"),
    ],
)
def test_rules(html, want):
    assert html_text.main_text(html) == want


def test_short_blocks_inherit():
    good = "<p>The text of this part is long enough to be decided by the rules that we have.</p>"
    menu = "<ul>" + "<li><a href=x>the entry of a menu</a>" * 3 + "</ul>"
    assert html_text.main_text(f"<div>{menu}<p>Tail</p>{menu}</div>") == ""
    assert html_text.main_text(f"<div>{good}<p>Tail</p>{good}</div>").count("Tail") == 1
    assert html_text.main_text(f"<div>{menu}<h2>Head</h2>{good}</div>").startswith("Head The text")


def test_long_pages_take_linear_time():
    html_text.main_text("<p>" + "word " * 200_000)
    html_text.main_text('<a b="' * 3_000)
    html_text.main_text("<" * 20_000)


def test_supplied_pages(spark):
    """The article element is the article: strip it by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.page_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        a = re.search(r"<article>(.*?)</article>", re.sub(r"<!--.*?-->", "", r["html"], flags=re.S), re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", a))).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 5), (4, "x", "<p>\U0001f600 the sign is one code point and it counts as one in here"), (5, "y", "the word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS Text", "0 AS n_chars")
    out = html_text.page_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3, None)] == ["", "", ""]
    assert next(r for r in got if r["page_id"] == 5)["n_chars"] == 899_999
    assert html_text.page_text(df.where("page_id > 9")).count() == 0


def test_unclosed_and_stray_tags_take_linear_time():
    """Unclosed controls, and closing tags of names that are not open, cost no search each."""
    import time

    for page in ("<p>text <button>" * 20_000, "<div>" * 5_000 + "word</p>" * 20_000, "<span class='ad'>x</b></i>" * 10_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 2


def test_keyword_lists_are_no_text():
    """A long block outside the article that holds no frequent word goes with its neighbours."""
    words = "casino bonus jackpot poker roulette slots vegas bingo baccarat blackjack craps keno lottery betting odds parlay spread moneyline handicap wager"
    article = "<p>The river rose in the night and the people of the town went to the bridge to see how high it was.</p>" * 3
    page = f"<html><body><nav><a href='/'>Home</a></nav><div>{words}</div><article>{article}</article><footer>Imprint</footer></body></html>"
    assert "jackpot" not in html_text.main_text(page) and html_text.main_text(page).count("bridge") == 3
