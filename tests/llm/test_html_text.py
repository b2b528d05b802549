"""Main text of pages: fixed pages and the given ones against a direct reading of their articles."""

import html
import re

from pyspark.sql import functions as F

from tracewell.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site, name.</header><nav><ul><li><a href="/a">A, b.</a><li>C</ul></nav>
<div class="ad">Buy, this. Now, please.</div>
%s
<aside>See, also. This, too.</aside><form>Name, <input> please.</form><footer>&copy; Me, 2020.</footer></body></html>"""


def test_article_only():
    article = (
        "<article><h1>Head &amp; line</h1><p>One,   two\n three. <b>bold<br>more</b><p>Four&#8212;five; six."
        '<div class="comments"><p>Nice, post.</p></div><div id="newsletter">Sign, up.</div>'
        "<ul><li>item <i>a</i></li><li>item b</ul></article>"
    )
    assert ht.main_text(PAGE % article) == "Head & line\nOne, two three. bold more\nFour—five; six.\nitem a\nitem b"


def test_without_article():
    body = '<div class="post"><h2>Head</h2><p>Long enough, and more of it. Yes.</p><p>Again, a long one; with marks.</p></div>'
    assert ht.main_text(PAGE % body) == "Head\nLong enough, and more of it. Yes.\nAgain, a long one; with marks."


def test_a_long_block_is_no_container():
    long, short = "Long, and more. " * 600, "Short, and less. " * 30
    body = f"<div><h1>Title</h1><p>{long}</p><p>{short}</p></div>"
    assert ht.main_text(PAGE % body) == "\n".join(["Title", long.strip(), short.strip()])
    body = f"<div><p>{long}</p></div><section><h2>Part</h2><p>{short}</p></section>"
    assert ht.main_text(PAGE % body) == "\n".join([long.strip(), "Part", short.strip()])
    body = f"<h1>Title</h1><div><span>{long}</span></div>"
    assert ht.main_text(PAGE % body) == "Title\n" + long.strip()


def test_short_articles_and_text_around_them_are_kept():
    long, short = "Long, and more. " * 600, "Short, and less. " * 3
    body = f"<article><h2>A</h2><p>{long}</p></article><article><h2>B</h2><p>{short}</p></article>"
    assert ht.main_text(PAGE % body) == "\n".join(["A", long.strip(), "B", short.strip()])
    body = f"<main><h1>Head</h1><p>{short}</p><article><p>{long}</p></article></main>"
    assert ht.main_text(PAGE % body) == "\n".join(["Head", short.strip(), long.strip()])
    body = f"<article><p>{long}</p></article><div><p>{long}</p></div>"
    assert ht.main_text(PAGE % body) == "\n".join([long.strip(), long.strip()])


def test_odd_markup():
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<p>  </p>") == ""
    assert ht.main_text("plain text, no tags.") == "plain text, no tags."
    assert ht.main_text("<article><p>a < b & c &lt; d <unknown>e</unknown>") == "a < b & c < d e"
    assert ht.main_text("<article><p>open <!-- never closed") == "open"
    assert ht.main_text("<article><p>x<![CDATA[y <z>]]></p></article>") == "xy <z>"
    assert ht.main_text("<article><script>let a = '<p>'</script><p title='>'>kept</article>") == "kept"
    long = "<article>" + "<p>word, and word.</p>" * 20_000 + "</article>"
    assert ht.main_text(long) == "\n".join(["word, and word."] * 20_000)


PROSE = "Long enough, and more of it. Yes; and again, a long one with marks."
KEPT = f"<h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p>"
LINES = f"Head\n{PROSE}\n{PROSE}"


def test_names_that_only_hold_a_word_are_no_reason():
    for opened in (
        "div class='content with-sidebar'",
        "article class='post no-sidebar'",
        "main class='page has-header'",
        "article class='post category-social-policy'",
        "div id=sidebar-wrapper",  # said to be a sidebar, but it holds the heading
        "section class='hasNavbar'",
    ):
        tag = opened.split()[0]
        assert ht.main_text(PAGE % f"<{opened}>{KEPT}</{tag}>") == LINES, opened
    inside = f"<article>{KEPT}<section id='related-work'><p>{PROSE}</p></section><div class='site-footer'>Me, 2020.</div></article>"
    assert ht.main_text(PAGE % inside) == f"{LINES}\n{PROSE}"
    for name in ("main-nav", "comments_list", "ad-2", "cookieNotice", "SIDEBAR left", "post share-links"):
        assert ht.main_text(PAGE % f"<article>{KEPT}<div class='{name}'><p>Not, this. Nor this.</p></div></article>") == LINES, name
    comments = "<article class='comment'><p>Nice, post. Very, nice.</p></article>" * 30
    assert ht.main_text(PAGE % f"<article>{KEPT}</article>{comments}") == LINES


def test_head_without_end():
    page = f"<html><head><title>T</title><meta charset=utf-8><body><nav><a>A</a></nav><article>{KEPT}</article></body></html>"
    assert ht.main_text(page) == LINES
    assert ht.main_text(f"<title>T</title><head><meta charset=utf-8><article>{KEPT}</article>") == LINES


def test_plain_pages():
    links = "<a href=/>Home</a> <a href=/a>About</a> <a href=/c>Contact us</a>"
    page = f"<html><body><div>{links}</div><div>{KEPT}</div><div>Copyright Me 2020</div></body></html>"
    assert ht.main_text(page) == LINES
    page = f"<body><table><tr><td><ul><li>{links}</ul></td><td>{KEPT}</td></tr><tr><td>Me 2020</td></tr></table></body>"
    assert ht.main_text(page) == LINES
    page = f"<body><div><h2><a href=/x>Head</a></h2><p>{PROSE} <a href=/y>{PROSE}</a></p><p>{PROSE}</p></div></body>"
    assert ht.main_text(page) == f"Head\n{PROSE} {PROSE}\n{PROSE}"


def test_unseen_text():
    unseen = "<div style='color:red; display: none'>Not, seen. Never.</div><p hidden>Nor, this. Never.</p>"
    assert ht.main_text(PAGE % f"<article>{KEPT}{unseen}</article>") == LINES


def article_text(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ")) if body else []
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    out = ht.extract_text(pages.withColumn("text", F.lit(1))).collect()
    assert {r.page_id: r.text for r in out} == want and len(out) == len(want)
    assert all(r.n_chars == len(r.text) for r in out)


def test_nulls_and_empty_table(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = ht.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "", 0), (1, "", 0)]
    assert ht.extract_text(pages.limit(0)).collect() == []
