"""Main text of pages: the test pages against their articles, and hand-made pages."""

import html
import re

from gradewell.llm import html_text
from gradewell.llm.html_text import main_text


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(found) == pages.count()
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", row["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(/?(p|h1|br)\b[^>]*)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert found[row["page_id"]]["text"] == want and found[row["page_id"]]["n_chars"] == len(want)


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>a &amp; b<p>c"), (2, "u", "  plain &eacute;\n text ")],
                                  "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "a & b c", 7), (2, "u", "plain é text", 12)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


BODY = "<p>First <b>para</b>graph, long enough to be the content of a page.</p><p>A second one follows &amp; ends.</p>"
TEXT = "First paragraph, long enough to be the content of a page. A second one follows & ends."


def test_parts_that_are_no_content():
    around = {
        "<nav><a href=/>Home</a><a href=/a>About us</a></nav>", "<header><h1>Site name</h1></header>", "<footer>Imprint</footer>",
        '<div class="ad">Buy now, buy much, buy cheap and buy again before the offer ends</div>', "<aside>Side notes of some length</aside>",
        '<div id="cookie-banner">We use cookies. <button>OK</button></div>', "<form><label>Mail</label><input><p>Send us mail</p></form>",
        "<script>var a = '<p>not text</p>';</script>", "<style>p { color: red }</style>", "<noscript>Turn scripts on</noscript>",
        '<section class="comments"><h2>Comments</h2><p>A reader writes at greater length than the article itself, which is short, '
        "and goes on and on and on about it until nobody reads on.</p></section>", '<div role="navigation">1 2 3 4</div>',
        '<div class="sidebar"><ul><li>One<li>Two</ul></div>', '<p style="display: none">Hidden words</p>', "<!-- <p>comment</p> -->",
        '<div class="relatedPosts related"><a href=x>More of this</a></div>',
    }
    for part in around:
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{part}<article>{BODY}</article>{part}</body></html>"
        assert main_text(page) == TEXT, part
        assert main_text(f"<article>{BODY}{part}</article>") == TEXT or part.startswith("<header"), part


def test_markup_forms():
    assert main_text(f"<article><header><h1>Head</h1></header>{BODY}</article>") == "Head " + TEXT
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert main_text("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>") == "a b c d"
    assert main_text("<div>in<span>li</span>ne <i>te<b>xt</i></b></div>") == "inline text"
    assert main_text("<p>a<br>b<br/>c") == "a b c"
    assert main_text("<body><p>x &lt;p&gt; &#233; &#x41; &nosuch; y") == "x <p> é A &nosuch; y"
    assert main_text("<div><p>open <div>nested</div> tail") == "open nested tail"
    assert main_text("a < b and c > d") == "a < b and c > d"


def test_pages_without_an_article_element():
    long = "A paragraph of the text that this page is about, which goes on for a while. "
    links = "".join(f"<p><a href=/{i}>L{i}</a> <a href=/x{i}>M{i}</a></p>" for i in range(8))
    page = f"<body><div class=x>{links}</div><div><h2>Title</h2><p>{long * 4}</p><p>{long * 3}</p><p>Short.</p></div><div class=y>{links}</div></body>"
    assert main_text(page) == " ".join(f"Title {long * 4} {long * 3} Short.".split())
    parts = f"<article><div><p>{long * 5}</p></div><div><p>Short part.</p></div></article>"
    assert main_text(f"<body><div>{links}</div>{parts}</body>") == " ".join(f"{long * 5} Short part.".split())
    for name in ("page-header", "main-nav", "site_footer", "post-comments", "article-sidebar"):
        assert main_text(f'<body><div class="{name}"><p>{long}</p></div><article><p>Text here.</p></article></body>') == "Text here."
    assert main_text('<article><div class="entry-header"><h1>Head</h1></div><p>Text.</p></article>') == "Head Text."


def test_all_content_lines_stay():
    long = "A paragraph of the text that this page is about, which goes on for a while. "
    links = "".join(f"<p><a href=/{i}>L{i}</a> <a href=/x{i}>M{i}</a></p>" for i in range(8))
    main = f"<div>{f'<p>{long * 4}</p>' * 24}</div>"
    lead, want = f"<div><div><p>{long * 4}</p><p>{long * 4}</p><p>Short.</p></div></div>", " ".join([long.strip()] * 96)
    first = " ".join([long.strip()] * 8) + " Short. "
    assert main_text(f"<body>{lead}{main}</body>") == first + want
    assert main_text(f"<body><div>{links}</div>{lead}{main}<div>{links}</div></body>") == first + want
    assert main_text(f"<body><p>{long * 4}</p><div>{links}</div>{main}</body>") == long * 4 + want
    page = f"<div>{links}</div><article><p>{long * 9}</p></article>{'<hr>'}<div>{links}</div><article><p>It <b>is</b> <i>so</i>.</p></article>"
    assert main_text(f"<body>{page}</body>") == long * 9 + "It is so."


def test_wrappers_stay():
    links = "<nav><a href=/>Home</a></nav>" + "".join(f"<p><a href=/{i}>L{i}</a> <a href=/x{i}>M{i}</a></p>" for i in range(3))
    side = '<div class="sidebar"><p>Beside the text.</p></div>'
    for start, end in (
        ('<div class="site-content right-sidebar">', "</div>"), ('<div class="content no-sidebar">', "</div>"),
        ('<div class="elementor-widget-container">', "</div>"), ('<section class="widget">', "</section>"),
        ('<form id="aspnetForm">', "</form>"), ('<div class="has-ads"><form><div id="page-banner">', "</div></form></div>"),
        ('<div class="content comments-open">', "</div>"),
    ):
        assert main_text(f"<body>{links}{start}<article>{BODY}</article>{side}{end}</body>") == TEXT, start
        assert main_text(f"<body>{start}<div><main>{BODY}</main></div>{end}{side}</body>") == TEXT, start
        assert main_text(f"<body>{start}<div>{BODY}</div>{side}{end}<footer>Imprint</footer></body>") == TEXT, start
    assert main_text('<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>') == "So x=2 holds."
    assert main_text("<article><p>One <button>OK</button> two.</p></article>") == "One two."


def test_parts_beside_the_text_still_go():
    more = "<p>A reader writes at greater length than the article itself, which is short, and goes on and on and on about it.</p>" * 3
    assert main_text(f'<body><div>{BODY}</div><div class="comments"><article>{more}</article></div></body>') == TEXT
    assert main_text(f'<body><article>{BODY}</article><div class="related"><article>{more}</article></div></body>') == TEXT
    assert main_text(f'<body><div class="widget"><article>{BODY}</article><div class="right-sidebar"><p>Aside.</p></div></div></body>') == TEXT
    assert main_text(f'<p>In <span class="ad">buy</span> line</p><article>{BODY}</article>') == TEXT


def test_very_long_page():
    page = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    assert main_text(page) == " ".join(["word and word"] * 20_000)


def test_smoothing_and_threshold():
    import numpy as np

    flat = html_text.smoothed(np.full(9, 5.0))
    assert np.allclose(flat, 5)
    assert 2 < html_text.threshold(np.array([1.0, 2, 1, 50, 60, 55])) < 50


LONG = "The harvest came late that year and the growers of the valley waited for rain until October, number {}."
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(12))


def paragraphs(n):
    return [LONG.format(i) for i in range(n)]


def test_link_lists_beside_paragraphs_of_the_body():
    texts = paragraphs(8)
    body = "".join(f"<p>{t}</p>" for t in texts)
    assert main_text(f"<body><div><ul>{LINKS}</ul></div>{body}</body>") == " ".join(texts)
    assert main_text(f'<body>{body}<p><a href="/">Home</a> | <a href="/a">About</a> | <a href="/c">Contact</a></p></body>') == " ".join(texts)
    middle = "".join(f"<p>{t}</p>" for t in texts[:4]) + f"<ul>{LINKS}</ul>" + "".join(f"<p>{t}</p>" for t in texts[4:])
    assert main_text(f"<body>{middle}</body>") == " ".join(texts)


def test_a_lone_link_line_between_paragraphs_stays():
    a, b, c, d = paragraphs(4)
    html = f'<body><p>{a}</p><p>{b}</p><h2><a href="#x">Harvest</a></h2><p>{c}</p><p>{d}</p></body>'
    assert main_text(html) == f"{a} {b} Harvest {c} {d}"


def test_few_lines_follow_the_same_rule():
    for n in range(1, 8):
        texts = paragraphs(n)
        body = "".join(f"<p>{t}</p>" for t in texts)
        links = '<div><a href="/">Home</a> <a href="/a">About</a></div><div><a href="/c">Contact</a></div>'
        assert main_text(f"<body><h1>Harvest</h1>{body}{links}</body>") == " ".join(["Harvest", *texts])
    assert main_text("<p>One short line.</p>") == "One short line."
    assert main_text("<p>Two lines here.</p><p>Of one kind, both.</p>") == "Two lines here. Of one kind, both."


def test_short_articles_beside_longer_named_parts():
    ad = '<div class="ad">An advert that is much longer than the article.</div>'
    notes = '<div class="comments"><p>Readers wrote more than the author did, as they often do.</p></div>'
    assert main_text(f"<body>{ad}<article><h1>News.</h1><p>News.</p></article>{notes}</body>") == "News. News."


def test_unclosed_tags_take_linear_time():
    import time

    for one in ("<div>word ", "<b>word ", "<li>word", '<div class="sidebar">word', "<b><div></b>word"):
        start = time.process_time()
        main_text(one * 10_000)
        small = time.process_time() - start
        main_text(one * 40_000)
        assert time.process_time() - start < 12 * small + 1


def test_clashing_columns_nulls_and_repeats(spark):
    rows = [(1, "u", None, "x", 5), (1, "u", None, "x", 5), (None, None, "<p>a b</p>", "y", 6), (3, "v", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a b", 3), (3, "v", "", 0)], key=repr)
