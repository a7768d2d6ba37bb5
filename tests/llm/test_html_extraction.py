"""Main text of pages: every kind of thing that is no article, broken markup, and the given pages."""

import html
import re
import time

import duckdb
import pytest

from tidelake.llm import html_extraction
from tidelake.llm.html_extraction import main_text

LONG = "This is the first long paragraph of the article, and it has quite a lot of words that are in every text that was written by a person for other people to read."
MORE = "Es ist der zweite lange Absatz, und er steht nicht für sich, sondern mit dem ersten auf einer Seite, die von dem Wetter und auch von den Leuten handelt."
LINKS = "".join(f'<li><a href="/{k}">Entry {k}</a></li>' for k in range(8))
NOISE = "This is what the readers of the page should not get in the text, and it is as long as a paragraph of the article so that only its place tells that it is not one."


@pytest.mark.parametrize("inner", [
    "<nav>{}</nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div id="left-side" role="complementary">{}</div>',
    '<div class="cookie-notice">{}</div>', '<p class="notice">{}', '<div class="ad">{}</div>', '<div class="top adSlot">{}</div>', '<span class="advert">{}<span>!</span></span>', "<form><label>{}</label></form>",
    "<script>var t = '<p>{}</p>';</script>", "<style>{}</style>", "<noscript>{}</noscript>", "<!-- {} -->", '<section id="comments"><article class="comment"><p>{}</p></article></section>', '<div class="user-comments">{}</div>',
    "<template><p>{}</p></template>", '<div style="display: none">{}</div>', "<div hidden>{}</div>", "<select><option>{}</select>", "<textarea>{}</textarea>", '<ul class="breadcrumbs"><li>{}</ul>', '<div role="dialog">{}</div>', "<iframe>{}</iframe>",
])
@pytest.mark.parametrize("frame", ["<body>{0}<h1>Title</h1><p>{1}<p>{2}</p>{0}</body>", "<body>{0}<article><h1>Title</h1><p>{1}<p>{2}</p></article>{0}", "<div>{0}<main class='has-sidebar'><h1>Title</h1><p>{1}<p>{2}</main>{0}"])
def test_what_is_no_article_goes(inner, frame):
    assert main_text(frame.format(inner.format(NOISE), LONG, MORE)) == f"Title {LONG} {MORE}"


def test_inside_an_article():
    page = f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>{NOISE}</aside><p>So.</p><ul>{LINKS}</ul><p>No words known xyz{' xyz' * 60}.</p><footer>{NOISE}</footer></article>"
    assert main_text(page) == f"Title {LONG} So. No words known xyz{' xyz' * 60}."


def test_blocks_without_marks_go_by_their_words():
    page = f"<div>{LINKS}</div><div>Zxq vbn mkl{' qwx' * 50}</div><h2>Head</h2><div>{LONG}</div><div>Short one.</div><div>{MORE}</div><div>© 2020 Firm</div><div>{LINKS}</div>"
    assert main_text(page) == f"Head {LONG} Short one. {MORE}"


def test_references_white_space_and_inline_marks():
    assert main_text("<article><p>a &lt; b &amp;amp; c &eacute;&#233;&#xe9; &copy &unknown; x<b>y</b>z\n\t <i>u</i><br>v&nbsp;w</p><p>1 < 2 > 0</p></article>") == "a < b &amp; c ééé © &unknown; xyz u v w 1 < 2 > 0"


def test_pages_with_nothing_decided():
    assert main_text("<p>Hello world</p>") == "Hello world"
    assert main_text("just text") == "just text"
    assert main_text("<article>x</article>") == "x"
    assert main_text(f"<nav>{LINKS}</nav>") == ""
    assert [main_text(x) for x in (None, "", " ", "<", "<p", "<p>", "<!--", "<script>x", "<a href='")] == ["", "", "", "<", "<p", "", "", "", "<a href='"]


def test_an_article_ends_what_was_left_open():
    assert main_text(f"<nav><ul>{LINKS}<article><p>{LONG}</article>") == LONG
    assert main_text(f"<form action='/'><main><p>{LONG}</main></form>") == LONG
    assert main_text(f'<div title="a > b" class=x><p title=\'</p>\'>{LONG}</div>') == LONG


@pytest.mark.parametrize("piece", ["<", "<a '", '<p class="', "<!-- ", "<script>", "</div>", "<div>", "<b><i>", "&", "<li><ul>", "x ", "<![CDATA["])
def test_time_follows_the_length_of_hostile_pages(piece):
    began = time.process_time()
    main_text(piece * 200_000)
    assert time.process_time() - began < 20


def test_given_pages(spark):
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        assert main_text(page) == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", article))).split())


def test_query_equals_its_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in html_extraction.op11_html_extraction(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert got == sorted(con.execute(html_extraction.ORACLES["op11_html_extraction"]).fetchall())


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}", "a", 1), (1, "u", f"<p>{LONG}", "b", 2), (None, None, None, None, None), (2, None, "", "c", 3), (3, "v", f"<article>{'<p>' + LONG * 20_000}</article>", "", 0)], "page_id int, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html_extraction.extract(pages).collect()]
    assert got == [(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (2, None, "", 0), (3, "v", LONG * 20_000, len(LONG) * 20_000)]
    assert html_extraction.extract(pages.filter("false")).count() == 0
