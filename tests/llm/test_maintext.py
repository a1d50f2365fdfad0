"""Main texts of the given pages against a plain reading of their article, and of other kinds of pages."""

import html
import re
import time

import pytest

from tidewatch.llm import maintext, queries

SF = "/root/testdata/sf0.01"


def plain(page):
    article = re.search("<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_op13_given_pages(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_main_text(spark, SF).collect()
    assert len(got) == len(want) and {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


PAGES = [
    # unmarked: the innermost element with most content, with its heading and short blocks
    ('<body><div class="x1"><a href=1>Home</a><a href=2>About</a></div><div class="x2"><h1>Title here</h1><p>First long paragraph, with commas, and more words than most.</p><p>Of.</p><ul><li>one item</li><li>two items</li></ul></div><div class="comments"><p>I do not agree, at all, with anything in this long comment, sorry. Really, not.</p></div><div class=cookie-notice>We use cookies, ok?</div><footer>x</footer></body>', "Title here\n\nFirst long paragraph, with commas, and more words than most.\n\nOf.\n\none item\n\ntwo items"),
    # marked, with implied ends, a form, an aside, and comments that are articles too
    ('<html><body class="has-sidebar"><header><h2>Site</h2></header><main><article class="post"><header><h1>T</h1></header><p>Body text, one.<br>Line two.</p><form><input><button>Go</button></form><aside>side</aside><table><tr><td>a<td>b<tr><td>c</table></article><section id="comments"><article class="comment"><p>Long comment, long comment, long comment, long comment.</p></article></section></main><div class="sidebar"><p>Some sidebar text, ok.</p></div></body></html>', "T\n\nBody text, one. Line two.\n\na\n\nb\n\nc"),
    # content in two elements of one kind beside a heading
    ("<div id=wrap><h1>Head</h1><div class=txt><p>Para one is here, with text.</p></div><div class=txt><p>Para two is here, with text.</p></div><div class='related'><a>r1</a></div></div>", "Head\n\nPara one is here, with text.\n\nPara two is here, with text."),
    # a list of short links in the article is a menu; an advert and a script between paragraphs go
    ("<article><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>Text of some length, with <a>a link</a> in it.</p><div class='ad'>Buy, now!</div><script>if (a<b) '</p>'</script><p>More text of some length, with marks.</p></article>", "Text of some length, with a link in it.\n\nMore text of some length, with marks."),
    ("<p>a &lt;b&gt; &#233; &amp;amp; c&nbsp;d &notanentity; &copy\n <!-- gone > --> e</p>", "a <b> é &amp; c d ¬anentity; © e"),
    ("just text & more", "just text & more"),
    ("<p>cut off <b", "cut off"),
    ("<style>p{}</style><nav>menu</nav>", ""),
    ("<p>one<i>two</i> three</p><p hidden>no</p>", "onetwo three"),
    ("", ""),
    (None, ""),
]


def test_op13_kinds_of_pages(spark):
    rows = [(None if i == 3 else i, None, h, "clash") for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "clash")]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(None if i == 3 else i, None, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, "u", PAGES[0][1], len(PAGES[0][1]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("part", ["<a", "<", '<a x="', "<b>", "<!--", "<p>x", "<div>", "<script>", "<td>x", "</p>", "<a b=", "<p>word, and more. </p>"])
def test_op13_linear(part):
    began = time.time()
    maintext.main_text(part * 50_000)
    assert time.time() - began < 20


def test_op13_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(30_000)) + "</article><div class=comments><p>no</p></div>"
    assert maintext.main_text(page) == "\n\n".join(f"Paragraph {i}, of many." for i in range(30_000))
