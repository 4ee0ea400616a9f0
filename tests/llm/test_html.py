"""Main text against the articles that the pages were made from."""

import html as entities
import re

import numpy as np
import pytest
from conftest import SF

import __spark_entry__ as entry
from faultmatch.llm import html


def article(page):
    """A plain reading of the given pages: the article's blocks, tags taken off."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not found:
        return ""
    blocks = re.split(r"</?(?:p|h1|br|li|ul)[^>]*>", found[1])
    blocks = [" ".join(entities.unescape(re.sub(r"</?[ba][^>]*>", "", b)).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_query(spark, given):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in entry.queries()["op1_html_text"](spark, SF).collect()}
    want = {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in given("pages")}
    assert got == want


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("<p>x", "x"), ("just text", "just text"), ("<!-- x <p>a", ""), ("t<br/>u", "t u"),
    ("<body><nav>a b c</nav><p>Hello <b>wor</b>ld &amp; you</p><p>x</p><div id='comments'><p>a long reader's comment</p></div></body>", "Hello world & you x"),
    ("<body class='has-sidebar'><header><h1>Site</h1></header><div class='content'><h1>T</h1><p>some long text here.</p><form>q</form><p>b</p></div>"
     "<div class='sidebar'>side side side side</div></body>", "T some long text here. b"),
    ("<main><article><header><h1>Title</h1></header><p>one&nbsp;two</p><aside>x</aside><table><tr><td>a<td>b</table></article>"
     "<section class='comments'><article>first comment</article></section></main>", "Title one two a b"),
    ("<div class='cookie-notice'>We use cookies to serve you.</div><article><h1>A</h1><p>b", "A b"),
    ("<script>var t='</p>';</script><style>p{}</style><article><p>a\n\t b</p><ul><li>c<li>d</ul></article>", "a b c d"),
    ("<div hidden>no</div><p>yes</p><div style='display: none'>no</div>", "yes"),
    ("<script>var s=\"<!--\";</script><article><h1>T</h1><p>one two</p></article>", "T one two"),
    ("<p title='<!--'>one two three</p><p>four", "one two three four"),
    ("<p>one two three</p><!-- an end <p>missing", "one two three"),
])
def test_pages(page, text):
    assert html.main_text(page) == text


LONG = "<p>" + "</p><p>".join(f"This is the {n} sentence of a paragraph, and it is long enough to count." for n in ("first", "second", "third")) + "</p>"
READ = re.sub("</?p>", " ", LONG).replace("  ", " ").strip()


@pytest.mark.parametrize("page, before, after", [
    (f"<div id=content><h1>T</h1><div class=intro>short</div><div class=body>{LONG}</div><p>Last words.</p></div>", "T short", "Last words."),
    (f"<body><nav><a>Home</a></nav><h1>T</h1><div class=text>{LONG}</div><p>End.</p><footer>© us</footer></body>", "T", "End."),
    (f"<body><div class=post><div class=post-header><h1>T</h1></div><div>{LONG}</div><div class=comments><p>No!</p></div></div></body>", "T", ""),
    (f"<body><ul><li><a>Home</a><li><a>News</a></ul><h2><a>T</a></h2>{LONG}<p>Bye.</p><p>Copyright 2020 us</p></body>", "T", "Bye."),
    (f"<div class=wrap><div class=menu>a b</div><p>Lead.</p><section>{LONG}</section><div class=ad>buy</div><p>End.</p></div>", "Lead.", "End."),
    (f"<div><div class=sidebar>x</div><div>{LONG}<ul><li>a<li>b</ul></div><div class=related><p>More</p></div><p>Beyond</p></div>", "", "a b"),
    (f"<table><tr><td class=nav>n</td><td><b>T</b><br>{LONG}</td></tr></table>", "T", ""),
    (f"<div><blockquote>{LONG}</blockquote><p>So they said.</p></div>", "", "So they said."),
    (f"<body><p>By someone</p>{LONG}<form>mail</form><p>Fin.</p></body>", "By someone", "Fin."),
    (f"<div id=header>Site</div><div id=main><h1>T</h1><div><div>{LONG}</div></div><p>x</p></div><div id=footer>f</div>", "T", "x"),
    (f"<body><header>S</header><div>{LONG}</div><aside>y</aside><div>box</div></body>", "", ""),
    (f"<div class=entry><h3>T</h3><div class=entry-content>{LONG}</div><div class=share><a>Tell</a></div></div>", "T", ""),
])
def test_pages_without_an_article_element(page, before, after):
    assert html.main_text(page) == " ".join(filter(None, (before, READ, after)))


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a</p>"), (2, "v", ""), (3, "w", "<p>" + "long text " * 50000)]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in html.extract(df).collect()], key=str)
    long = ("long text " * 50000).strip()
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1), (2, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert html.extract(df.limit(0)).collect() == []


def test_smoothing_and_clusters():
    assert np.allclose(html.smoothed(np.full(7, 3.0)), 3.0)
    assert 1 < html.threshold(np.array([1.0, 1.2, 0.8, 30.0, 31.0])) < 30
