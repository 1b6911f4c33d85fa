import html as escape
import re
import time

import pytest

from tidymill.llm.html_text import extract, main_text, smoothed, threshold
from tidymill.llm.registry import REGISTRY

LONG = "A long sentence of the article that says many things about one subject and goes on for a while. " * 3


def test_pages_of_many_makes():
    p = LONG.strip()
    cases = {
        "": "", "<p></p>": "", "plain words &amp; more": "plain words & more",
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>{p}<p>Short.</article><footer>c</footer>": f"Head {p} Short.",
        f"<body><div class='cookie-notice'>We use cookies</div><div id=content><h1>Head</h1><p>{p}</p><p>{p}</p><p>End.</p></div><div class=sidebar><p>{p}</p></div><div id=comments><p>{p}</p></div></body>": f"Head {p} {p} End.",
        f"<main><article><p>{p}</p><form>Name <input> {p}</form><aside>{p}</aside><section class='comments'><article>{p}</article></section></article></main>": p,
        f"<article><p><b>{p}<br><p>x&nbsp;&nbsp;y\n z<table><tr><td>1<td>2</table></article>": f"{p} x y z 1 2",
        f"<article>a<b>b</b><i>c</i> d</p></div>{p}<!-- no --><span hidden>no</span></article>": f"abc d{p}",
        f"<div><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{p}</p><p>{p}</p></div></div>": f"{p} {p}",
    }
    for page, text in cases.items():
        assert main_text(page) == text, page[:200]


def test_parts():
    assert threshold([0, 0, 0, 10, 10]) == 5 and threshold([3.0]) == 3
    assert len(smoothed([1.0] * 9)) == 9 and all(abs(v - 1) < 1e-9 for v in smoothed([1.0] * 9))


def test_query_gives_the_article(spark, sf):
    got = {r.page_id: r for r in REGISTRY["op2_html_extraction"][0](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        want = " ".join(escape.unescape(re.sub(r"</?(?:p|br|h1)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>a", "y"), (2, "u", "<div>" * 3000 + "deep", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract(df).collect()) == [("", 0), ("", 0), ("a", 1), ("deep", 4)]
    assert extract(df.limit(0)).count() == 0


def test_unmarked_regions_hold_every_content_block():
    long, short = "x" * 7 + " word" * 200, "A second paragraph of some length that ends the page. " * 2
    p, q = LONG.strip(), short.strip()
    cases = {
        f"<body><h1>Head</h1><p>{long}</p><p>{q}</p></body>": f"Head {long} {q}",
        f"<body><div><h1>Head</h1><ul><li>{long}</li><li>{q}</li></ul></div></body>": f"Head {long} {q}",
        f"<body><h1>Head</h1><div><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p></div><div><p>{p}</p></div></body>": " ".join(["Head", *[p] * 6]),
        f"<body><table><tr><td>{long}</td><td>{q}</td></tr></table></body>": f"{long} {q}",
        f"<article><p>{p}</p><p>{p}</p></article><article><p>Short one.</p><p>Two.</p></article>": f"{p} {p} Short one. Two.",
        f"<main><h1>Head</h1><article><p>{p}</p></article><p>After.</p></main><div>outside</div>": f"Head {p} After.",
        f"<article class=comment><p>{p}</p></article><article><p>{q}</p></article>": q,
    }
    for page, text in cases.items():
        assert main_text(page) == text, page[:120]


BODY = "<h1>Title here</h1><p>" + "First paragraph of the text. " * 8 + "</p><p>" + "Second one with more words. " * 8 + "</p>"
WANTED = "Title here " + " ".join(["First paragraph of the text."] * 8 + ["Second one with more words."] * 8)
SIDE = '<div class="sidebar">Side words</div>'


@pytest.mark.parametrize("page", [
    f'<body><div class="layout has-sidebar"><article>{BODY}</article>{SIDE}</div></body>',
    f'<body><div id="page" class="no-sidebar site"><main>{BODY}</main></div>{SIDE}</body>',
    f'<body><form id="aspnetForm"><nav>menu words</nav><div>{BODY}</div>{SIDE}</form></body>',
    f'<body><div class="widget wrapper"><div>{BODY}</div>{SIDE}</div><div class="comments"><p>{"my comment " * 200}</p></div></body>',
    f"<body><nav>menu <div>x<article>{BODY}</article></body>",
    f'<body><div class="promo">Buy <b>this</b> at once, it is cheap and good and far longer than a line</div><article>{BODY}</article></body>',
    f'<body><article>{BODY}<div class="comments"><article class="comment"><p>{"loud words " * 300}</p></article></div></article></body>'])
def test_wrappers_are_no_notices(page):
    assert main_text(page) == WANTED


def test_advert_longer_than_the_article():
    assert main_text('<body><div class="ad">An advert that is a good deal longer than the short page.</div><div><h1>Short</h1><p>Short text.</p></div></body>') == "Short Short text."


def test_very_long_pages():
    """Linear in length and depth: a quadratic reading would take minutes."""
    start = time.time()
    assert main_text("<div>x" * 100_000).count("x") == 100_000
    assert main_text("<li><div>" * 50_000 + "</b></i>" * 50_000 + "text") == "text"
    assert len(main_text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1
    assert time.time() - start < 60
