import re

import pytest

from seriesmill.llm import extraction
from seriesmill.llm.extraction import main_text

LONG = "Several plain words that make up a paragraph of the story, number {}, with enough text to count."
P = [LONG.format(i) for i in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in P)
NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header>{NAV}<!-- <p>comment</p> --><div class="ad">Buy a thing now.</div><div id="cookie-notice">We use cookies, do you agree with that?</div>
    <main><article><header><h1>Title &amp; more</h1></header>{STORY}<aside>Aside text here.</aside><form><label>Mail</label><input></form>
    <section class="comments"><p>Reader says a lot of words about this story.</p></section></article></main>
    <div class="sidebar"><p>Other stories are here, too.</p></div><footer>&copy; someone</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", *P]


def test_page_of_plain_divisions():
    page = f'<body><div class="menu"><a href=x>Home</a> <a href=y>About</a></div><div><div><h2>A heading</h2>{STORY}<ul><li>first item<li>second item</ul></div></div><div class=footer>end</div>'
    assert main_text(page).split("\n") == ["A heading", *P, "first item", "second item"]


def test_links_lower_a_block_that_has_no_telling_name():
    links = "".join(f'<li><a href="/{i}">Some linked headline of another story {i}</a></li>' for i in range(12))
    assert main_text(f"<body><div><ul>{links}</ul></div><div>{STORY}</div></body>").split("\n") == P


def test_blocks_and_white_space():
    page = "<article><p> a\n\t b&nbsp;c <b>bold</b>er<br>line</p>text <i>between</i> blocks<div>x<p>y</div>z &lt;p&gt; &#233;&#x4e2d;</article>"
    assert main_text(page) == "a b c bolder line\ntext between blocks\nx\ny\nz <p> é中"


def test_broken_markup():
    assert main_text("<body><article><p><b>One.<br><p>Two.</p></div></span><p>Three <a href='x>y'>link</a") .startswith("One.\nTwo.\nThree")
    assert main_text("<article><script>if (a < b) { x = '<p>'; }") == ""
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<nav>menu</nav>", "<!-- only -->", "<<<>>>", "</p></p>"])
def test_nothing_to_find(source):
    assert main_text(source) in ("", "<<<>>>", "<<>>")


def test_deep_and_long_pages_stay_linear():
    deep = "<div>" * 20000 + STORY + "</div>" * 20000
    assert main_text(deep).split("\n") == P
    assert len(main_text("<article>" + "<p>word word</p>" * 100000 + "</article>")) == 100000 * 10 - 1
    main_text("<a \"" * 3000)


def test_densities_by_hand():
    page = extraction.parse('<div>abcdefghij<a href="x">link</a></div><div>klmnopqrstuvwxyz</div>')
    density, sums = extraction.densities(page)
    assert page.chars == [30, 14, 16] and page.tags == [3, 1, 0] and page.link_chars == [4, 4, 0] and page.link_tags == [1, 1, 0]
    from math import e, log

    base = log(14 / 10 * 4 + 4 / 30 * 14 + e)
    assert density[1] == pytest.approx(14 / 1 * log(14 / 4 * 1 / 1) / log(base))
    assert sums[0] == pytest.approx(density[1] + density[2]) and sums[1] == 0


def test_query_shape(spark):
    rows = [(1, "u", f"<article>{STORY}</article>", "x"), (2, None, None, None), (2, None, None, None), (None, "v", "<p>é</p>", "y")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.id or 0), r.url or "", r.text) for r in got) == [(0, "v", "é"), (1, "u", "\n".join(P)), (2, "", ""), (2, "", "")]
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sample_pages_give_their_article(spark):
    import html

    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", row.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside)]
        assert main_text(row.html) == "\n".join(b for b in blocks if b)
