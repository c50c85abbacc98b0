import time

import pytest

from seriesmill.llm.extraction import main_text
from test_extraction_names import P, STORY


def found(page):
    return main_text(page).split("\n")


def test_a_form_around_the_page_keeps_it_and_other_forms_go():
    login = "<form action='/in'><p>Enter your name and the secret word here.</p></form>"
    for inner in (STORY, f"<article>{STORY}</article>"):
        assert found(f"<body><form id=aspnet><div class=top>{login}</div><div>{inner}</div></form></body>") == P
    assert found(f"<body>{login}<article>{STORY}{login}</article></body>") == P


def test_quotes_inside_unquoted_values_open_nothing():
    assert found(f"<body><div><p data-x=it's>{P[0]}</p><p title=5\">{P[1]}</p>" + "".join(f"<p>{p} it's</p>" for p in P[2:]) + "</div></body>") == P[:2] + [p + " it's" for p in P[2:]]
    assert found(f"<article><p title='a > b' id = \"c>d\">{P[0]}</p><p title=>{P[1]}</p></article>") == P[:2]


@pytest.mark.parametrize("name", ["comments-area", "cookie-banner", "related-posts", "share-buttons", "comments_list", "newsletter-box", "site-header", "page-footer", "main-nav"])
def test_hyphenated_marks(name):
    page = f'<body><div class="{name}"><p>Some words that do not belong here at all.</p></div><div class="content">{STORY}</div></body>'
    assert found(page) == P
    if name not in ("site-header", "page-footer", "main-nav"):
        assert found(f'<body><article>{STORY}<div class="{name}"><p>Some words that do not belong here.</p></div></article></body>') == P


def test_comments_and_adverts_inside_articles_go_whatever_element_they_are():
    odd = '<ol><li class="comment">First!</li></ol><article class="comment"><p>Second.</p></article><p class="advert">Buy.</p>'
    assert found(f"<body><article>{STORY}{odd}</article></body>") == P
    assert found(f"<body><main>{STORY}<ul><li>kept</li></ul>{odd}</main></body>") == [*P, "kept"]


@pytest.mark.parametrize(
    "piece", ["<title ", "<p a=\"", "<p a='", "</title ", "<!--", "<!", "<a b=c ", "<script>", "<i>", "</section>", "<li>", "<div></div>", "<", "&amp", "<p a=\">", "<form>"]
)
def test_broken_pages_take_linear_time(piece):
    page = "<article>" + STORY + "<ul><div><i>" + piece * (1_000_000 // len(piece))
    begin = time.perf_counter()
    text = main_text(page)
    assert time.perf_counter() - begin < 12 and text.startswith(P[0])


def test_a_megabyte_of_open_titles_is_quick():
    begin = time.perf_counter()
    main_text("<title " * 150_000)
    main_text("<p a=\"" * 150_000)
    assert time.perf_counter() - begin < 1
