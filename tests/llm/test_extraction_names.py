import pytest

from seriesmill.llm.extraction import main_text

P = [f"Several plain words that make up a paragraph of the story, number {i}, with enough text to count." for i in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in P)


@pytest.mark.parametrize("mark", ['class="content has-sidebar"', 'id="page" class="social-enabled"', 'class="main no-comments"', 'class="sidebar"', 'class="widget"'])
def test_wrappers_keep_their_article(mark):
    for inner in (STORY, f"<div>{STORY}</div>", f"<article>{STORY}</article>"):
        page = f'<body><div class="ad">Buy a thing now.</div><div {mark}>{inner}<div class="comments"><p>Reader says a word.</p></div></div></body>'
        assert [line for line in main_text(page).split("\n") if line in P] == P
        assert "Buy" not in main_text(page) and "Reader" not in main_text(page)


def test_text_inside_articles_stays():
    page = f'<article>{STORY}<pre>x = 1 <span class="hljs-comment">note</span></pre><p class="notice">Mind this.</p><div class="related-work">Others did so.</div><div class="comments">Reader</div></article>'
    assert main_text(page).split("\n") == [*P, "x = 1 note", "Mind this.", "Others did so."]
