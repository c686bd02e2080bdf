"""Names of layout classes don't empty a page, reader comments stay out, and broken mark-up takes linear time."""

import time

import pytest

from labelmill.llm import html_text

PROSE = "The river ran by the old mill and the people of the town were in the fields for most of the day, as it was the time of the harvest. "
COMMENT = "I was in that town for a week and the people were the best of all that I have met in the whole of my life, as I said to them. "


@pytest.mark.parametrize("page", [
    '<div class="content no-sidebar"><p>{0}</p><p>{0}</p></div>',
    '<div class="has-sidebar"><main><p>{0}</p><p>{0}</p></main><div class="sidebar">Most read</div></div>',
    '<section class="post-social-history"><p>{0}</p><p>{0}</p></section>',
    '<div class="tags-page"><article><p>{0}</p><p>{0}</p></article></div>',
])
def test_layout_names(page):
    text = PROSE * 2
    assert html_text.main_text(page.format(text)) == "\n".join([text.strip()] * 2)


def test_names_still_count():
    article = f"<article><p>{PROSE * 2}</p></article>"
    for name in ("sidebar", "related-posts", "comments", "newsletter"):
        assert html_text.main_text(f'{article}<div class="{name}"><p>{PROSE * 6}</p></div>') == (PROSE * 2).strip()
    assert html_text.main_text(f'<div class="ad">{PROSE}</div><article><h1>Short title.</h1><p>Short text.</p></article>') == "Short title.\nShort text."
    page = f'<div class="no-sidebar"><p>{PROSE * 2}</p><div class="comments"><p>{COMMENT * 9}</p></div></div>'
    assert html_text.main_text(page) == (PROSE * 2).strip()
    assert html_text.main_text(f'<div class="comments"><p>{COMMENT * 9}</p></div>') == ""


@pytest.mark.parametrize("junk", ["<p ", '<a "', "<a '\"", "</x ", "<!-", "<", "<div class=a>", "</b>", "<li>", "<p>", "<ul><li>x", "<i>y", "<div class=menu>z"])
def test_broken_markup_is_linear(junk):
    times = []
    for size in (100_000, 400_000):
        page = f"<article><p>{PROSE * 2}</p>" + junk * (size // len(junk))
        started = time.perf_counter()
        assert html_text.main_text(page).startswith(PROSE.strip())
        times.append(time.perf_counter() - started)
    assert times[1] < max(2.0, 10 * times[0])
