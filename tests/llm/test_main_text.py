"""Main text where a page's own articles and class names mislead."""

import pytest
from kinledger.llm import extract

LONG = " ".join(["a longer text of many words that goes on for a while and says something at last."] * 4)


@pytest.mark.parametrize(
    "page,want",
    [
        # a wrapper's class leaves the article inside alone
        (f'<nav><a>x</a></nav><div class="content with-sidebar"><article><h1>Title</h1><p>{LONG}</p></article></div>', f"Title {LONG}"),
        (f'<div class="sidebar"><article><h1>Title</h1><p>{LONG}</p></article></div>', f"Title {LONG}"),
        # names count whole
        (f'<div class="page has-comments"><p>{LONG}</p></div><div class="comment-list"><p>bad bad</p></div>', LONG),
        # the scan's bounds stay: small articles are neither the text nor its end
        (f"<article><a>read this</a></article><div><h1>Title</h1><p>{LONG}</p></div>", f"Title {LONG}"),
        (f"<div><h1>Title</h1><p>{LONG}</p><article>a small card</article><p>{LONG}</p></div>", f"Title {LONG} a small card {LONG}"),
        # an article's first lines belong to it, words beside it don't
        (f"<p>words before it</p><article><p>One.</p><br><br><br><p>{LONG}</p></article><p>words after it</p>", f"One. {LONG}"),
    ],
)
def test_the_score_decides(page, want):
    assert extract.main_text(f"<html><body>{page}</body></html>") == want


def test_bounds_are_those_of_the_run(monkeypatch):
    page = "<body><article><p>one</p><p>two</p><p>three</p></article></body>"
    at = [text for _, _, text, _ in extract.tokens(page)[0]].index("two")
    monkeypatch.setattr(extract, "best_run", lambda scores: (at, at + 1))
    assert extract.main_text(page) == "two"


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<article>", "<b><p></p>", "</x><div>", "<article></div>", "<script ", "<script", "<!", "<a href='", '<a "', "<p><b>", "<main><i>", "</article><b>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    page = unit * (1_000_000 // len(unit)) + f"<p>{LONG}</p>"
    began = time.time()
    extract.main_text(page)
    assert time.time() - began < 20
