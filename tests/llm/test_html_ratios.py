"""Tag-path ratios: odd pages, hostile pages, and scores against a plain second reading of the rule."""

import html.parser
import math
import re
import time

import pytest

from panelforge.llm import html_extract as H

LONG = "Here is a sentence of the text, with a comma, that goes on for a while. " * 4
SAYS = " ".join(LONG.split())


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div id='content'><p>{LONG}</p><p>{LONG}</p></div><article>A teaser.</article>", f"{SAYS} {SAYS}"),  # the ratio decides between two places
        (f"<article><h1>Title</h1><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"Title {SAYS} {SAYS}"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer>By them.</footer></article>", f"Title {SAYS}"),
        (f"<article><div class='post share-enabled'><p>{LONG}</p></div></article>", SAYS),
        (f"<article><p>{LONG}</p><section class='related-work'><p>{LONG}</p></section></article>", f"{SAYS} {SAYS}"),  # reads like the rest
        (f"<article><p>{LONG}</p><section class='related'><a>One</a><a>Two</a></section><div class='share'>Share this</div></article>", SAYS),  # does not
        (f"<article><p>{LONG}</p><p>{LONG}</p><ul><li>Tea</li><li>Milk</li></ul></article>", f"{SAYS} {SAYS} Tea Milk"),
        (f"<p>{LONG}</p><p>{LONG}</p><ul><li>Tea</li><li>Milk</li></ul>", f"{SAYS} {SAYS} Tea Milk"),
        (f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>", f"Title {SAYS} {SAYS}"),
        (f"<article><p>{LONG}</p><ul><li><a>Go here</a></li><li><a>And there</a></li><li><a>Back</a></li></ul></article>", SAYS),  # nothing but links
        (f"<article><h2><a>One</a></h2><p>{LONG}</p><h2><a>Two</a></h2><p>{LONG}</p><h2><a>Three</a></h2></article>", f"One {SAYS} Two {SAYS} Three"),
        (f"<div><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Shop</a></li></ul></div><div><p>{LONG}</p></div>", SAYS),
        (f"<article><p>{LONG} <math><mi>x</mi></math> <svg><text>no</text></svg>end</p></article>", f"{SAYS} x end"),
        (f"<article><svg><g><p>{LONG}</p></article><article><p>{LONG}</p></article>", SAYS),  # a drawing without its end
        (f"<article><p title='a > b'>{LONG}</p><p class=\"open>{LONG}</p></article>", f"{SAYS} {SAYS}"),
        (f"<article><p>1 < 2 and a<b>c</b></p><p>{LONG}</p></article>", f"1 < 2 and ac {SAYS}"),
    ],
)
def test_odd_pages(body, want):
    assert H.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>") == want


@pytest.mark.parametrize("part", ['<a "', "<!--", "<script", "<script>", "<svg>", "<a '>", "<title>", "<p class=\"a ", "</", "<div class='content'>", "&", "<textarea>", "<li>x"])
def test_time_grows_with_length(part):
    def took(n):
        began = time.perf_counter()
        H.main_text(part * n)
        return time.perf_counter() - began

    took(10)
    assert took(40_000) < 20 * took(4_000) + 0.5


class Plain(html.parser.HTMLParser):
    """Blocks of well-formed pages as (path, text, linked)."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.now, self.linked, self.a = [], [], "", 0, False
        self.feed(page)
        self.flush()

    def flush(self):
        text = " ".join(self.now.split())
        if text:
            self.blocks.append((tuple(self.stack), text, min(self.linked, len(text))))
        self.now, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.a = True
        else:
            self.flush()
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.a = False
        else:
            self.flush()
            self.stack.pop()

    def handle_data(self, data):
        self.now += data
        self.linked += len(data) if self.a else 0


def ratio(blocks):
    length = sum(len(t) - k for _, t, k in blocks) / max(len(blocks), 1)
    marks = sum(len(re.findall("[.,;:!?]", t)) for _, t, _ in blocks) / max(len(blocks), 1)
    return math.sqrt((length + 1) * (1 + marks))


def test_scores_match_a_plain_reading():
    page = f"<html><body><h1>Some title</h1><div><p>{LONG}</p><p>Short, though.</p><ul><li>One</li><li><a>Two</a></li><li><a>Three</a></li></ul></div><div><div><p>{LONG * 2}</p></div></div><section>Word</section></body></html>"
    blocks = Plain(page).blocks
    want = []
    for path, text, _ in blocks:
        same = [b for b in blocks if b[0] == path]
        score = ratio(same)
        for up in range(1, len(path) + 1):
            score = max(score, 0.7**up * ratio([b for b in blocks if b[0][: len(path) - up] == path[: len(path) - up]]))
        if len(same) >= 3 and path[-1] != "h1":
            score *= sum(len(t) - k for _, t, k in same) / sum(len(t) for _, t, _ in same)
        want.append(score)
    got = H.parsed(page)
    assert [b.text for b in got.blocks] == [t for _, t, _ in blocks]
    assert H.path_scores(got).tolist() == pytest.approx(want)


def test_very_long_page():
    assert H.main_text(f"<article>{'<p>' + LONG}" * 1 + ("<p>" + LONG) * 20_000 + "</article>") == " ".join([SAYS] * 20_001)
