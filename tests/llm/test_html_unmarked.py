"""Pages whose markup says little: menus and footers without names, articles with tables and lists, pages in one form."""

import pytest

from panelforge.llm import html_extract as H

LONG = "Here is a sentence of the text, with a comma, that goes on for a while. " * 4
SAYS = " ".join(LONG.split())


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div><a>Home</a> <a>News</a></div><p>{LONG}</p><p>{LONG}</p>", f"{SAYS} {SAYS}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div>Copyright 2020</div>", f"{SAYS} {SAYS}"),
        (f"<div><a>Home</a> | <a>News</a></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div>All rights reserved</div>", f"Title {SAYS} {SAYS}"),
        (f"<article><p>{LONG}</p><table><tr><td>1</td><td>2</td></tr><tr><td>x</td><td>y</td></tr></table></article>", f"{SAYS} 1 2 x y"),
        (f"<article><p>{LONG}</p><figure><img src=x><figcaption>A view</figcaption></figure><ul><li>one</li><li>two</li><li>three</li></ul></article>", f"{SAYS} A view one two three"),
        (f"<form action='/'><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{SAYS} {SAYS}"),
        (f"<form><article><p>{LONG}</p></article><label>Search</label></form>", SAYS),
        (f"<article><p>{LONG}</p><form><p>Your mail address please, now.</p></form></article>", SAYS),
        (f"<div><p>{LONG}</p></div><form><p>Sign up, it is free.</p><label>Mail</label></form>", SAYS),
        (f"<p>{LONG}</p><p>{LONG}</p><p><b>Short but said.</b></p>", f"{SAYS} {SAYS} Short but said."),
        ("<div>Just a line</div>", "Just a line"),
        ("<p>Only this.</p>", "Only this."),
        ("<form><input name=q></form>", ""),
    ],
)
def test_pages(body, want):
    assert H.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>") == want
