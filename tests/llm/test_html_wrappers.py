"""Pages whose article lies in a wrapper with a marked name, self-closed drawings and formulas."""

import pytest

from panelforge.llm.html_extract import main_text

BODY = "<p>The first sentence of the article, and more of it.</p><p>A second one follows, with commas, and ends.</p>"
TEXT = "The first sentence of the article, and more of it. A second one follows, with commas, and ends."


@pytest.mark.parametrize("name", ["content has-sidebar", "hasSidebar", "with-sidebar", "social", "related", "promoted"])
def test_article_in_a_marked_wrapper(name):
    assert main_text(f"<body><div class='{name}'><article>{BODY}</article></div><footer>Contact us.</footer></body>") == TEXT


def test_marked_parts_stay_out():
    card = "<p>Another story, told in short, for those who like it.</p>"
    assert main_text(f"<body><article>{BODY}</article><div class='related'><article>{card}</article></div></body>") == TEXT
    assert main_text(f"<body><div class='social'><article>{BODY}<div class='comments'>{card}</div></article></div></body>") == TEXT
    assert main_text(f"<body><div class='related'><article class='comment'>{card}</article></div></body>") == ""
    assert main_text(f"<body><aside><article>{card}</article></aside></body>") == ""


def test_self_closed_drawing_swallows_nothing():
    assert main_text(f"<body><article><svg class='a/b' width='1'/>{BODY}<svg><path d='x'/><text>no</text></svg></article></body>") == TEXT


def test_formula_text_stays():
    page = f"<body><article>{BODY}<p>It holds that <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='tex'>x=2</annotation></semantics></math> here.</p></article></body>"
    assert main_text(page) == TEXT + " It holds that x=2 here."
