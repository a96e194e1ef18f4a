"""Blocks that are hidden, and those that only have the word in an attribute."""

from __future__ import annotations

import pytest

from plumbline.llm.html_blocks import leaf_blocks

SHOWN = [
    'style="overflow:hidden"', 'style="visibility:hidden"', 'title="The hidden valley"', 'data-title="Hidden gems"',
    'class="hidden md:block"', "data-hidden", 'aria-hidden="false"', 'title="display:none"', 'style="--display:none"',
    'style="display:none; display:block"', 'title="the hidden',
]
NOT_SHOWN = [
    "hidden", 'hidden=""', "HIDDEN=hidden", 'title="a" hidden', "class=x hidden /", 'aria-hidden="true"', "aria-hidden=true",
    "style=display:none", "style='color:red; display : none'", 'style="display:none !important"',
]


@pytest.mark.parametrize("tag", ["body", "div", "article", "p"])
@pytest.mark.parametrize("attributes", SHOWN)
def test_the_word_in_a_value_hides_nothing(tag, attributes):
    assert [b.text for b in leaf_blocks(f"<{tag} {attributes}>some text</{tag}>after")] == ["some text", "after"]


@pytest.mark.parametrize("attributes", NOT_SHOWN)
def test_hidden_elements_go(attributes):
    assert [b.text for b in leaf_blocks(f"<div {attributes}>no<p>no</div>after")] == ["after"]


def test_a_formula_is_part_of_its_sentence():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>"
    assert [b.text for b in leaf_blocks(page)] == ["Let x=2 hold."]
