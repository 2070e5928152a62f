"""Quotes in the attributes of web pages."""

import pytest

from wherescore.llm.html import main_text

LONG = "\n".join(f"<p>paragraph {k} of it's long \"article\" with some more words in it</p>" for k in range(400))
TEXT = "\n".join(f"paragraph {k} of it's long \"article\" with some more words in it" for k in range(400))


@pytest.mark.parametrize(
    "tag",
    [
        '<img alt="the company\'s office">',
        '<a title="L\'Europe">',
        "<img alt='a 12\" screen'>",
        "<img alt='5 > 4' title=\"it's > that\">",
        '<img alt="' + "a > b " * 2_000 + '">',
        "<img alt=it's>",
        "<img alt = \"o'clock\" / >",
        "<img 'stray>",
        '<span data-x="a class=menu b">',
    ],
)
def test_quotes_in_attributes(tag):
    assert main_text(f"<body><article><p>before</p>{tag}{LONG}</article><div>after</div>") == f"before\n{TEXT}"
    assert main_text(f"<body>{tag}{LONG}") == TEXT


def test_quotes_that_never_end():
    assert main_text('<article><img alt="x><p>some text</p></article>') == "some text"
    assert main_text("<article><p>some text</p><img alt='x") == "some text"


def test_marked_elements_with_quotes():
    page = "<article><p>text</p><div title=\"it's\" class='menu'>not this</div><div ID = ads>nor this</div><p>end</p></article>"
    assert main_text(page) == "text\nend"


def test_bracket_before_another_letter_is_text():
    assert main_text("<article><p>a <é b</p></article>") == "a <é b"
