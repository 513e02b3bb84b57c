"""Elements without an end tag, empty ones and fallback content lose no text of the page."""

import pytest

from lexiphyte.llm import html_text


def texts(page):
    return [b.text for b in html_text.blocks(page)]


@pytest.mark.parametrize("tag", "svg math button select object noscript video audio canvas template iframe textarea title".split())
@pytest.mark.parametrize("opening", ["<{}>", "<{} class=x />"])
def test_missing_end(tag, opening):
    page = f"<body><p>before</p>{opening.format(tag)}<article><p>one</p><p>two</p></article></body>"
    assert texts(page) == ["before", "one", "two"]
    if tag not in html_text._RAW:
        assert texts(page + f"<{tag}></{tag}><p>three</p>") == ["before", "one", "two", "three"]


def test_content():
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> holds</p><p>so</p>") == ["if x=2 holds", "so"]
    for tag in ("object", "noscript", "video"):
        assert texts(f"<article><p>a</p><{tag}><p>b</p></{tag}><p>c</p></article>") == ["a", "b", "c"]
    assert [tag in html_text.blocks(f"<{tag}>b</{tag}>")[0].path for tag in ("object", "noscript")] == [True, True]


def test_controls():
    assert texts("<p>a<button><div>u</div><b>v</b></button>w<select><option>x<option>y</select><p>z") == ["a", "w", "z"]
    assert texts("<div><button>menu</div><p>a</p><button>u</button><p>b</p>") == ["menu", "a", "b"]
    assert texts("<button>menu<p>a</p><select><option>u</select><p>b</p></button>c") == ["menu", "a", "b", "c"]
    assert texts("<p>a</p><script src=x />var b;<p>c</p>") == ["a", "var b;", "c"]
    assert texts("<p>a</p><script>var b='<p>'") == ["a"]
