"""Attributes of elements: names only where names stand."""

from html.parser import HTMLParser

import pytest

from velum.llm import templates

KEPT = [
    '<p title="a hidden gem">Two.</p>', '<p data-kind="an id=comments b">Two.</p>', "<p data-x=' class=ads ' >Two.</p>", '<p data-topic="hidden history" lang=en>Two.</p>', "<p alt=\"role='menu'\">Two.</p>", "<p data-hidden>Two.</p>",
    '<p data-a="x"data-b="hidden">Two.</p>', "<p title=hidden>Two.</p>", "<p hiddenness=1 my-class=ads>Two.</p>", '<p title="class=&quot;ads&quot;">Two.</p>', '<p class="adsx" class="ads">Two.</p>', "<p title = 'a > b hidden c'>Two.</p>",
]
GONE = ["<p hidden>Two.</p>", '<p HIDDEN="">Two.</p>', '<p data-a="x" hidden=until-found>Two.</p>', "<div/hidden>Two.</div>", '<div class="x ads">Two.</div>', "<div ID=comments>Two.</div>", '<p\nrole = "menu">Two.</p>', '<div class="&#97;ds">Two.</div>']


@pytest.mark.parametrize(("html", "kept"), [(h, True) for h in KEPT] + [(h, False) for h in GONE])
def test_attributes_inside_values_are_no_attributes(html, kept):
    page = f"<html><body><article><p>One, which is longer than the other.</p>{html}<p>Three.</p></article></body></html>"
    got = templates.main_text(templates.parse(page), frozenset()).split("\n")
    assert got == ["One, which is longer than the other.", *(["Two."] if kept else []), "Three."]


def test_the_content_element_keeps_its_text():
    page = '<html><body><article data-topic="hidden history" title="id=comments class=ads"><p>One.</p></article></body></html>'
    assert templates.main_text(templates.parse(page), frozenset()) == "One."


@pytest.mark.parametrize("html", [*KEPT, *GONE])
def test_attributes_equal_the_standard_parser(html):
    found = []
    parser = HTMLParser()
    parser.handle_starttag = lambda tag, attrs: found.append(attrs)
    parser.feed(html)
    want = {}
    for name, value in found[0]:
        if name in templates.READ:
            want.setdefault(name, value or "")
    node = next(c for c in templates.parse(html).children if not isinstance(c, str))
    assert node.attrs == want


def test_very_long_pages_are_read_whole():
    words = "word " * 300_000
    page = f'<html><body><nav>Menu</nav><article><p title="{"hidden " * 50_000}">{words}</p><p>End.</p></article></body></html>'
    assert templates.main_text(templates.parse(page), frozenset()) == f"{words.strip()}\nEnd."
