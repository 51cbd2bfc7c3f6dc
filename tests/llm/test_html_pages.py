"""Main text: what belongs to an article, what does not, and pages made to be slow."""

from __future__ import annotations

import time

import pytest

from lintel.llm.html_text import main_text

LINKS = "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li><li><a href=c>three</a></li></ul>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><header>Site name here</header><p>Text, of the page, is here and long enough to be one.</p></body>", "Text, of the page, is here and long enough to be one."),
        ("<article><header><h1>Title</h1></header><p>Text, a.</p></article>", "Title\nText, a."),
        (f"<article><p>Text, a.</p><p>See these:</p>{LINKS}</article>", "Text, a.\nSee these:\none\ntwo\nthree"),
        (f"<article><p>Text, a.</p>{LINKS}<p>More, text.</p></article>", "Text, a.\none\ntwo\nthree\nMore, text."),
        (f"<article>{LINKS}<p>Text, a.</p><h2>Elsewhere</h2>{LINKS}</article>", "Text, a.\nElsewhere"),
        ("<article><p>Text, a.</p><div class=side><p>Side, text.</p></div><div class='legal-text'>Legal.</div><section class=discussion><p>We discuss.</p></section></article>", "Text, a.\nSide, text.\nLegal.\nWe discuss."),
        ("<body><div class=side><p>Side, text.</p></div><div><p>Text, of the page, is here, and more, and more of it.</p></div></body>", "Text, of the page, is here, and more, and more of it."),
        ("<div class='layout has-sidebar'><div id=content><p>Hello, world, this is text.</p></div><div class=sidebar><p>no, no</p></div></div>", "Hello, world, this is text."),
        ("<form id=aspnet><div><p>Hello, world, text.</p></div></form>", "Hello, world, text."),
        ("<article><p>Text, a.</p><form><p>your mail, please</p></form></article>", "Text, a."),
        ("<article><p>x</p></article><section><article class=comment><p>nice, comment, really, nice</p></article></section>", "x"),
        ("<div><p>First paragraph, with enough text to be the one that is kept by all means, yes.</p>loose text<p>Second paragraph, with enough.</p></div>", "First paragraph, with enough text to be the one that is kept by all means, yes.\nloose text\nSecond paragraph, with enough."),
        ("<p title='a>Text</p> rest", "Text\nrest"), ('<a href="x>text</a> more', "text more"), ("a < b and c <", "a < b and c <"), ("text <a hre", "text"), ("1 <2", "1 <2"),
        *[(f"<article><p>Text, a.</p><section {name}><p>{'A full paragraph, with words. ' * 3}</p><p>{'Another one, of some length. ' * 3}</p></section></article>", f"Text, a.\n{('A full paragraph, with words. ' * 3).strip()}\n{('Another one, of some length. ' * 3).strip()}") for name in ("class=related-work", "class=social-impact", "class=share-analysis", "class=promotion-of-health", "id=comments-on-the-law")],
        *[(f"<article><p>Text, a.</p><section {name}><p>{'A full paragraph, with words. ' * 3}</p></section></article>", "Text, a.") for name in ("class=related", "class='comments-list'", "id=comment-12", "class='x newsletter_signup-box'", "class=cookie-notice", "role=complementary class=related-work")],
        ("<article><p>Text, a.</p><div class=share-this-page><a href=x>Share it</a></div></article>", "Text, a."),
        (f"<div id=content><p>{'seventy characters ' * 3}</p></div><div id=more><p>{'of more of the text ' * 3}</p></div>", f"{('seventy characters ' * 3).strip()}\n{('of more of the text ' * 3).strip()}"),
        ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
    ],
)
def test_what_belongs(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<a x" * n + '"', lambda n: "<div>" * n + "</b>" * n, lambda n: "<div><a>x</a><a>y</a><a>z</a>" * n, lambda n: "<b>" * n + "<hr>" * n,
        lambda n: "<ul><li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<b><table><td>" + "<i>" * n + "</b>" * n, lambda n: "<textarea>" * n, lambda n: "<p><td>" + "<b>" * n + "<hr>" * n,
        lambda n: "<" * n, lambda n: "<a ='" * n + '"', lambda n: "<body>" + "<p>a, b</p>" * n, lambda n: "<a =" + " " * n, lambda n: "<!x" * n, lambda n: "&amp" * n, lambda n: "<p>" + "word, " * n,
    ],
)
def test_time_is_in_proportion(page):
    seconds = []
    for n in (10_000, 80_000):
        began = time.perf_counter()
        main_text(page(n))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.02)  # 8 in proportion, 64 if quadratic
