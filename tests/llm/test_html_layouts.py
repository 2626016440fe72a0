"""Main text on layouts that the labelled table does not hold, and on hostile markup."""

import time

import pytest

from formloom.llm import html_extraction

ROAD = "the old road ran along the river and past the mill to the market where people sold bread and cheese".split()


def w(n, k=0):
    """``n`` words, from the ``k``-th of a sentence on."""
    return " ".join(ROAD[(i + k) % len(ROAD)] for i in range(n)).capitalize() + "."


HELD_OUT = [
 # (html, expected blocks)
    ("<div class=content><h1>Title</h1><p>Short one.</p><p>"+w(40)+"</p><p>Yes.</p><p>"+w(15)+"</p><p>Ok.</p></div>", ["Title","Short one.",w(40),"Yes.",w(15),"Ok."]),
    ("<body><div class=content><p>"+w(40)+"</p><p>"+w(17,2)+"</p></div></body>", [w(40),w(17,2)]),
    ("<article><h2><a href=/x>Linked head</a></h2><p><a href=/y>"+w(9)+"</a></p><p>"+w(30)+"</p></article>", ["Linked head",w(9),w(30)]),
    ("<div role='alert' class='notice-box'><p>"+w(60,3)+"</p></div><article><p>"+w(20)+"</p></article>", [w(20)]),
    ("<div class='sponsored-content'><p>"+w(80,3)+"</p></div><div id=post><h1>Head</h1><p>"+w(30)+"</p><p>So.</p></div>", ["Head",w(30),"So."]),
    ("<div id=nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></div><div><h1>A walk</h1><div class=s><h3>One</h3><p>"+w(50)+"</p></div><div class=s><h3>Two</h3><p>"+w(22)+"</p></div><div class=s><p>"+w(8,4)+"</p></div></div><div>Imprint and terms</div>", ["A walk","One",w(50),"Two",w(22),w(8,4)]),
    ("<table><tr><td><a href=/>Home</a></td><td><a href=/b>Blog</a></td></tr></table><div><h2>Soup</h2><ul><li>Water</li><li>Two onions</li></ul><p>"+w(33)+"</p><ol><li>Cut.</li><li>Boil it.</li></ol><p>"+w(25,5)+"</p></div><p>All rights reserved.</p>", ["Soup","Water","Two onions",w(33),"Cut.","Boil it.",w(25,5)]),
    ("<div><a href=/>Start</a> <a href=/n>News</a></div><div>"+w(45)+"</div><div>"+w(30,4)+"</div><div><a href=/p>Privacy</a></div>", [w(45),w(30,4)]),
    ("<body><div id=wrap><div class=menu><a href=/>Home</a></div><div class=text><h1>Hats</h1><p>"+w(28)+"</p><p>Bye.</p></div><div class=footer><p>"+w(12,7)+"</p></div></div></body>", ["Hats",w(28),"Bye."]),
    ("<main><h1>Bees</h1><section><p>Hi.</p></section><section><p>"+w(50)+"</p></section></main><div>"+w(30,2)+"</div>", ["Bees","Hi.",w(50)]),
    ("<article><p>"+w(9)+"</p><footer>Filed here.</footer></article>", [w(9)]),
    ("<section id=comments><article><p>"+w(90,3)+"</p></article></section><article><h1>Note</h1><p>"+w(12)+"</p></article>", ["Note",w(12)]),
    ("<body><p>"+w(26)+"</p><p>And so on.</p><p>"+w(31,6)+"</p></body>", [w(26),"And so on.",w(31,6)]),
    ("<div style='DISPLAY: None'><p>"+w(50,1)+"</p></div><div><p>"+w(25)+"</p><p>"+w(28,3)+"</p></div>", [w(25),w(28,3)]),
    ("<header><h1>Daily News</h1></header><div id=story><h2>Flood</h2><p>"+w(38)+"</p><blockquote><p>We saw it.</p></blockquote><p>"+w(20,9)+"</p></div><aside><p>"+w(33,2)+"</p></aside>", ["Flood",w(38),"We saw it.",w(20,9)]),
    ("<article><p>"+w(14)+"</p></article><div><h4>More</h4><p>"+w(35,2)+"</p><p>"+w(28,6)+"</p><p>"+w(9,3)+"</p></div>", [w(14)]),
    ("<body><div id=main-col><h1>Trees</h1><div><p>"+w(30)+"</p></div><div><p>"+w(25,3)+"</p></div><p>End.</p></div><div id=foot><p>"+w(11)+"</p></div></body>", ["Trees",w(30),w(25,3),"End."]),
]


@pytest.fixture(scope="module")
def tree():
    return html_extraction.grow(*html_extraction.labelled_blocks())


@pytest.mark.parametrize(("page", "want"), HELD_OUT, ids=range(len(HELD_OUT)))
def test_held_out_layouts(tree, page, want):
    assert html_extraction.main_text(page, tree).split("\n\n") == want


def test_labelled_table_is_learned(tree):
    x, y = html_extraction.labelled_blocks()
    assert sum((html_extraction.score(tree, r) >= 0.5) == bool(v) for r, v in zip(x, y, strict=True)) >= 0.99 * len(y)


def test_tokens():
    page = "<p class=\"a>b\" x=1 HIDDEN>Hi &amp; <b>yo</b><br/><!-- c --> 3 < 4 <script>var a='<p>';</SCRIPT >end<a href=/x/>l</a></><?x?></ y>z<scr"
    assert [t[:2] for t in html_extraction.tokens(page)] == [
        ("start", "p"), ("text", "Hi & "), ("start", "b"), ("text", "yo"), ("end", "b"), ("start", "br"), ("end", "br"), ("text", " 3 "),
        ("text", "<"), ("text", " 4 "), ("start", "script"), ("text", "var a='<p>';"), ("end", "script"), ("text", "end"), ("start", "a"),
        ("text", "l"), ("end", "a"), ("text", "z"),
    ]
    assert html_extraction.attributes(" class=\"a>b\" x=1 HIDDEN y='&lt;' z=\"u") == [
        ("class", "a>b"), ("x", "1"), ("hidden", ""), ("y", "<"), ("z", '"u'),
    ]
    assert [t[:2] for t in html_extraction.tokens("a<!--b")] == [("text", "a")]
    assert [t[:2] for t in html_extraction.tokens("a<!-->b<!doctype html>c")] == [("text", "a"), ("text", "b"), ("text", "c")]


@pytest.mark.parametrize("piece", [
    "<a ", "<!--", "<div>", "<div></span></section>", "&", "<a x=\"", "<a x='", "<", "</", "<script>", "<title>", "<p>", "<svg>", "<a href=\"x\" ",
    "<div><p></div>", "<li><ul>", "&lt", "=\"<a =", "<h1>x", "<article>x", "<main><div class=ad><article>x",
])
def test_broken_markup_takes_linear_time(tree, piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    html_extraction.main_text(page, tree)
    assert time.perf_counter() - start < 30  # a square of a million steps takes hours
