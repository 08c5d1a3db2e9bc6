"""HTML extraction: labelled pages block by block, pages that must keep their article, time, and what neighbours decide."""

import time

from cellweave.llm import html_text

WORDS = "The council met on the evening of the third and heard from those who live beside the river about the plan for a new bridge there"


def p(n, text=WORDS):
    return " ".join((text.split() * (n // 10 + 1))[:n])


def kept(page):
    text = html_text.main_text(page, html_text.trained_tree())
    return text.split("\n\n") if text else []


#: Pages as (html, main blocks in order); the other blocks of a page are boilerplate.
PAGES = [
    (f'<div class="layout has-sidebar"><h1>A title of a page</h1><p>{p(40)}</p><p>{p(55)}</p></div>', ["A title of a page", p(40), p(55)]),
    (f'<html class="no-js cookie-ok"><body><h1>Head line</h1><p>{p(44)}</p></body></html>', ["Head line", p(44)]),
    (f'<article><h1>Search</h1><div class="search-results-explained"><p>{p(35)}</p></div></article>', ["Search", p(35)]),
    (f'<body><p class="ad">Buy it now<p>{p(41)}<p>{p(33)}</body>', [p(41), p(33)]),
    (f'<nav><a>Home</a><a>News</a></nav><div>We use cookies to make this site better for you. <a>Accept all</a> <a>Settings</a></div><article><h1>News of it</h1><p>{p(60)}</p></article><ul class="commentlist"><li>{p(70)}</li></ul>', ["News of it", p(60)]),
    (f'<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{p(120)}</p><ul><li><a>Terms</a><li><a>About us</a></ul>', [p(120)]),
    (f'<article><h1>T &amp; U</h1><p>{p(30)} <a href="x">{p(8)}</a><p>Yes.<p>{p(50)}<ul><li><a>Read this as well</a><li><a>Another one to read</a><li><a>And this</a></ul></article><footer>Contact</footer>', ["T & U", p(30) + " " + p(8), "Yes.", p(50)]),
    (f'<form id="aspnetForm"><div class="siteHeader">My site</div><main><p>{p(25)}</p><table><tr><td>{p(12)}<td>Two cells</table></main></form>', [p(25), p(12), "Two cells"]),
    (f'<article class="post"><p>{p(48)}</p></article><section id="comments"><article class="comment"><p>{p(300)}</p></article></section>', [p(48)]),
    (f'<div><div class="menu"><a>A</a><a>B</a></div><h2>Sub title</h2><p>{p(52)}</p><p hidden>{p(20)}</p><div class="newsletter-box">Sign up for our letter</div></div>', ["Sub title", p(52)]),
]


#: More pages of other makes, none of which the labelled table was made from.
HELD_OUT = [
    (f'<nav><a href="/c">Contact</a></nav><article><p>{p(50)}</p><p>{p(31)}</p></article>', [p(50), p(31)]),
    (f'<article><p>{p(33)}</p><aside><a href="/x">See this</a></aside><p>{p(50)}</p></article>', [p(33), p(50)]),
    (f'<article><h1>Below</h1><p>{p(24)}</p></article><footer><a>Legal</a></footer><div class="promo">{p(50)}</div>', ["Below", p(24)]),
    (f'<article><h1><a href="/self">A title that is a link</a></h1><p>{p(10)}</p><p>{p(46)}</p></article>', ["A title that is a link", p(10), p(46)]),
    (f'<article><h2><a href="/self">Linked</a></h2><p>{p(14)}</p><p>{p(90)}</p></article><nav><a>Next</a></nav>', ["Linked", p(14), p(90)]),
    (f'<div>This site uses cookies. <a>Learn more</a></div><h1>Bare</h1><p>{p(44)}</p><p>{p(38)}</p><div>© 2019 The site, all rights reserved</div>', ["Bare", p(44), p(38)]),
    (f'<body><table><tr><td><a>Home</a><td><a>About</a></table><center><h2>Old page</h2></center>{p(64)}<hr>{p(27)}<br><address>Copyright by me</address></body>', ["Old page", p(64), p(27)]),
    (f'<main><h1>List</h1><p>{p(26)}</p><ol><li>{p(9)}<li>{p(7)}<li>{p(12)}</ol><p>{p(40)}</p></main>', ["List", p(26), p(9), p(7), p(12), p(40)]),
    (f'<div id="nav"><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul></div><div id="content"><p>{p(36)}</p><blockquote>{p(19)}</blockquote><p>{p(58)}</p></div><div id="footer">Contact us at the desk</div>', [p(36), p(19), p(58)]),
    (f'<article><p>{p(70)}</p><h3>Read more</h3><ul><li><a>{p(5)}</a><li><a>{p(6)}</a><li><a>{p(4)}</a></ul></article>', [p(70), "Read more"]),
    (f'<div role="banner">Site name</div><div role="main"><h1>Roles</h1><p>{p(43)}</p></div><div role="complementary">{p(60)}</div>', ["Roles", p(43)]),
    (f'<section class="comments"><p>{p(80)}</p></section><article><h1>First comments</h1><p>{p(40)}</p></article>', ["First comments", p(40)]),
    (f'<h1>Poem</h1><p>{p(6)}</p><p>{p(7)}</p><p>{p(5)}</p><p>{p(8)}</p><div><a>Back</a></div><div><a>Top</a></div>', ["Poem", p(6), p(7), p(5), p(8)][:-1]),
    (f'<article><p>{p(45)}</p><div class="sponsored"><p>{p(30)}</p></div><p>{p(22)}</p><form><label>Mail</label><input></form></article>', [p(45), p(22)]),
    (f'<ul><li><a>N1</a><li><a>N2</a><li><a>N3</a></ul><h2>Guide</h2><p>{p(28)} <a>{p(6)}</a></p><p>{p(52)}</p><p>Sign up for the newsletter today</p>', ["Guide", p(28) + " " + p(6), p(52)]),
    (f'<article><h1>Short</h1><p>{p(4)}</p></article><footer>All of it</footer>', ["Short", p(4)]),
    (f'<header><h1>Site</h1><nav><a>X</a></nav></header><article><header><h1>Inner head</h1></header><p>{p(34)}</p><footer>By someone</footer></article>', ["Inner head", p(34)]),
    (f'<div class="breadcrumb"><a>A</a> / <a>B</a></div><div class="post-body"><p>{p(95)}</p><p>{p(3)}</p><p>{p(61)}</p></div><div class="related-posts"><a>{p(7)}</a></div>', [p(95), p(3), p(61)]),
]


def measured(tree):
    said = true = both = 0
    for page, want in PAGES + HELD_OUT:
        text = html_text.main_text(page, tree)
        got, left = text.split("\n\n") if text else [], list(want)
        for b in got:
            if b in left:
                left.remove(b)
                both += 1
        said, true = said + len(got), true + len(want)
    return both / said, both / true


def test_precision_and_recall_of_blocks():
    precision, recall = measured(html_text.trained_tree())
    assert precision >= 0.97 and recall >= 0.97, (precision, recall)


def test_without_densities_pages_suffer():
    """The same table without neighbours and without link densities makes worse trees."""
    assert sum(measured(html_text.trained_tree(neighbours=False))) < sum(measured(html_text.trained_tree())) - 0.01


def test_named_regions_and_places_outside_are_never_overruled():
    tree = html_text.trained_tree()
    for words in (1, 8, 40, 90):
        for links in (0.0, 40.0, 100.0):
            for before in ((0, 0.0), (50, 0.0), (3, 100.0)):
                for after in ((0, 0.0), (50, 0.0), (3, 100.0)):
                    for region, article in ((1, 1), (1, -1), (0, -1), (1, 0)):
                        assert not html_text.is_text(tree, (words, links, region, article, 0, 0, *before, *after))


def test_the_order_and_text_of_blocks():
    for page, want in PAGES:
        assert kept(page) == want


def test_neighbours_decide():
    """The same block is text beside text and none among links; a tree without neighbours takes both for the same."""
    beside = [(40, 0.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 0, 0), (50, 0.0, 0, 0, 0, 0)]
    among = [(2, 100.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 0, 0), (3, 100.0, 0, 0, 0, 0)]
    both, alone = html_text.trained_tree(), html_text.trained_tree(neighbours=False)
    features = [html_text.with_neighbours(x)[1] for x in (beside, among)]
    assert [html_text.is_text(both, f) for f in features] == [True, False]
    assert len({html_text.is_text(alone, f) for f in features}) == 1


def test_labelled_rows_are_learnt():
    tree, wrong, n = html_text.trained_tree(), 0, 0
    for page in html_text.LABELLED.strip().split("\n\n"):
        rows = html_text._numbers(page)
        for f, row in zip(html_text.with_neighbours([tuple(r[:-1]) for r in rows]), rows, strict=True):
            wrong, n = wrong + (html_text.is_text(tree, f) != bool(row[-1])), n + 1
    assert wrong <= n // 30


def test_time_goes_with_length():
    """Broken pages of a megabyte: twice the page takes about twice the time, not four times."""
    tree = html_text.trained_tree()
    for unit in ("<a b", '<a b="', "<p>", "<div><p>", "<li>", '"<', "<!--", "<table><td>", "<a href='\"x'>"):
        took = []
        for n in (1 << 18, 1 << 20):
            start = time.process_time()
            html_text.main_text(unit * (n // len(unit)), tree)
            took.append(time.process_time() - start)
        assert took[1] < 8 * took[0] + 1, (unit, took)
