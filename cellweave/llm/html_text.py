"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks
before and after it, whether it is a heading, in the page's article (1), outside of it (-1) or on a page without one (0),
whether it stands in a region named as boilerplate, and whether it is short and speaks of the site and not of its matter.
The tree is grown here, by Gini impurity, on the small labelled table below: example pages, whose rows are each other's
neighbours. It asks for region and article first, so that no neighbour overrules these, and then for counts and densities,
in leaves of five rows at least.

A named region that holds the article, or most of the page's unlinked words and isn't made of comments, is a wrapper
and names nothing. Tags are scanned in one pass, in time proportional to the page; end tags that HTML leaves out are
implied. A page goes through one task as one text, so memory grows with the longest page.

Defined results: a null or empty page gives an empty text; character references are decoded; white space inside a block
becomes one space; blocks are joined by an empty line in page order; stray end tags close nothing; a script, style or
comment without an end, and a tag without its ">", reach to the page's end; repeated rows are extracted each on its
own; other columns are kept, those named like the results (text, n_chars) are replaced.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tags that end a block; tags whose content is no text; tags of boilerplate regions; tags of articles; tags
# without content; words that name boilerplate, comments, and what may follow or go before such a word in a name.
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = set("script style noscript template svg math iframe object audio video canvas head title textarea select button".split())
RAW_TAGS = {"script", "style", "textarea", "title"}
REGION_TAGS = set("nav footer aside form menu dialog header".split())
ARTICLE_TAGS = {"article", "main"}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
COMMENT_WORDS = set("comment comments commentlist commentary disqus reply replies respond".split())
REGION_WORDS = COMMENT_WORDS | set(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline consent cookie cookies copyright dialog footer foot gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices notification overlay pagination popup privacy promo promotion related search share sharing sidebar sidenav signup social "
    "sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert alertdialog contentinfo complementary".split()
)
GENERIC_WORDS = set("area bar block box button buttons center container content form inner item items left links list main outer overlay panel right row section slot text top unit wrap wrapper".split())
NEGATIONS = set("has have hide is no non not show with without".split())
# A start tag implies the end of open tags of the first kind, unless one of the second was opened since.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd", "p"}, {"dl"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table"})),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
    **dict.fromkeys(BLOCK_TAGS - set("li dt dd tr td th tbody thead tfoot body head html title legend summary".split()), ({"p"}, {"td", "th", "table", "button", "object"})),
}
CELLS = {"td", "th", "caption"}

# What notices say. A block of more than NOTICE_WORDS words is none.
NOTICE = re.compile(r"\bcookies?\b|©|\bcopyright\b|all rights reserved|privacy policy|terms of (?:use|service)|\bnewsletter\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|\bfollow us\b|\bpowered by\b|\badvertisement\b", re.I)
NOTICE_WORDS = 40

#: Blocks of example pages, labelled by hand, pages apart by an empty line: words, link %, in a named region, in the
#: article, heading, 1 for main text; n behind it for a notice.
LABELLED = """
1 100 1 -1 0  0
1 100 1 -1 0  0
2 100 1 -1 0  0
1 100 1 -1 0  0
9   0 1 -1 0  0
9   0 0  1 1  1
60  0 0  1 0  1
2   0 0  1 0  1
45  7 0  1 0  1
3   0 0  1 1  1
90  2 0  1 0  1
12 10 1 -1 0  0

1 100 1 -1 0  0
3 100 1 -1 0  0
40  0 1 -1 0  0
1   0 0  1 1  1
1   0 0  1 0  1
1   0 0  1 0  1
14  0 0  1 0  1
150 0 0  1 0  1
1   0 0  1 0  1
30  0 1 -1 0  0

4 100 0 -1 0  0
16 25 0 -1 0  0
7   0 0  1 1  1
70  0 0  1 0  1
8 100 0  1 0  1
55  4 0  1 0  1
40  0 0  1 0  1
7 100 0  1 0  0
9 100 0  1 0  0
6 100 0  1 0  0
8 100 0  1 0  0
5   0 1  1 0  0
35  0 1  1 0  0
60  0 1  1 0  0
18  0 0 -1 0  0
3 100 0 -1 0  0

2 100 0  0 0  0
3 100 0  0 0  0
1 100 0  0 0  0
8   0 0  0 1  1
50  3 0  0 0  1
4   0 0  0 1  1
65  0 0  0 0  1
25  8 0  0 0  1
5   0 0  0 0  1
80  0 0  0 0  1
4 100 0  0 0  0
6 100 0  0 0  0
5  60 0  0 0  0
3 100 0  0 0  0

1 100 0  0 0  0
2 100 0  0 0  0
20 20 0  0 0  0
2 100 0  0 0  0
6   0 0  0 1  1
45  0 0  0 0  1
12  0 0  0 0  1
38  5 0  0 0  1
3 100 0  0 0  0
4   0 0  0 1  0
6 100 0  0 0  0
7 100 0  0 0  0
9  11 0  0 0  0
2 100 0  0 0  0

3   0 0  0 1  1
30  0 0  0 0  1
28  0 0  0 0  1
6   0 1  0 0  0
33  0 0  0 0  1
22  0 1  0 0  0
70  0 1  0 0  0
15  0 1  0 0  0

2 100 1 -1 0  0
6 100 0  1 1  1
45 15 0  1 0  1
2   0 0  1 1  1
30 33 0  1 0  1
1   0 0  1 0  1
12 50 0  1 0  1
4   0 0  1 0  1
25 20 0  1 0  1
14 10 1 -1 0  0
9  44 1 -1 0  0

1 100 0  0 0  0
7   0 0  0 1  1
40 20 0  0 0  1
3   0 0  0 0  1
28 30 0  0 0  1
8   0 0  0 0  1
33 12 0  0 0  1
2 100 0  0 0  0
11 27 0  0 0  0

2 100 0  0 0  0
3 100 0  0 0  0
120 0 0  0 0  1
4 100 0  0 0  0
2 100 0  0 0  0

1 100 0  0 0  0
85  6 0  0 0  1
2 100 0  0 0  0
3   0 0  0 0  0
2 100 0  0 0  0

3 100 1 -1 0  0
7 100 0  1 0  0
80  0 0  1 0  1
6 100 0  1 0  0
35 30 0  1 0  1
5 100 0  1 0  0

5 100 1  0 0  0
6   0 0  0 0  1
40  0 0  0 0  1
7 100 0  0 0  1
52  2 0  0 0  1
2   0 1  0 1  0
48  0 1  0 0  0

1 100 1 -1 0  0
1 100 1 -1 0  0
50  0 0  1 0  1
62  3 0  1 0  1
1 100 1 -1 0  0

2 100 1 -1 0  0
7 100 0  1 1  1
10  0 0  1 0  1
22  0 0  1 0  1
9 100 1 -1 0  0

5 100 0  1 1  1
12  0 0  1 0  1
8   0 0  1 0  1
15 20 0  1 0  1
6   0 1 -1 0  0

1 100 1 -1 0  0
8 100 0  1 1  1
3   0 0  1 0  1
11  0 0  1 0  1
48  0 0  1 0  1
3 100 1 -1 0  0

55  0 0  1 0  1
1 100 1  1 0  0
58  0 0  1 0  1
2 100 1  1 0  0
9   0 1  1 0  0
50  0 0  1 0  1

4   0 0  1 1  1
66  0 0  1 0  1
5 100 0  1 0  0
4 100 0  1 0  0
6 100 0  1 0  0
8 100 0  1 0  0

6   0 0  1 1  1
30  0 0  1 0  1
9 100 0  1 0  1
44  0 0  1 0  1
11 100 0  1 0  1
37  5 0  1 0  1
14  0 0 -1 0  0 n

3 100 0  1 0  0
2 100 0  1 0  0
4 100 0  1 0  0
7   0 0  1 1  1
51  0 0  1 0  1
29  0 0  1 0  1

18 15 0 -1 0  0 n
5   0 0  1 1  1
2   0 0  1 0  1
3   0 0  1 0  1
2   0 0  1 0  1
33 10 0  1 0  1
12  0 0 -1 0  0
40  0 0 -1 0  0
55  0 0 -1 0  0

1 100 0  0 0  0
2 100 0  0 0  0
17 10 0  0 0  0 n
5   0 0  0 1  1
47  0 0  0 0  1
36  4 0  0 0  1
8  12 0  0 0  0 n

14  0 0  0 0  0 n
9   0 0  0 1  1
24  0 0  0 0  1
31  0 0  0 0  1
7   0 0  0 0  0 n

2 100 0  0 0  0
2 100 0  0 0  0
6   0 0  0 1  1
11  0 0  0 0  1
9   0 0  0 0  1
60  0 0  0 0  1
12  8 0  0 0  0 n
2 100 0  0 0  0

95  2 0  0 0  1
4   0 0  0 0  1
77  0 0  0 0  1
6   0 0  0 0  1
42  9 0  0 0  1
5   0 0  0 0  0 n

3 100 0  0 0  0
1 100 0  0 0  0
4 100 0  0 0  0
15  0 0  0 0  1
20  0 0  0 0  1
18 11 0  0 0  1
2 100 0  0 0  0
3 100 0  0 0  0
10 10 0  0 0  0 n

1 100 0  0 0  0
1 100 0  0 0  0
3   0 0  0 0  0
1 100 0  0 0  0
4   0 0  0 0  0
2 100 0  0 0  0
8   0 0  0 1  1
54  0 0  0 0  1
3   0 0  0 0  0
4 100 0  0 0  0
5 100 0  0 0  0

7   0 0  0 1  1
5  40 0  0 0  0
39  0 0  0 0  1
2   0 0  0 0  1
71  3 0  0 0  1
6  83 0  0 0  0
4 100 0  0 0  0

6 100 0  0 1  1
44  0 0  0 0  1
29  7 0  0 0  1
5 100 0  0 1  1
50  0 0  0 0  1
2 100 0  0 0  0
2 100 0  0 0  0

4 100 0  0 0  0
9  78 0  0 0  0
3 100 0  0 0  0
4   0 0  0 1  1
26 30 0  0 0  1
41 12 0  0 0  1
7  57 0  0 0  0
11 64 0  0 0  0
2 100 0  0 0  0

25  0 1  0 0  0
6   0 0  0 1  1
34  0 0  0 0  1
3   0 1  0 1  0
48  0 1  0 0  0
2 100 1  0 0  0

1 100 1 -1 0  0
80  0 1 -1 0  0
7   0 0  1 1  1
1   0 0  1 0  1
9  33 0  1 0  1
28 21 0  1 0  1
66  0 1 -1 0  0
16  0 1 -1 0  0

40  0 0  1 0  1
3   0 0  1 1  1
7  43 0  1 0  1
6  50 0  1 0  1
8  38 0  1 0  1
50  0 0  1 0  1
6 100 0  1 0  0
5 100 0  1 0  0

3 100 0  0 0  0
6 100 0  0 0  0
8 100 0  0 0  0
7 100 0  0 0  0
4   0 0  0 1  0
6 100 0  0 0  0
9 100 0  0 0  0
5   0 0  0 0  0 n

2 100 0  0 0  0
1 100 0  0 0  0
88  0 0  0 0  1
64  3 0  0 0  1
2 100 0  0 0  0

1 100 0  0 0  0
3 100 0  0 0  0
53  0 0  0 0  1
49  6 0  0 0  1
16 12 0  0 0  0 n

2 100 0  0 0  0
4  60 0  0 0  0
110 0 0  0 0  1
1 100 0  0 0  0
75  0 0  0 0  1
1 100 0  0 0  0
1 100 0  0 0  0
"""
#: Page, place and label of the features in the order of a tree's questions.
FEATURES = ("words", "links", "region", "article", "heading", "notice", "words before", "links before", "words after", "links after")

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?/])")
_STOP = re.compile(r"""=\s*+["']|>""")
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MAIN_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?(?:main|article)["']?(?:\s|$)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW_TAGS}


FIRST = (FEATURES.index("region"), FEATURES.index("article"))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 5) -> tuple:
    """A binary tree: (feature, threshold, tree of rows up to it, tree of the others), or (share of ones,). The features of
    FIRST are asked for as long as rows differ in them."""
    share = y.mean()
    if depth == 0 or share in (0, 1):
        return (float(share),)
    best = None
    open_ = [f for f in FIRST if len(np.unique(x[:, f])) > 1]
    for f in open_[:1] or range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            n = left.sum()
            if min(n, len(y) - n) < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None:
        return (float(share),)
    _, f, t, left = best
    return (f, t, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def _numbers(table: str) -> list[list[float]]:
    """Features without neighbours, then the label, of each line."""
    rows = [line.split() for line in table.strip().splitlines()]
    return [[*map(float, r[:5]), float(r[6:] == ["n"]), float(r[5])] for r in rows]


def with_neighbours(rows: list[tuple]) -> list[tuple]:
    """rows (words, link %, ...) of a page, each with the words and link % of the one before and the one after."""
    none = (0, 0)
    return [(*row, *(rows[k - 1][:2] if k else none), *(rows[k + 1][:2] if k + 1 < len(rows) else none)) for k, row in enumerate(rows)]


def trained_tree(neighbours: bool = True) -> tuple:
    """The tree; without neighbours, one that doesn't know them."""
    x, y = [], []
    for page in LABELLED.strip().split("\n\n"):
        rows = _numbers(page)
        x += with_neighbours([tuple(r[:-1]) for r in rows])
        y += [r[-1] for r in rows]
    x = np.array(x)
    return grow(x if neighbours else np.where(np.arange(x.shape[1]) < 6, x, 0), np.array(y))


def is_text(tree: tuple, features: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


@functools.lru_cache(1 << 12)
def named(mark: str) -> tuple[bool, bool]:
    """Whether a class, id or role names boilerplate, and comments: by its last word, or by its first before generic words."""
    for name in mark.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        if not words or words[0] in NEGATIONS:
            continue
        word = words[-1] if words[-1] in REGION_WORDS else words[0] if words[0] in REGION_WORDS and set(words[1:]) <= GENERIC_WORDS else None
        if word:
            return True, bool(COMMENT_WORDS & set(words))
    return False, False


def tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, first place after the tag). A quote after "=" goes to its twin, if there is one."""
    while m := _STOP.search(page, at):
        quote = page[m.end() - 1]
        if quote == ">":
            return m.start(), m.end()
        at = m.end()
        if at <= last[quote]:
            at = page.index(quote, at) + 1
    return len(page), len(page)


class _Open:
    """An open element, with what holds for its text."""

    __slots__ = ("article", "heading", "link", "region", "silent", "tag")

    def __init__(self, tag: str, above: _Open | None):
        self.tag = tag
        self.article, self.region, self.silent, self.link, self.heading = (above.article, above.region, above.silent, above.link, above.heading) if above else (False, -1, False, False, False)


def blocks(page: str) -> list[tuple[str, int, float, int, int, int, int]]:
    """(text, words, link %, in a named region, in the article, heading, notice) of each block with text, in page order."""
    found: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    opened: list[_Open] = []
    places: dict[str, list[int]] = {}  # where tags stand in opened
    regions: list[list] = []  # of each named region: the one around it, by a tag's own name, comments, holds the article, unlinked words
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}

    def top(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(k: int) -> None:
        for e in opened[k:]:
            places[e.tag].pop()
        del opened[k:]

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                words, linked = text.count(" ") + 1, sum(len(p.split()) for p, inside in parts if inside)
                own = opened[-1] if opened else _Open("", None)
                linked = min(words, linked)
                if own.region >= 0:
                    regions[own.region][4] += words - linked
                found.append((text, words, 100.0 * linked / words, own.region, own.article, own.heading))
            parts.clear()

    while at < n:
        k = page.find("<", at)
        k = n if k < 0 else k
        if k > at:
            if not (opened and opened[-1].silent):
                parts.append((html_module.unescape(page[at:k]), bool(opened) and opened[-1].link))
            at = k
            continue
        m = _TAG.match(page, at)
        if not m:
            if not (opened and opened[-1].silent):
                parts.append(("<", opened[-1].link if opened else False))
            at += 1
            continue
        if m[3]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if not m[2]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        tag, first = m[2].lower(), m.end()
        stop, at = tag_end(page, first, last)
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            parts.append((" ", False))
        if m[1]:
            k = top((tag,))
            if k >= 0 and (tag in CELLS or tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or k > top(CELLS)):
                close(k)
            continue
        if tag in VOID_TAGS:
            continue
        if tag in IMPLIED:
            ends, unless = IMPLIED[tag]
            k = top(ends)
            if k >= 0 and k > top(unless):
                if tag in ("tr", "li", "dt", "dd"):  # the outermost of them inside the list or row
                    k = min(places[t][-1] for t in ends if places.get(t) and places[t][-1] > top(unless))
                close(k)
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            at = tag_end(page, end.end(), last)[1] if end else n
            continue
        attributes = page[first:stop]
        if attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in ("a", "span"):
            continue
        own = _Open(tag, opened[-1] if opened else None)
        marks = [named("".join(x)) for x in _MARKS.findall(attributes)] if attributes else ()
        by_mark, comments = any(x for x, _ in marks), any(x for _, x in marks)
        if (tag in ARTICLE_TAGS or attributes and _MAIN_ROLE.search(attributes)) and not comments:
            own.article = True
            if own.region >= 0:
                regions[own.region][3] = True
        by_tag = tag in REGION_TAGS and not (tag == "header" and own.article)
        if by_tag or by_mark and (comments or tag not in ARTICLE_TAGS) and tag not in ("html", "body"):
            regions.append([own.region, by_tag, comments, False, 0])
            own.region = len(regions) - 1
        if tag == "h1" and own.region >= 0 and not regions[own.region][1]:
            regions[own.region][3] = True
        own.link = own.link or tag == "a"
        own.heading = own.heading or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        own.silent = own.silent or tag in SILENT_TAGS or bool(attributes and _HIDDEN.search(attributes))
        places.setdefault(tag, []).append(len(opened))
        opened.append(own)
    flush()
    plain = sum(words * (100 - links) / 100 for _, words, links, *_ in found)
    for k in range(len(regions) - 1, -1, -1):
        around, _, _, holds, words = regions[k]
        if around >= 0:
            regions[around][3] = regions[around][3] or holds
            regions[around][4] += words
    names: list[bool] = []
    for around, by_tag, comments, holds, words in regions:
        wrapper = holds or not comments and not by_tag and 2 * words > plain
        names.append(not wrapper or around >= 0 and names[around])
    has_article = any(article and not (region >= 0 and names[region]) for _, _, _, region, article, _ in found)
    return [(text, words, links, int(region >= 0 and names[region]), (1 if article else -1) if has_article else 0, int(heading), int(words <= NOTICE_WORDS and bool(NOTICE.search(text)))) for text, words, links, region, article, heading in found]


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(b[0] for b, features in zip(found, with_neighbours([b[1:] for b in found]), strict=True) if is_text(tree, features))


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points of the text) in place of html."""
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = T.StructType([*(pages.schema[n] for n in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained_tree()
        for b in batches:
            texts = [main_text(x.as_py(), tree) for x in b.column(b.schema.get_field_index("html"))]
            own = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*names, "html").mapInArrow(run, schema)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


SQL: dict[str, str] = {}
