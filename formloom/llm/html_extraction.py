"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at its block-level tags.  Each block has its words and
link density, those of its neighbours, and where it stands (inside an article, inside
a container that names itself a menu, notice, form, comment ...).  A small decision
tree, grown here on the blocks of a few labelled pages, says which blocks are
main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
HIDDEN = frozenset("script style noscript template svg head title object iframe canvas audio video math".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends, where its own kind may be left open.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
#: Containers that are not main text, by tag and by the name that class, id or role gives them.
ASIDE_TAGS = frozenset("nav header footer aside form button select textarea menu dialog fieldset label".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary "
    "consent contentinfo cookie cookies copyright dialog disclaimer disqus feedback footer form gdpr header hidden "
    "login masthead menu modal nav navbar navigation navigations newsletter notice notification pagination pager popup "
    "privacy promo promotion promoted recommended related reply replies respond search share sharing sidebar sign "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar warning widget widgets".split()
)
#: Words after a name that leave its meaning as it is ("comment-list"), and words that make it one of another thing ("has-sidebar").
NEUTRAL_WORDS = frozenset(
    "area articles bar block body box button buttons card cards col column container content entry form group in info inner "
    "item items left link links list outer panel posts right row section signup slot story stories text title to top up "
    "wrap wrapper".split()
)
OTHER_WORDS = frozenset("category format has have hide no not show status tag type with without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article", "page_has_article",
    "heading", "group_words", "group_links", "group_share", "group_blocks",
)

_SPACE = r"[\t\n\r\f ]"
_NAME = r"[^\t\n\r\f />][^\t\n\r\f />=]*+"
_VALUE = rf"""{_SPACE}*+={_SPACE}*+("[^"]*+"|'[^']*+'|[^\t\n\r\f >]*+)"""
_ATTRIBUTES = re.compile(rf"({_NAME})(?:{_VALUE})?+")
#: Nothing in a tag is tried twice, so it costs its own length.
_TAG = re.compile(rf"<(/?+)([a-zA-Z][^\t\n\r\f />]*+)((?:[\t\n\r\f /]++|{_NAME}(?:{_VALUE})?+)*+)>")
_BARE_VALUE = re.compile(r"=[^\t\n\r\f \"'>]*$")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\r\f />])", re.IGNORECASE) for tag in ("script", "style")}


def attributes(given: str) -> list[tuple[str, str | None]]:
    """Names and values of a tag's attributes."""
    return [
        (name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value))
        for name, value in _ATTRIBUTES.findall(given)
    ]


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes) of a page, in one pass over it.

    Comments without an end and tags without one take the rest of the page, as browsers
    do; a ``<`` that begins no markup is text, and so is what an open script or style
    holds (it is told as text of that element).
    """
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:]), ""
            return
        if lt > at:
            yield "text", unescape(html[at:lt]), ""
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", lt):
                end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
                at = html.find(">", end) + 1 if end >= 0 else size
            else:
                at = html.find(">", lt) + 1 or size
            continue
        found = _TAG.match(html, lt) if after == "/" or after.isalpha() and after.isascii() else None
        if not found:
            if after == "/":  # nothing, or a comment
                at = html.find(">", lt) + 1 or size
            elif after.isalpha() and after.isascii():
                at = size
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        closing, tag, given = found.group(1, 2, 3)
        tag, at = tag.lower(), found.end()
        if closing:
            yield "end", tag, ""
            continue
        yield "start", tag, given
        if given.endswith("/") and not _BARE_VALUE.search(given):
            yield "end", tag, ""
        elif tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else size
            yield "text", html[at:stop], ""
            at = stop


class _Events:
    """A page's tags and texts in order, and where each hidden element ends.

    Its own end tag ends a hidden element, if no block around it ends before.  One
    without such an end hides nothing: what follows is the page, not its content.
    Only an open script or style hides all that follows; an open title goes on to the next block.
    A head is over at the first block; what else stands in it is hidden by itself.
    """

    def __init__(self, html: str) -> None:
        self.events: list[tuple[str, str, str]] = []  # kind, tag or text, attributes
        self.ends: dict[int, int] = {}  # a hidden element's start: its end
        self.open: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.body = False
        for event in tokens(html):
            if event[0] == "start":
                self.start(event[1])
            elif event[0] == "end":
                self.end(event[1])
            self.events.append(event)
        while self.open:
            tag, at = self.leave()
            if tag in ("script", "style"):
                self.ends[at] = len(self.events)

    def leave(self) -> tuple[str, int]:
        tag, at = self.open.pop()
        self.count[tag] -= 1
        if tag == "title":
            self.ends[at] = len(self.events)
        return tag, at

    def start(self, tag: str) -> None:
        if tag in BLOCKS:
            while self.open and self.open[-1][0] in ("head", "title"):
                self.leave()
            if tag == "body" and not self.body:  # ends all that the head left open
                self.body = True
                while self.open and self.open[-1][0] != "html":
                    self.leave()
        if tag not in VOID and tag != "p" and (tag in BLOCKS or tag in HIDDEN):  # p is often ended without having been opened
            self.open.append((tag, len(self.events)))
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if self.count[tag]:
            while (left := self.leave())[0] != tag:
                pass
            if tag in HIDDEN:
                self.ends[left[1]] = len(self.events)


def aside_names(attrs: list[tuple[str, str | None]], tag: str) -> set[str]:
    """The aside words that a container's class, id and role call it by: each name's last
    word, neutral words after it aside.  An article is called so by whole names only
    ("comment", "comment-body"), as its classes also tell its topics ("news-alert")."""
    names = set()
    for k, v in attrs:
        for name in v.split() if k in ("class", "id", "role") and v else ():
            words = [w.lower() for w in _WORD.findall(name.split("--")[0])]
            while len(words) > 1 and words[-1] in NEUTRAL_WORDS and words[-1] not in ASIDE_WORDS:
                words.pop()
            if words and words[-1] in ASIDE_WORDS and not OTHER_WORDS & set(words) and (tag != "article" or len(words) == 1):
                names.add(words[-1])
    return names


class _Container:
    """An open tag with what is known of it when the page has been read."""

    __slots__ = ("tag", "up", "look", "names", "hidden", "chars", "named", "aside", "article")

    def __init__(self, tag: str, up: _Container | None, given: str) -> None:
        self.tag, self.up, self.look, self.chars = tag, up, given.strip(), 0
        attrs = attributes(given) if given.strip() else []
        self.names = aside_names(attrs, tag) if tag not in ("html", "body", "main") else set()
        self.hidden = any(k == "hidden" or k == "style" and _UNSEEN.search(v) for k, v in attrs)

    def group(self) -> _Container:
        """The container that this block stands in beside its like: lists, tables and
        their parts are parts of the text around them."""
        c = self
        while c.up and c.up.tag in INNER:
            c = c.up
        return c.up or c


#: Parts of a text that hold blocks of their own.
INNER = frozenset("blockquote dd dl dt figure hgroup li ol pre table tbody td tfoot th thead tr ul".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _around(c: _Container | None) -> Iterator[_Container]:
    while c:
        yield c
        c = c.up


def _judge(containers: list[_Container], headings: list[_Container], total: int) -> None:
    """Which containers are asides and articles, by what they hold.

    A name makes no aside of a container that holds all of the page's text, or its
    subject: the longest main and article that stand in no named container (or, of
    articles, in the main); without any, the first main heading that stands in none, else
    the first main heading or article.
    ``containers``: in page order, so each after the one around it."""
    for c in reversed(containers):
        if c.up:
            c.up.chars += c.chars
    within: dict[int, bool] = {}  # whether a container or one around it is named
    for c in containers:
        within[id(c)] = bool(c.names) or bool(c.up and within[id(c.up)])
    holders: set[int] = set()

    def hold(c: _Container) -> None:
        for around in _around(c):
            if id(around) in holders:
                break
            holders.add(id(around))

    texts = [c for c in containers if c.tag in ("article", "main") and not c.names and c.chars]
    titles = [h for h in headings if h.tag == "h1"]
    for kind in ("main", "article"):
        clear = [c for c in texts if c.tag == kind and not within[id(c)]]
        # An article inside the page's main, else, is its own.
        if not clear and holders:
            mains: set[int] = set()  # the held main and what is in it
            for c in containers:
                if c.tag == "main" and id(c) in holders or c.up and id(c.up) in mains:
                    mains.add(id(c))
            clear = [c for c in texts if c.tag == kind and id(c) in mains]
        if clear:
            hold(max(clear, key=lambda c: c.chars))
    for c in () if holders else [*(h for h in titles if not within[id(h)]), *titles, *texts][:1]:
        hold(c)
    for c in containers:
        inside = bool(c.up and c.up.article)
        c.named = bool(c.names) and id(c) not in holders and c.chars < total
        own = c.tag in ASIDE_TAGS and not (c.tag == "header" and inside)
        c.aside = bool(c.up and c.up.aside) or own or c.named or c.hidden
        c.article = (inside or c.tag in ("article", "main")) and not c.aside


class _Blocks:
    """Flat blocks: text, linked characters, place."""

    def __init__(self, html: str) -> None:
        self.open: list[_Container] = []
        self.count: Counter[str] = Counter()
        self.containers: list[_Container] = []
        self.headings: list[_Container] = []
        self.link, self.text, self.linked = 0, [], 0
        self.heading = False
        self.found: list[tuple[str, int, _Container | None, bool]] = []
        page = _Events(html)
        take = {"start": self.start, "end": self.end, "text": self.data}
        at = 0
        while at < len(page.events):
            kind, name, given = page.events[at]
            if kind == "start" and at in page.ends:
                self.text.append(" ")
                at = page.ends[at]
                # A title that a block ended has no end tag to pass over.
                at += at < len(page.events) and page.events[at][:2] == ("end", name)
                continue
            take[kind](name, given)
            at += 1
        self.flush()
        _judge(self.containers, self.headings, sum(len(f[0]) for f in self.found))

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            around = self.open[-1] if self.open else None
            if around:
                around.chars += len(text)
            self.found.append((text, self.linked, around, self.heading))
        self.text, self.linked = [], 0

    def leave(self) -> str:
        tag = self.open.pop().tag
        self.count[tag] -= 1
        return tag

    def start(self, tag: str, given: str) -> None:
        if tag in HIDDEN:
            self.text.append(" ")
        elif tag == "a":
            self.link = 1  # links don't nest
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            self.link = 0
            if tag in VOID:
                return
            ends = CLOSES.get(tag, {"p"})
            while self.open and self.open[-1].tag in ends:
                self.leave()
            self.open.append(_Container(tag, self.open[-1] if self.open else None, given))
            self.count[tag] += 1
            self.containers.append(self.open[-1])
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if self.heading:
                self.headings.append(self.open[-1])

    def end(self, tag: str, _: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag in BLOCKS:
            self.flush()
            self.heading = False
            if self.count[tag]:
                while self.leave() != tag:
                    pass

    def data(self, data: str, _: str) -> None:
        self.text.append(data)
        if self.link:
            self.linked += len("".join(data.split()))


def features(blocks: list[tuple[int, float, bool, bool, bool, int]]) -> np.ndarray:
    """:data:`FEATURES` of a page's blocks (words, link density, aside, article, heading,
    group): each block's own, its neighbours' and its group's."""
    groups: dict[int, list[float]] = {}
    for words, links, aside, _, _, group in blocks:
        g = groups.setdefault(group, [0.0, 0.0, 0.0])
        if not aside:
            g[0] += words
            g[1] += words * links
            g[2] += 1
    plain = {k: g[0] - g[1] for k, g in groups.items()}
    most = max(plain.values(), default=0.0) or 1.0
    has_article = any(b[3] for b in blocks)
    edge = (0, 0.0)
    rows = []
    for i, (words, links, aside, article, heading, group) in enumerate(blocks):
        before = blocks[i - 1] if i else edge
        after = blocks[i + 1] if i + 1 < len(blocks) else edge
        g = groups[group] if not aside else [0.0, 0.0, 0.0]  # an aside is of no group
        rows.append((
            words, links, before[0], before[1], after[0], after[1], aside, article, has_article, heading,
            g[0], g[1] / max(1.0, g[0]), 0.0 if aside else plain[group] / most, g[2],
        ))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def _groups(found: list[tuple[str, float, _Container | None]]) -> list[int]:
    """The group of each block (text, link density, container): what stands inside
    articles is one, else blocks go by their container.  Containers that look alike
    (tag and attributes) side by side are sections of one group if two of them hold
    some text of their own."""
    held: dict[int, tuple[_Container, list[float]]] = {}
    own = []
    for text, links, c in found:
        if c is None or c.article:
            own.append(0)
            continue
        g = c.group()
        own.append(id(g))
        n = len(text.split())
        sums = held.setdefault(id(g), (g, [0.0, 0.0]))[1]
        if not c.aside:
            sums[0] += n
            sums[1] += n * links
    alike: dict[tuple[int, str, str], list[int]] = {}
    for key, (g, (words, linked)) in held.items():
        if g.up and g.tag not in ("html", "body") and linked <= 0.5 * words and words >= (1 if g.look or g.tag == "section" else SECTION):
            alike.setdefault((id(g.up), g.tag, g.look), []).append(key)
    merged = {}
    for keys in alike.values():
        rich = [k for k in keys if held[k][1][0] >= SECTION and held[k][1][1] <= 0.3 * held[k][1][0]]
        if len(rich) >= 2:
            merged |= dict.fromkeys(keys, keys[0])
            around = held[keys[0]][0].up
            if around.tag not in ("html", "body"):  # what stands beside the sections leads them in
                merged.setdefault(id(around), keys[0])
    return [merged.get(k, k) for k in own]


#: Words that make a container a section of its own.
SECTION = 20


def blocks_of(html: str) -> tuple[list[str], np.ndarray]:
    """The flat blocks of a page and their features, in page order."""
    found = _Blocks(html).found
    density = [min(1.0, linked / max(1, len("".join(text.split())))) for text, linked, _, _ in found]
    groups = _groups([(text, links, c) for (text, _, c, _), links in zip(found, density, strict=True)])
    told = [
        (len(text.split()), links, bool(c and c.aside), bool(c and c.article), heading, group)
        for (text, _, c, heading), links, group in zip(found, density, groups, strict=True)
    ]
    return [f[0] for f in found], features(told)


# -- the tree ------------------------------------------------------------------
def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2):
    """A decision tree as nested (feature, cut, low, high); a leaf is a share of 1s.
    Splits lower the Gini impurity most; ties go to the first feature and cut."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if least <= low.sum() <= len(y) - least:
                a, b = y[low], y[~low]
                impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def score(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        feature, cut, low, high = tree
        tree = low if row[feature] <= cut else high
    return tree


#: Labelled pages: blocks between [[ and ]] are main text.
LABELLED = (
    """<html><body><header class="site"><a href="/">Daily Post</a><p>News since 1901</p></header><nav><ul><li><a href="/">Home
    </a></li><li><a href="/w">World news</a></li><li><a href="/s">Sport</a></li></ul></nav><div class="ad">Buy two and get one
    for free this week only.</div><article><h1>[[River rises]]</h1><p>[[The river rose again on Monday, and people in the lower
    town began to move their goods to the upper floors of the houses.]]</p><p>[[No one was hurt.]]</p><h2>[[What comes next]]</h2><p>
    [[The mayor said <a href="/m">the dam</a> would hold for another week if the rain stopped by then.]]</p><ul><li>[[Bring
    water]]</li><li>[[Stay at home]]</li></ul><div class="share"><a href="/f">Share this</a> <a href="/t">Post this</a></div>
    </article><section id="comments"><h3>Comments</h3><p>I live there and this is the third time that the street is under
    water in a year, so please do something.</p><p>So sad.</p></section><aside><h3>Related</h3><p><a href="/1">A bridge is
    closed</a></p><p><a href="/2">Rain goes on</a></p></aside><footer><p>Copyright Daily Post, all rights reserved in all
    countries of the world.</p></footer></body></html>""",
    """<body><div id="top-menu"><a href="/">Start</a> <a href="/b">Blog</a> <a href="/c">Contact</a></div><div class="cookie
    notice"><p>We use cookies to give you the best experience on our pages, read our policy to learn more.</p><button>Accept
    </button></div><div class="post"><h1>[[Bread at home]]</h1><p>[[Good bread needs four things, and the one that most people
    lack is the time to let the dough rest.]]</p><p>[[Mix flour and water first. Leave the salt for later, when the dough has
    come together and feels smooth.]]</p><p>[[Bake it hot.]]</p><p>[[Let it cool for an hour before you cut the first slice, or
    the crumb will be wet.]]</p></div><div id="sidebar"><h4>Archive</h4><ul><li><a href="/5">May</a></li><li><a href="/6">June
    </a></li></ul><p>This blog is written in a small kitchen by two people who like to eat.</p></div><form><label>Your mail
    </label><input><p>Get a letter with new recipes every Sunday morning, without any charge.</p></form><div
    class="footer"><p>Made with care.</p></div></body>""",
    """<html><head><title>Note</title><style>p{}</style></head><body><nav><a href="/">Top</a></nav><!-- ad --><div class="ad">Short
    words here.</div><article><h1>[[Tin | zinc | lead]]</h1><p><b>[[Tin | zinc | lead | copper]]<br></article><footer>&copy; example
    &middot; Some words at the end of the page.</footer></body></html>""",
    """<body><article><h1>[[One two three four]]</h1><p>[[One two three four five six seven eight nine ten eleven twelve.]]<br><p>[[Ten]]
    </article><p>Last changed on the fourth of May by the person who runs the pages.</p><p><a href="/x">Imprint</a></p></body>""",
    """<body><table><tr><td><a href="/a">Index</a></td><td><a href="/b">Next page</a></td></tr></table><p>[[When the first settlers
    came to the valley they found neither road nor bridge, and it took a generation until both were built.]]</p><p>[[They
    called it home.]]</p><p>[[Their children went to the towns, as the old letters tell, and few of them ever came back to
    see the fields.]]</p><p><a href="/a">Index</a> | <a href="/b">Next page</a></p><p>All rights reserved.</p></body>""",
    """<body><main><h2>[[Opening hours]]</h2><p>[[The library is open from nine to five on every day but Sunday, and on the
    first Thursday of the month until eight.]]</p><p>[[Entry is free.]]</p><blockquote>[[A room without books is empty.]]</blockquote><p>[[See the
    <a href="/plan">plan of the house</a>.]]</p><footer><a href="/print">Print</a></footer></main><div>Partner of the city
    council and of the friends of reading, with help from many hands in the whole county.</div><div><a href="/l">Legal</a> <a
    href="/d">Data</a></div></body>""",
    """<body><div><a href="/">Shop</a> <a href="/n">New</a> <a href="/s">Sale</a></div><div><p>[[This lamp is made of brass and glass
    and gives a warm light that does not tire the eyes in the evening hours.]]</p></div><div><p>[[It comes with a cable of two
    metres and a plug that fits the sockets of most countries of the continent.]]</p></div><div class="comments"><p>I bought
    two of these and one of them did not work at all, but the shop sent me a new one at once.</p></div><div><a href="/h">Help
    </a> <a href="/i">Imprint</a></div><div>Only this week</div></body>""",
    """<body><div><a href="/">Home</a></div><article><h2>[[<a href="/w">The wall</a>]]</h2><p>[[<a href="/long">The whole story of the wall and of the
    men who built it can be read here</a>]]</p><p>[[It was ten feet high.]]</p><p>[[<a href="/next">Next part</a>]]</p></article><p>Written in a hurry and put
    here without a second look by anybody else in the office.</p></body>""",
    """<body><article><h1>[[A short note]]</h1><p>[[The old clock in the square has stopped, and nobody in the town can say on which
    day it did, for nobody looks at it any more.]]</p><p>[[That is all.]]</p></article></body>""",
    """<body><article><p>[[The team has found a way to store heat in sand for months, and the first plant will be built next
    year near the harbour.]]</p><p>[[It will be small.]]</p><p>[[If it works, ten more will follow in the towns along the coast,
    where the winters are long and dark.]]</p></article><ul><li><a href="/1">More on heat</a></li><li><a href="/2">More on
    sand</a></li></ul></body>""",
    """<body><div><a href="/">Home</a></div><div>[[A walk around the lake takes two hours if you do not stop at the inn, and a
    whole day if you do, as most people find.]]</div><div>[[The path is flat and dry, and a child can walk it with ease in any
    kind of weather.]]</div></body>""",
    """<body><div><a href="/">Home</a></div><div>Offer of the day</div><main><p>[[Wood burns well when it is dry, and it takes two summers under a roof until a log is dry to the
    core.]]</p><p>[[Stack it with care.]]</p><p>[[Leave room for the wind between the rows, and never cover the sides of the stack
    with a sheet.]]</p></main><div><a href="/p">Plans</a></div><div>Built with love by a team of five that works from a barn in
    the hills and answers every letter within a week.</div></body>""",
    """<body><div>Sign up</div><div><a href="/q">Ask us</a></div><article><h2>[[Rules of the game]]</h2><ol><li>[[Each player draws five cards.]]</li><li>[[The
    youngest begins.]]</li><li>[[Who has no card left wins.]]</li></ol></article><div>Opening hours of the shop from Monday to
    Friday, and on Saturday only before a holiday.</div><div>Thank you</div></body>""",
    """<body><main><article><h1>[[Salt roads]]</h1><p>[[Salt went over the pass on the backs of mules, and every village on the way took its
    share of the load as toll.]]</p><aside><p>Our new book on old roads is out now and can be had in every good shop of the
    country.</p></aside><p>[[The last train of mules came down in the year the tunnel was opened.]]</p><div
    class="newsletter"><p>Leave your address and we will send you one story a week, free of charge and of any obligation.</p></div>
    <form><p>Tell us what you think about this story and we may print it here next week.</p></form><div id="comments"><p>My
    grandfather told me that he walked that road as a boy with his uncle and two mules.</p><p>Great read.</p><p>There is a
    mistake in the second part, the tunnel was opened two years later than you say.</p></div><footer><p>Filed under history by
    our own reporter in the mountains.</p></footer></article></main></body>""",
    """<body><div id="page" class="has-sidebar"><div class="layout header-fixed"><article class="post comments-open"><h1>[[The mill]]</h1><p>
    [[The mill by the weir has ground no corn for sixty years, but its wheel still turns when the water is high.]]</p><p>[[Come
    and see it.]]</p></article><div class="comment-list"><p>My father worked there as a boy and told us of the dust and of the
    noise.</p></div></div><div id="main-sidebar"><p>We are a club of eleven people who look after old mills and their
    wheels.</p></div></div></body>""",
    """<body class="sidebar"><div class="share-enabled search"><div>[[In the cellar the cheese lies on boards of pine for half a year, and each wheel
    is turned and washed with brine every other day.]]</div><div>[[The rind tells its age, and a good nose can tell from which of the
    three pastures the milk has come.]]</div><div class="share-buttons">Tell your friends of it</div></div></body>""",
    """<body><header><p>The voice of the valley since the year of the great flood, free and for everyone.</p></header><div
    class="alert"><p>The shop will be closed for the whole of next week because of work on the roof of the house.</p></div><p>
    [[The bees came back in March, three weeks before their time, and found no flower open in the whole valley.]]</p><p>[[We fed them
    sugar.]]</p><p>[[Half of the hives made it to May, when the trees at last began to bloom on both sides of the river.]]</p><div
    class="related-posts"><p>How we built the hives out of old doors and a bed that nobody wanted any more.</p><p>What to do when
    a swarm settles on the roof of your car in the middle of town.</p></div><div class="sidebar-widget"><p>I keep bees and write
    about them whenever the weather keeps me inside of the house.</p></div><footer><p>You may use these words if you say whose
    they are and where you have found them.</p></footer></body>""",
)


#: Labelled blocks of further pages, one page each.  Groups (blocks in one container) are
#: parted by ``|``, ``a`` opens one inside an article; a block is its number of words, ``h`` before it marks a
#: heading, ``~`` after it a link, ``%n`` n hundredths of links, ``+`` main text.
LABELLED_BLOCKS = (
    "3~ 2~ 2~ 4~ | h6+ 34+ 3+ 52+ 1+ 15+ | 12",
    "2~ 1~ 1~ | h4+ 2+ 1+ 18+ 2+ | 6 | 3~ 2~",
    "1~ 2~ | h7+ 80+ 41+ h3+ 62+ 5+ 9+ | h2 4~ 5~ 3~ 6~ | 9 4~",
    "4 | 2~ 2~ 2~ 2~ 2~ | 28+ 44+ 17+ 8+ 61+ 3+ | 14%20",
    "h2 | 1~ 1~ 1~ | h9+ 25+ | 5 7~ 6~ | 8",
    "2~ | 3~ | 2~ | 61+ 44+ 12+ 90+ 2+ | 11 2~ | 3",
    "6~%90 2~ | h5~+ 70+ 33+ h4~+ 41+ 26+ h6~+ 22+ 35+ | 2~ 2~ 1~ | 7",
    "5 3~ | h3+ 4+ 5+ 3+ 4+ 6+ 2+ | 2~ 2~ | 10",
    "1~ 1~ 1~ 1~ | 120+ | 4~ 5~ 4~ | 16",
    "2 | 40+ | 38+ | 55+ | 3~ 2~ | 6",
    "8 | 2~ 1~ 3~ | h8+ 9+ 47%10+ 51%25+ 7+ 66+ 4+ | h1 6~ 7~ 5~ | h2 19 | 13%30",
    "1~ | 15+ 22+ 31+ 9+ 4+ 28+ | 1~",
    "3~ 3~ 3~ 3~ 3~ 3~ 3~ | h5+ 45+ 11+ 10+ 6~+ 38+ 20+ | 3~ 3~ | 5",
    "2~ 2~ | h6+ 8+ 12+ 7+ 9+ | 4 | 2~",
    "h3 | 1~ 2~ 1~ | h5+ 3+ 88+ 14+ 7+ 19+ 1+ 2+ 60+ | h2 2~ 2~ | 15",
    "7 | h4+ 30+ 42+ | h3+ 25+ 51+ | h5+ 37+ 6+ | 2~ 3~ 2~ | 9",
    "1~ 1~ | h6+ 20+ 24+ | h4+ 18+ 40+ 5+ | h2 3~ 4~ 4~ | 8 1~",
    "4~ 2~ | 300+ 2+ 150+ 1+ 80+ 40+ | 22 | 3~ 2~ 2~",
    "2~ | h3+ 16+ | 2~ 2~ 2~",
    "2~ 2~ 2~ | h2+ 6+ | 4~ 3~",
    "5 | 3~ 1~ | 17+ 2+ 2+ 3+ 60+ 2+ 4+ 1+ | 2~ 12",
    "1~ 4~ 2~ | h7+ 35%60+ 41%35+ 12%50+ 29+ | 3~ 3~ 3~ | 9%40",
    "h1 3~ 3~ 3~ | 70+ 65+ 3+ | h1 3~ 3~ | 12",
    "6 6 | 2~ 2~ | h5+ 50+ 61+ 47+ 9+ 33+ | 21 | 4~ 4~ 4~ 4~ | 10",
    "3~ | h5+ 14+ 13+ 15+ 11+ 10+ | 1~ 1~",
    "2~ 3~ | 33+ 2+", "1~ | 25+ 4+ 31+", "40+", "2~ | h3+ 12+ 44+ 1+", "h2+ 18+ 3+", "5 | 1~ 2~ | h4+ 60+ 7+ 16+ 12+", "3~ | 50+ 6+ 2+",
    "2~ | a h2~+ 9~+ 30+ | 8", "a h3~+ 22+ 5~+", "a 2~+ 3+ | 40 12", "1~ 1~ | a h4+ 6~+ 4+ | 9 2~", "a h2+ 5+", "3~ | a 4+", "20 | a h5~+ 2~+ 2~+ 60+ | 31",
    "4~ 4~ | a h1+ 12+ | 70 | 2~", "a 8~+ | 9~ 3~", "a 30+ 2~+ 2~+ 2~+ | 2~ 2~",
    "a 12+ | 40 12 9 30", "22 15 18 25 8 | a h2+ 30+", "2~ | a h1+ 9+ 4+ | h2 31 24 6 1~ | 15", "a 25+ 3+ | h4 30 2~ 3~ 44 2~ 8",
)


def _page_of(line: str) -> tuple[list[tuple[int, float, bool, bool, bool, int]], list[float]]:
    """Blocks and labels of a line of :data:`LABELLED_BLOCKS`."""
    blocks, labels = [], []
    for group, part in enumerate(line.split("|")):
        article = part.strip().startswith("a")
        for heading, words, linked, share, main in re.findall(r"(h?)([0-9]+)(~?)(?:%([0-9]+))?(\+?)", part):
            links = int(share) / 100 if share else 1.0 if linked else 0.0
            blocks.append((int(words), links, False, article, bool(heading), group))
            labels.append(float(bool(main)))
    return blocks, labels


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: features and labels of the labelled pages' blocks."""
    xs, ys = [], []
    for page in LABELLED:
        marked, _ = blocks_of(page)
        _, x = blocks_of(page.replace("[[", "").replace("]]", ""))
        xs.append(x)
        ys += [float("[[" in b or "]]" in b) for b in marked]
    for line in LABELLED_BLOCKS:
        blocks, labels = _page_of(line)
        xs.append(features(blocks))
        ys += labels
    return np.concatenate(xs), np.array(ys)


def main_text(html: str | None, tree) -> str:
    """The page's main blocks in page order, joined by two line feeds."""
    texts, x = blocks_of(html or "")
    return "\n\n".join(t for t, row in zip(texts, x, strict=True) if score(tree, row) >= 0.5)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", tree=None) -> DataFrame:
    """Main text of every page: key, url, text, n_chars (code points).

    ``tree``: a tree of :func:`grow` over :data:`FEATURES`, by default grown on the
    labelled pages.  Character references are decoded, white space inside a block is
    one blank, blocks are trimmed and stand in page order; nothing else changes.

    A null or empty page has an empty text; broken or cut markup is read as far as it
    goes; repeated rows each give a row; an empty table gives an empty result;
    further columns are ignored.
    """
    tree = tree or grow(*labelled_blocks())

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, tree))

    found = pages.select(F.col(key).alias(key), F.col(url).alias(url), text_of(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
