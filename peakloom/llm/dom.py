"""Pages as trees of block elements, with the features by which main text is told apart."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select button audio video map datalist".split())
#: What an open head may hold; anything else, and text, ends it, as does <body> wherever in it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, unless an element of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Tokens of class, id and role attributes, by what they tell.
TOKENS = {
    "main": "article articlebody body content entry main page post story text prose maincontent".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar links sitemap".split(),
    "frame": "header footer masthead banner top bottom copyright logo site topbar colophon contentinfo".split(),
    "side": "sidebar aside side widget related recommended promo share social tags teaser popular trending more complementary rail".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored sponsorship promoted dfp outbrain taboola".split(),
    "notice": "cookie cookies consent notice alert modal popup overlay gdpr message disclaimer warning dialog".split(),
    "reader": "comment comments commentlist discussion disqus reply replies respond review reviews thread feedback".split(),
    "form": "form login signin signup subscribe subscription newsletter search searchbox contact register".split(),
}
_KIND = {t: k for k, names in TOKENS.items() for t in names}
KINDS = list(TOKENS)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_GROUPS = {
    "p": {"p"}, "heading": {f"h{i}" for i in range(1, 7)}, "item": {"li", "dt", "dd"}, "list": {"ul", "ol", "dl", "menu"}, "box": {"div"}, "part": {"section"},
    "article": {"article", "main"}, "nav": {"nav"}, "head": {"header"}, "foot": {"footer"}, "aside": {"aside"}, "form": {"form", "fieldset"},
    "cell": {"table", "tr", "td", "th", "tbody", "thead"}, "quote": {"blockquote", "pre", "figure", "figcaption"}, "inline": INLINE,
}
_GROUP = {t: g for g, tags in _GROUPS.items() for t in tags}
GROUPS = list(_GROUPS)
_WORD = re.compile(r"\S+")
_MARKS = re.compile(r"[.,;:!?]")


class Page(HTMLParser):
    """Block elements of a page (node 0 is the page itself) and its text in order.

    ``flow`` holds (node, text) and, between blocks, None. Inline elements are part
    of their block, but for those whose attributes name something to leave out.
    ``unseen`` has what is open from the outermost unseen element on: the end tag of any of
    it closes what lies within, that of an element around it closes all of it.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.tokens, self.truth = ["#page"], [-1], [0], [()], [None]
        self.flow: list = []
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.unseen: list[str] = []
        self.inline: Counter = Counter()
        self.links, self.n_tags = 0, [0]
        self.own, self.own_links = [0], [0]
        self.feed(html)
        self.close()

    def error(self, message):  # some malformed declarations
        pass

    def _open(self, tag: str, tokens: tuple, truth) -> None:
        self.parent.append(self.stack[-1][1])
        self.depth.append(len(self.stack))
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.truth.append(truth)
        self.own.append(0)
        self.own_links.append(0)
        self.n_tags.append(0)
        self.stack.append((tag, len(self.tag) - 1))

    def _end(self, names, stop=()) -> None:
        """Closes the nearest open element of ``names`` and all in it."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in names:
                del self.stack[i:]
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if self.unseen and self.unseen[0] == "head" and (tag == "body" or len(self.unseen) == 1 and tag not in IN_HEAD):
            self.unseen.clear()
        if self.unseen or tag in UNSEEN:
            if tag not in VOID:
                self.unseen.append(tag)
            return
        self.n_tags[self.stack[-1][1]] += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flow.append(None)
            return
        if tag == "a":
            self.links = 1
        tokens, truth = (), None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                tokens += tuple(k for t in _SPLIT.split(value) if (k := _KIND.get(t.lower())))
            elif name == "data-main":
                truth = value
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                tokens += ("notice",)
        if tag in INLINE:
            self.inline[tag] += 1
            if any(k != "main" for k in tokens) or truth is not None:
                self._open(tag, tokens, truth)
            return
        if tag in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "caption"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        self.links = 0
        self.flow.append(None)
        self._open(tag, tokens, truth)

    def handle_startendtag(self, tag, attrs):
        before = len(self.unseen)
        self.handle_starttag(tag, attrs)
        if len(self.unseen) > before:
            self.unseen.pop()
        elif tag not in VOID and tag not in UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
                return
            if not self.inline[tag] and all(t != tag for t, _ in self.stack):
                return
            self.unseen.clear()
        if tag == "a":
            self.links = 0
        if tag in INLINE:
            self.inline[tag] = max(self.inline[tag] - 1, 0)
            if self.stack[-1][0] == tag:
                self.stack.pop()
            return
        before = len(self.stack)
        self._end({tag})
        if len(self.stack) < before:
            self.links = 0
            self.flow.append(None)

    def handle_data(self, data):
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if self.unseen:
            return
        node = self.stack[-1][1]
        self.flow.append((node, data))
        size = sum(map(len, data.split()))
        self.own[node] += size
        if self.links:
            self.own_links[node] += size

    def text(self, kept) -> str:
        """Blocks of the kept nodes, white space made one space, joined by one space."""
        blocks, block = [], []
        for x in [*self.flow, None]:
            if x is None:
                if block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
            elif kept[x[0]]:
                block.append(x[1])
        return " ".join(b for b in blocks if b)


FEATURES = [
    "depth", "siblings", "place", "like", "children", "chars", "own", "density", "own_density", "per_tag", "share", "of_parent", "start", "words", "word_size", "marks",
    "before", "after", "text_depth", *(f"is_{g}" for g in GROUPS), *(f"own_{k}" for k in KINDS), *(f"in_{k}" for k in KINDS), *(f"in_{g}" for g in ("article", "nav", "head", "foot", "aside", "form")),
    *(f"{who}_{x}" for who in ("parent", "above") for x in ("chars", "density", "share", "per_tag", "of_parent", "children")),
]


def features(page: Page) -> list[list[float]]:
    """One row per node, the page itself first."""
    n = len(page.tag)
    parent = page.parent
    chars, links, tags = page.own[:], page.own_links[:], [1 + x for x in page.n_tags]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
    words, marks = [0] * n, [0] * n
    start, seen = [-1] * n, 0
    for x in page.flow:
        if x is not None:
            i, data = x
            words[i] += len(data.split())
            marks[i] += len(_MARKS.findall(data))
            at = i
            while at >= 0 and start[at] < 0:
                start[at] = seen
                at = parent[at]
            seen += len(data)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    total, seen = chars[0] + 1, seen + 1
    log = math.log1p
    place, before, after, like = [0] * n, [0] * n, [0] * n, [1] * n
    for own in children:
        count: dict[str, int] = {}
        for i in own:
            count[page.tag[i]] = count.get(page.tag[i], 0) + 1
        for k, i in enumerate(own):
            place[i] = k
            before[i] = chars[own[k - 1]] if k else 0
            after[i] = chars[own[k + 1]] if k + 1 < len(own) else 0
            like[i] = count[page.tag[i]]
    within_tokens: list[list[float]] = [[0.0] * len(KINDS)] * n
    within_tags: list[list[float]] = [[0.0] * 6] * n
    around: list[list[float]] = []
    of_tag = {"article": 0, "nav": 1, "head": 2, "foot": 3, "aside": 4, "form": 5}
    out = []
    for i in range(n):
        p = parent[i]
        group = _GROUP.get(page.tag[i])
        kinds = [0.0] * len(KINDS)
        for t in page.tokens[i]:
            kinds[KINDS.index(t)] += 1.0
        if p >= 0:
            within_tokens[i] = [a + b for a, b in zip(within_tokens[p], kinds)] if page.tokens[i] else within_tokens[p]
            within_tags[i] = within_tags[p]
            if group in of_tag:
                within_tags[i] = within_tags[p][:]
                within_tags[i][of_tag[group]] += 1.0
        siblings = len(children[p]) if p >= 0 else 1
        row = [
            page.depth[i], siblings, place[i] / siblings, like[i] / siblings, len(children[i]), log(chars[i]), log(page.own[i]), links[i] / (chars[i] + 1),
            page.own_links[i] / (page.own[i] + 1), chars[i] / tags[i], chars[i] / total, chars[i] / ((chars[p] if p >= 0 else chars[i]) + 1), max(start[i], 0) / seen,
            log(words[i]), page.own[i] / (words[i] + 1), marks[i] / (words[i] + 1), log(before[i]), log(after[i]), log(chars[i]) / (page.depth[i] + 1),
        ]
        around.append([row[5], row[7], row[10], row[9], row[11], len(children[i])])
        row += [1.0 if g == group else 0.0 for g in GROUPS]
        up = p if p >= 0 else i
        out.append(row + kinds + within_tokens[i] + within_tags[i] + around[up] + around[parent[up] if parent[up] >= 0 else up])
    return out


def decode(parent: list[int], p) -> list[bool]:
    """The most likely choice in which nothing is kept inside what is dropped.

    ``p``: each node's probability of holding main text. From the leaves up, a kept
    node lets each child take the better of kept and dropped; a dropped one drops all below.
    """
    n = len(parent)
    keep = [math.log(max(x, 1e-9)) for x in p]
    drop = [math.log(max(1 - x, 1e-9)) for x in p]
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = [keep[0] >= drop[0]] + [False] * (n - 1)
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] >= drop[i]
    return out


def descend(parent: list[int], p, text: list[bool]) -> list[bool]:
    """The most likely choice where ``p`` is each node's probability of holding main text given that its parent does.

    Under a dropped node nothing is asked. A kept node has text of its own or keeps a child: where all its children had rather go, the
    one that loses least stays. From the leaves up, a kept node adds to its own likelihood what its children make of theirs.
    """
    n = len(parent)
    keep = [math.log(max(x, 1e-9)) for x in p]
    drop = [math.log(max(1 - x, 1e-9)) for x in p]
    inner, best = [0.0] * n, [-math.inf] * n  # of the children: their sum, and the most that one of them gains by being kept
    stays = [-1] * n
    for i in range(n - 1, 0, -1):
        own = _value(i, keep, inner, best, text)
        up = parent[i]
        inner[up] += max(own, drop[i])
        if own - drop[i] >= best[up]:
            best[up], stays[up] = own - drop[i], i
        keep[i] = own
    keep[0] = _value(0, keep, inner, best, text)
    out = [keep[0] >= drop[0]] + [False] * (n - 1)
    for i in range(1, n):
        up = parent[i]
        out[i] = out[up] and (keep[i] >= drop[i] or i == stays[up] and best[up] < 0 and not text[up] and keep[i] > -math.inf)
    return out


def _value(i: int, keep: list[float], inner: list[float], best: list[float], text: list[bool]) -> float:
    """What keeping a node is worth: with no text and no child that could be kept, nothing."""
    return keep[i] + inner[i] + (0.0 if text[i] else min(0.0, best[i]))
