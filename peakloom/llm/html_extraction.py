"""Main text of web pages by gradient-boosted trees over their elements.

Every block element of a page gets features: subtree text and link density, tokens
of its attributes and of its ancestors', depth, place and statistics among its
siblings. Boosted trees turn them into the probability that it holds main text, and
hierarchical decoding picks the most likely set in which nothing is kept inside
something dropped. The kept elements' text, in page order, is the result.

Pages carry no labels, so the trees learn from labels made here: of a bounded sample (``SAMPLE``
distinct pages at most, picked by a threshold of their hashes, so that no task sends more than its share of
them to the driver) the paragraphs of the semantic main element are known main text. Where a page has no such
element, its long paragraphs with few links, outside of elements that say they are something else, stand in;
they serve for new layouts alone. Each page is laid out anew, several times, in layouts drawn by a
seeded generator: other elements around the same paragraphs, with menus,
headers, footers, sidebars, notices, adverts, forms and reader comments filled from
other sampled pages. Attributes there come from lists of their own and partly from no list, are often absent and
sometimes mislead, so that trees lean on structure where names say nothing. Spark ML trains the trees on that
sample; every page is extracted whole.

Defined results: where no sampled page has a paragraph to learn from, all is kept but elements whose tag or
attributes say that they are something else; a null or empty html gives an empty text; what isn't HTML is text of the page
itself; broken markup is read as browsers mend it where that matters for text; repeated rows give equal
results; an empty table gives an empty result; clashing columns of the input play no part.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import table
from peakloom.llm.dom import FEATURES, Page, decode, descend, features

#: Pages learnt from, the longest of them in characters, layouts made of each (more of each where there are fewer), trees and their depth, the layouts' seed.
SAMPLE, LONGEST, LAYOUTS, TREES, DEPTH, SEED = 160, 100_000, 6, 50, 5, 11
_DROPPED = {"nav", "header", "footer", "aside", "form"}
#: Words and links of a paragraph that stands in for semantic markup.
LEAST_WORDS, MOST_LINKED = 12, 0.25
#: Names that layouts give to elements, whether or not features know them.
NAMES = {
    "main": "article post-body entry-content story lede copy reading-pane blog-text page-body prose chapter rich-text editor-output field-body".split(),
    "menu": "navbar main-menu topnav breadcrumbs pager tabs crumb-trail hamburger drawer site-links jump-list toc quick-access".split(),
    "frame": "site-header page-footer masthead colophon top-strip brandbar legal imprint hero-title bottom-strip wordmark".split(),
    "side": "sidebar related-posts widget trending rail see-also more-stories aside-col share-tools tagcloud recirculation".split(),
    "advert": "ad-slot sponsored banner-ad promo-unit mpu leaderboard partner-offer dfp-box native-unit".split(),
    "notice": "cookie-bar consent alert-box modal gdpr paywall-note announcement interstitial toast".split(),
    "reader": "comments comment-list discussion replies feedback user-posts responses talkback".split(),
    "form": "newsletter-form signup login search-box contact subscribe-panel optin poll".split(),
}
Trees = list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _inside(page: Page) -> list[bool]:
    """Which elements lie in the semantic main element."""
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = (inside[page.parent[i]] or page.tag[i] in ("article", "main")) and page.tag[i] not in _DROPPED
    return inside


def _elsewhere(page: Page) -> list[bool]:
    """Which elements lie in one whose tag or attributes say that it holds something else than main text."""
    out = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        out[i] = out[page.parent[i]] or page.tag[i] in _DROPPED or any(k != "main" for k in page.tokens[i])
    return out


def _paragraphs(page: Page, inside: list[bool]) -> list[tuple[str, str]]:
    """(tag, text) of what lies inside, or of what looks like main text where nothing does."""
    parts: dict[int, list[str]] = {}
    for x in page.flow:
        if x is not None:
            parts.setdefault(x[0], []).append(x[1])
    found = [(i, " ".join("".join(t).split())) for i, t in sorted(parts.items())]
    if any(inside):
        return [(page.tag[i], t) for i, t in found if t and inside[i]]
    away = _elsewhere(page)
    fine = lambda i, t: not away[i] and len(t.split()) >= LEAST_WORDS and page.own_links[i] <= MOST_LINKED * page.own[i]
    return [(page.tag[i], t) for i, t in found if fine(i, t)]


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _layout(main: list[tuple[str, str]], other: list[str], r: random.Random) -> str:
    """A page with ``main`` as its main text, marked by data-main, and ``other`` around it."""

    nameless, plain = r.random() < 0.3, "div" if r.random() < 0.3 else "p"

    def some(least: int, most: int) -> str:
        words = r.choice(other).split() or ["-"]
        at = r.randrange(len(words))
        return _escape(" ".join((words[at:] + words)[: r.randint(least, most)]))

    def link(least: int = 1, most: int = 3) -> str:
        return f'<a href="/{r.randrange(999)}">{some(least, most)}</a>'

    def named(kind: str) -> str:
        """A name that fits, one that says nothing, or, rarely, one of another kind; none at all on some pages."""
        if nameless:
            return ""
        luck = r.random()
        if luck < 0.35:
            return r.choice("bcfgmqrsx") + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(2, 7)))
        return r.choice(NAMES[kind if luck < 0.96 else r.choice(list(NAMES))])

    def box(kind: str, inner: str, tags: tuple[str, ...]) -> str:
        tag = r.choice(tags) if tags and r.random() < 0.45 else r.choice(("div", "div", "section", "div", "ul" if inner.startswith("<li") else "div"))
        name, how = named(kind), r.random()
        attribute = "" if not name or tag != "div" and how < 0.5 else f' class="{name}{r.choice(("", "-wrap", " box", "-1", "_inner"))}"' if how < 0.75 else f' id="{name}"' if how < 0.95 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    menu = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 12)))
    prose = lambda a, b: "".join(f"<{plain}>{some(5, 60)}</{plain}>" for _ in range(r.randint(a, b)))
    parts = {
        "menu": lambda: box("menu", f"<ul>{menu()}</ul>" if r.random() < 0.7 else menu(), ("nav",)),
        "frame": lambda: box("frame", r.choice((f"<p>{some(2, 12)}</p>", some(3, 25), f"<h2>{link()}</h2>" + some(1, 6), f"&copy; {some(3, 15)}")), ("header", "footer")),
        "side": lambda: box("side", f"<h3>{some(1, 3)}</h3><ul>{menu()}</ul>" if r.random() < 0.6 else f"<h3>{some(1, 3)}</h3>" + prose(1, 3), ("aside",)),
        "advert": lambda: box("advert", some(3, 40) if r.random() < 0.7 else prose(1, 2), ()),
        "notice": lambda: box("notice", f"<p>{some(6, 40)}</p>" + link(), ()),
        "form": lambda: box("form", f"<p>{some(2, 15)}</p><input><label>{some(1, 3)}</label>", ("form",)),
        "reader": lambda: box("reader", f"<h3>{some(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{some(1, 2)}</b><p>{some(5, 70)}</p></div>' if r.random() < 0.7 else f"<p>{some(5, 70)}</p>" for _ in range(r.randint(1, 6))), ()),
    }
    body = []
    for i, (tag, text) in enumerate(main):
        words = _escape(text).split()
        if len(words) > 8 and r.random() < 0.3:
            k = r.randrange(len(words) - 4)
            words[k] = r.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>")).format(words[k])
        own = tag if tag in ("h1", "h2", "h3", "li", "blockquote") else plain
        own = r.choice(("blockquote", "div", "p")) if own == plain and i and r.random() < 0.2 else own
        body.append(f'<{own} data-main="1">{" ".join(words)}</{own}>')
        if r.random() < 0.06:
            body.append(f'<ul data-main="1">{"".join(f"<li data-main=1>{some(3, 20)}</li>" for _ in range(r.randint(2, 5)))}</ul>')
        if r.random() < 0.08:
            body.append(parts[r.choice(("advert", "side", "notice"))]())
    article = "".join(body)
    for depth in range(r.randint(1, 3)):
        tag = r.choice(("article", "main", "div", "div", "section"))
        name = named("main")
        article = f'<{tag}{"" if not name or r.random() < 0.4 else r.choice((" class", " id")) + f"={chr(34)}{name}{chr(34)}"} data-main="1">{article}</{tag}>'
    before = [parts[k]() for k in ("frame", "menu", "notice", "advert", "form", "side") if r.random() < 0.5]
    after = [parts[k]() for k in ("reader", "side", "advert", "menu", "form", "frame", "notice") if r.random() < 0.5]
    r.shuffle(after)
    inner = "".join(before) + article + "".join(after)
    if r.random() < 0.12:  # laid out as a table
        cells = [f"<td>{x}</td>" for x in before] + [f"<td data-main=1>{article}</td>"] + [f"<td>{x}</td>" for x in after]
        inner = f"<table data-main=1><tr data-main=1>{''.join(cells)}</tr></table>"
    if r.random() < 0.4:
        inner = f'<div{r.choice(("", " class=wrapper", " id=container"))} data-main="1">{inner}</div>'
    return f"<html><head><title>{some(1, 6)}</title></head><body data-main=1>{inner}</body></html>"


def _rows(page: Page, truth: list[bool]) -> list[tuple[list[float], float]]:
    """Features and labels of elements whose parent holds main text; an element holds it if anything in it does."""
    text = owns_text(page)
    holds = [t and x for t, x in zip(truth, text)]
    for i in range(len(holds) - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    return [(list(map(float, f)), float(h)) for i, (f, h) in enumerate(zip(features(page), holds)) if not i or holds[page.parent[i]]]


def owns_text(page: Page) -> list[bool]:
    """Which elements have text of their own, outside of the elements in them."""
    out = [False] * len(page.tag)
    for x in page.flow:
        if x is not None and not out[x[0]] and not x[1].isspace():
            out[x[0]] = True
    return out


def training_rows(pages: list[str], seed: int = SEED) -> list[tuple[list[float], float]]:
    """Labelled elements of the sampled pages and of their new layouts, of which fewer pages get more."""
    r = random.Random(seed)
    read = [Page(h) for h in pages]
    within = [_inside(p) for p in read]
    mains = [_paragraphs(p, w) for p, w in zip(read, within)]
    other = [s for m in mains for _, s in m] or ["text"]
    each = max(LAYOUTS, -(-LAYOUTS * SAMPLE // max(1, sum(map(bool, mains)))))
    out = []
    for page, inside, main in zip(read, within, mains):
        if not main:
            continue
        if any(inside):
            out += max(1, each // 4) * _rows(page, inside)  # a quarter of the weight of the layouts made of it
        for _ in range(each):
            new = Page(_layout(main[: r.randint(1, max(1, len(main)))], other, r))
            out += _rows(new, [t is not None for t in new.truth])
    return out


def fit(pages: DataFrame, seed: int = SEED) -> Trees:
    """Boosted trees learnt from a bounded sample of pages."""
    spark = pages.sparkSession
    short = pages.where(F.length("html") <= LONGEST).select("html", F.xxhash64("html").alias("h"))
    # Half as many more than needed are expected below the threshold, whatever the number of pages or of their copies.
    n = short.agg(F.approx_count_distinct("h")).first()[0]
    below = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * SAMPLE / max(n, 1)))
    some = short.where(below).distinct().orderBy("h", "html").limit(SAMPLE)
    rows = training_rows([x["html"] for x in some.collect()], seed)
    if len({y for _, y in rows}) < 2:
        return []
    data = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.25, subsamplingRate=0.6, featureSubsetStrategy="onethird", seed=5).fit(data.cache())
    data.unpersist()
    return _trees(model.toDebugString, list(model.treeWeights))


def _trees(said: str, weights: list[float]) -> Trees:
    """Arrays (feature, threshold, left, right or value) of each tree, from Spark ML's own listing."""
    out, lines = [], []
    for line in [*said.splitlines()[1:], "  Tree"]:
        if line.strip().startswith("Tree"):
            if lines:
                out.append((weights[len(out)], *_tree(lines)))
            lines = []
        elif line.strip():
            lines.append(line)
    return out


_IF = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def _tree(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    feature, value, left, right = [], [], [], []

    def read(at: int) -> tuple[int, int]:
        """Reads the node that begins at a line; returns its number and the next line."""
        me = len(feature)
        for x in (feature, value, left, right):
            x.append(0)
        line = lines[at].strip()
        if line.startswith("Predict:"):
            feature[me], value[me], left[me], right[me] = 0, float(line.split(":")[1]), me, me
            return me, at + 1
        m = _IF.match(line)
        feature[me], value[me] = int(m[1]), float(m[2])
        left[me], at = read(at + 1)
        right[me], at = read(at + 1)  # past the line "Else"
        return me, at

    read(0)
    return np.array(feature), np.array(value), np.array(left), np.array(right)


def probabilities(x: np.ndarray, trees: Trees) -> np.ndarray:
    margin = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, feature, value, left, right in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            go = np.where(x[rows, feature[at]] <= value[at], left[at], right[at])
            at = go
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            html = b.column("html").to_pylist()
            for a in range(0, len(html), 128):
                read = [Page(h or "") for h in html[a : a + 128]]
                rows = [features(p) for p in read]
                x = np.array([r for f in rows for r in f]).reshape(-1, len(FEATURES))
                p = probabilities(x, trees).tolist() if trees else [0.1 if away else 0.6 for q in read for away in _elsewhere(q)]
                at = 0
                for page in read:
                    own = p[at : at + len(page.tag)]
                    texts.append(page.text(descend(page.parent, own, owns_text(page)) if trees else decode(page.parent, own)))
                    at += len(page.tag)
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        each, "page_id long, url string, text string, n_chars long"
    )


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
