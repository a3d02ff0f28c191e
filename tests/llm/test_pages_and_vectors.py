"""Archive, extraction and nearest neighbours on small fixtures with every odd case."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import additive_quantisation as aq
from peakloom.llm import html_extraction as hx
from peakloom.llm import warc
from peakloom.llm.dom import Page, decode, features

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nEvil: 1", None), (4, "u", ""), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (None, "n", "alone"), (7, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, PAGES)
    return df.withColumns({c: F.lit(1) for c in ("address", "digest", "row", "header", "text", "n_chars", "size")})


def test_archive(spark, pages):
    kept = warc.write_archive(pages)
    got = sorted(warc.read_archive(kept).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), key=str)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(tuple(r)[1:])
    assert by[1] == [(8, digest("<p>x</p>"), "revisit", 7)] == by[2] and by[7] == [(8, digest("<p>x</p>"), "response", None)]
    assert by[3] == [(0, digest(""), "revisit", 4)] and by[4] == [(0, digest(""), "response", None)]
    assert sorted(by[5], key=str) == [(100_000, digest("é" * 50_000), "response", None), (100_000, digest("é" * 50_000), "revisit", 5)]
    assert by[None] == [(5, digest("alone"), "response", None)]
    assert kept.payloads.count() == 4
    records = [bytes(r["record"]) for r in warc.records(kept).collect()]
    assert len(records) == 8 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    for r in records:
        head, _, block = r.partition(b"\r\n\r\n")
        assert len(block) - 4 == int(head.rpartition(b"Content-Length: ")[2])
    urls = {r["page_id"]: r["url"] for r in warc.read_archive(kept).collect()}
    assert urls[1] == "http://a" and urls[2] is None and urls[3] == "http://c%0D%0AEvil: 1"
    ids = lambda archive: {bytes(r["header"]).split(b"WARC-Record-ID: ")[1][:45] for r in archive.headers.collect()}
    assert len(ids(kept)) == 8 and not ids(kept) & ids(warc.write_archive(pages))
    small = warc.read_archive(warc.write_archive(pages, least=50))
    assert small.where("record_type = 'revisit'").count() == 1
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_damaged_payloads_are_errors(spark, pages):
    kept = warc.write_archive(pages)
    broken = warc.Archive(kept.headers, kept.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(broken).collect()
    shifted = kept.headers.withColumn("header", F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "Content-Length: ", "Content-Length: 1"), "UTF-8"))
    with pytest.raises(Exception, match="another length"):
        warc.read_archive(warc.Archive(shifted, kept.payloads)).collect()


def text_of(html):
    page = Page(html)
    return page.text([True] * len(page.tag))


def test_text_of_broken_markup():
    assert text_of("<p>a <b>b</b>c<br>d<p> e&amp;&#233;&nosuch; </p>") == "a bc d e&é&nosuch;"
    assert text_of("<script>x</script>a<style>b</style><!-- c -->d") == "ad"
    assert text_of("") == "" and text_of("just text") == "just text" and text_of("</div></p>x<li>y<li>z") == "x y z"
    assert len(Page("<div>" * 3000).tag) == 3001


def test_decoding_never_keeps_inside_dropped():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 9))
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        p = r.uniform(0.01, 0.99, n)
        kept = decode(parent, p.tolist())
        best = -np.inf
        for m in range(1 << n):
            z = [m >> i & 1 for i in range(n)]
            if all(i == 0 or z[i] <= z[parent[i]] for i in range(n)):
                best = max(best, sum(np.log(p[i] if z[i] else 1 - p[i]) for i in range(n)))
        assert all(i == 0 or kept[i] <= kept[parent[i]] for i in range(n))
        assert sum(np.log(p[i] if kept[i] else 1 - p[i]) for i in range(n)) == pytest.approx(best)


def test_extraction(spark, sf_dir, pages):
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trees = hx.fit(given)
    got = {r["page_id"]: r for r in hx.extract(given, trees).collect()}
    for r in given.collect():
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert got[r["page_id"]]["text"] == text_of(article)
    odd = hx.extract(pages, trees).collect()
    assert len(odd) == 8 and all(r["n_chars"] == len(r["text"]) for r in odd)
    assert hx.extract(pages.limit(0), trees).count() == 0
    # Without anything to learn from, what says that it is something else goes.
    bare = spark.createDataFrame([(1, "u", "<div class=sidebar>a b</div><p>c d</p><nav>e</nav>")], PAGES)
    assert hx.fit(bare) == [] and hx.extract(bare, []).first()["text"] == "c d"


def _templates(main, other):
    """Pages by hands other than the layouts': tables, unnamed boxes, names that no list has, no semantic element."""
    p = lambda items, tag="p": "".join(f"<{tag}>{x}</{tag}>" for x in items)
    li = lambda items: "<ul>" + "".join(f'<li><a href="#">{" ".join(x.split()[:2])}</a></li>' for x in items) + "</ul>"
    few = lambda x, n: " ".join(x.split()[:n])
    return [
        f"<html><body><div>{li(other[:6])}</div><div><div>{p(main)}</div></div><div>{li(other[6:10])}<span>(c) {few(other[0], 3)}</span></div></body></html>",
        f"<table><tr><td>{li(other[:8])}</td><td>{p(main)}</td><td><b>{few(other[1], 2)}</b>{li(other[3:9])}</td></tr></table>",
        f"<div id=w1><div id=w2><a href=/>{few(other[0], 2)}</a></div>{li(other[:5])}<div id=w3><h1>{few(main[0], 5)}</h1>{p(main)}</div><div id=w4><h4>{few(other[2], 2)}</h4>{li(other[2:7])}</div></div>",
        f"<section>{li(other[:4])}</section><section>{p(main, 'div')}</section><form><label>{few(other[3], 4)}</label><input><button>Go</button></form>",
        f"<div class=zq1>{p(main)}</div><div class=comments>{p([few(x, 25) for x in other[:4]])}</div><footer>{few(other[4], 9)}</footer>",
    ]


def test_extraction_of_pages_by_other_hands(spark):
    """Trees learnt from the given pages, and from the same pages without semantic markup; shares of words kept rightly."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id")
    plain = given.withColumn("html", F.regexp_replace("html", "(?i)<(/?)(article|main)\\b[^>]*>", "<$1div>"))
    read = [Page(r["html"]) for r in given.collect()]
    mains = [m for m in ([t for _, t in hx._paragraphs(q, hx._inside(q))] for q in read) if len(m) > 2]
    pages, truth = [], []
    for i in range(0, 60, 3):
        main, other = mains[i % len(mains)][:8], [t for m in mains[1:] for t in m if t not in mains[i % len(mains)]][i : i + 12]
        for html in _templates(main, other):
            pages.append((len(pages), "u", html))
            truth.append(Counter(" ".join(main).split()))
    df = spark.createDataFrame(pages, PAGES)
    for learnt, least in ((given, 0.9), (plain, 0.8)):
        trees = hx.fit(learnt)
        assert trees
        both = kept = wanted = 0
        for r in hx.extract(df, trees).collect():
            got = Counter(r["text"].split())
            both += sum((got & truth[r["page_id"]]).values())
            kept += sum(got.values())
            wanted += sum(truth[r["page_id"]].values())
        assert both >= 0.95 * kept and both >= least * wanted


def test_features_have_names():
    from peakloom.llm.dom import FEATURES

    assert all(len(row) == len(FEATURES) for row in features(Page("<div class='nav-bar'><a>x</a></div><p>y")))


def neighbours(df, **options):
    got = {}
    for q in aq.search(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    return got


def recall(got, ids, x, asked):
    """Share of the true 20 nearest found; scores and ranks must be right throughout."""
    hits = 0
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        other = np.flatnonzero(ids != q)
        want = other[np.lexsort((ids[other], -np.round(s[other], 9)))[:20]]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, len(want) + 1))
        assert all(a[2] > b[2] - 1e-9 for a, b in zip(found, found[1:]))
        for _, v, score in found:
            assert any(score == pytest.approx(t) for t in s[ids == v])
        left = Counter(ids[want].tolist())
        left.subtract(Counter(v for _, v, _ in found))
        hits += len(want) - sum(n for n in left.values() if n > 0)
    return hits / (20 * len(asked))


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16)) * r.uniform(0.5, 2, (300, 1))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = neighbours(df)
    assert set(got) == set(range(0, 300, 20))
    assert recall(got, np.arange(300), x, got) >= 0.98
    assert aq.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert aq.search(df, F.col("vec_id") == -1).count() == 0
    few = aq.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [q["rank"] for q in sorted(few, key=lambda q: q["rank"])] == [1, 2, 3, 4]


def test_neighbours_when_estimates_decide(spark):
    """Several blocks, each far larger than what is scored exactly, and clustered directions that leave lists unvisited."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 24))
    x = centre[np.arange(6000) % 40] + 0.5 * r.normal(size=(6000, 24))
    x[2000:2500] = x[2000]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<double>").repartition(5)
    block, seen = 1500, {}
    real = aq.learn

    def learn(*a):
        seen["index"] = real(*a)
        return seen["index"]

    aq.learn = learn
    try:
        got = neighbours(df, block=block)
    finally:
        aq.learn = real
    assert max(aq.LEAST, aq.RERANK * block) <= 0.05 * block
    assert seen["index"].probes < len(seen["index"].centres)
    assert recall(got, np.arange(6000), x, range(0, 6000, 20)) >= 0.9


def test_neighbours_of_repeated_rows(spark):
    """A repeated query row asks once; candidates that share a vec_id each count."""
    r = np.random.default_rng(4)
    x = r.normal(size=(120, 8))
    ids = np.concatenate([np.arange(100), [20] * 10, [7] * 10])
    x[100:110], x[110:] = x[20], x[7]
    df = spark.createDataFrame([(int(i), [float(u) for u in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = neighbours(df)
    assert set(got) == {0, 20, 40, 60, 80} and all(len(v) == 20 for v in got.values())
    assert recall(got, ids, x, got) >= 0.98


def test_beam_search_beats_greedy():
    x = np.random.default_rng(2).normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = aq.fit(x)
    error = lambda beam: ((x - sum(books[j][c] for j, c in enumerate(aq.beam_encode(x, books, beam).T))) ** 2).sum(1).mean()
    assert error(8) < error(1)


def test_neighbours_where_codes_are_coarse(spark):
    """Directions of many dimensions, of which 16 bytes of codes keep little."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 384))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for q in aq.search(df, F.col("vec_id") % 200 == 0).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert recall(got, np.arange(6000), x, range(0, 6000, 200)) == 1


def test_neighbours_in_lists_that_are_far(spark):
    """A few very long vectors, too few for the sample to tell of them, in lists that no query's direction is near to."""
    r = np.random.default_rng(6)
    centre = np.repeat(np.eye(30), 2, axis=1)
    x = centre[np.arange(6000) % 30] + 0.02 * r.normal(size=(6000, 60))
    far = np.arange(1, 240, 10)
    x[far] = 1000 * (centre[far % 30] + 0.001)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<double>").repartition(5)
    kept = aq.SAMPLE
    aq.SAMPLE = 1500
    try:
        got = neighbours(df, block=1500)
    finally:
        aq.SAMPLE = kept
    assert recall(got, np.arange(6000), x, range(0, 6000, 20)) == 1
