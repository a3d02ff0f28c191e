"""Spelling variants, personal data and whitening against brute force, with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import char_tagger, personal_data, spelling, whitening

DOCS = "doc_id long, text string, n string, word string, spans string, leaf string"
CLASH = ("clash",) * 4


def brute_variants(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    known = {w: n for w, n in seen.items() if n >= 5 and len(w) >= 6}
    near = defaultdict(set)
    for a in known:
        for b in known:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in known.items():
        top = min(((-known[o], o) for o in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= 5 * n else None
    out = set()
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), known.get(form[w])))
    return out


def test_spelling_variants(spark):
    r = random.Random(4)
    base = ["reading", "Writing", "streßer", "ÀÉÎõüÿ", "banana", "ananab", "x" * 40, "short", "ab×cd÷ef"]
    words = []
    for w in base:
        words += [w] * 200
        for _ in range(12):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeßÀ") + w[k:], w[:k] + r.choice("aeßÀ") + w[k + 1 :]])
            words += [v] * r.choice([1, 4, 5, 30, 39, 40, 41])
    r.shuffle(words)
    rows = [(i, " ".join(words[a : a + 20])) for i, a in enumerate(range(0, len(words), 20))]
    rows += [(None, "reading,writing;reading" * 3), (5, None), (6, ""), (7, " \n"), (8, "naïveté-" * 20_000), rows[0], rows[0], (9, "日本語 123 _")]
    df = spark.createDataFrame([(*x, *CLASH) for x in rows], DOCS)
    got = [tuple(x) for x in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)
    assert any(x[1] for x in got)
    assert not spelling.variants(df.limit(0)).count()


def test_k_d_search_over_many_words():
    """Trees of many leaves, with classes of anagrams: every pair, once."""
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcd") for _ in range(7)) for _ in range(900)})
    longer = sorted({"".join(r.choice("abcd") for _ in range(8)) for _ in range(900)})
    a, b = spelling.codes(words), spelling.codes(longer)
    same = [(int(i), int(j)) for x, y in spelling.near_pairs(a, a, True) for i, j in zip(x, y)]
    assert len(same) == len(set(same)) and set(same) == {(j, i) for i in range(len(a)) for j in range(i) if (a[i] != a[j]).sum() == 1}
    more = [(int(i), int(j)) for x, y in spelling.near_pairs(a, b) for i, j in zip(x, y)]
    shorter = [{w[:k] + w[k + 1 :] for k in range(8)} for w in longer]
    assert len(more) == len(set(more)) and set(more) == {(i, j) for i, w in enumerate(words) for j in range(len(longer)) if w in shorter[j]}


def test_words_of_lengths_that_the_sample_missed(spark, monkeypatch):
    """Trees from no sample at all: leaves by length, and the same pairs."""
    words = spark.createDataFrame([(w, 9) for w in ("reading", "readin", "readings", "rearing", "zzzzzzz")], "word string, n long")
    with_sample = {tuple(x) for x in spelling.near_words(words).collect()}
    monkeypatch.setattr(spelling, "SAMPLE", 0)
    assert {tuple(x) for x in spelling.near_words(words).collect()} == with_sample and len(with_sample) == 6


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


ODD = [
    "a@b.c@d.e x@y..z a.@-.- @b.c ..%@h.i.", "1.2.3.4.5.6.7.8.9 256.1.1.1 1.2.3 001.02.3.255 1.1.1.256.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 0000 0000 0000",
    "+1 (696) 555-2293 +1 23 +49.30.1234567-89) ++1234567890 +1 222 333 4444 5555 66", "é 𝒳 ü.user%x@mail.example.com 𝒳 +44 20 7946 0958", "1 " * 300, "4111111111111111" * 3, "a" * 5000 + "@", "9" * 3000, "1." * 2000, "+1" * 1000,
]


@pytest.mark.parametrize("text", ODD)
def test_rule_spans(text):
    assert personal_data.rule_spans(text) == brute_spans(text)


def test_rule_spans_at_random():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("a1.+-@ (9") for _ in range(r.randint(0, 60)))
        assert personal_data.rule_spans(text) == brute_spans(text)


def test_slopes_of_the_tagger():
    """Slopes against differences of the likelihood, and the best path against all paths."""
    model, r = char_tagger.Tagger.fresh(2, 1), np.random.default_rng(0)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    ids, truth = r.integers(1, 60, (3, 9)).astype(np.int16), np.zeros((3, 9), int)
    ids[1, 6:] = char_tagger.PAD
    truth[0, 2:5], truth[2, :2] = [1, 2, 2], [3, 4]
    _, slopes = model.gradients(ids, truth)
    for name, slope in slopes.items():
        w = model.weights[name]
        for _ in range(4):
            at = (int(ids[0, 2]), int(r.integers(w.shape[1]))) if name == "letters" else tuple(r.integers(0, n) for n in w.shape)
            was, both = w[at], []
            for step in (1e-4, -1e-4):
                w[at] = was + step
                both.append(model.gradients(ids, truth)[0])
            w[at] = was
            assert abs((both[0] - both[1]) / 2e-4 - slope[at]) < 1e-4
    scores, _ = model.emissions(ids[:, :5])
    follow, k = model.transitions(), model.tags
    for row, path in zip(scores, model.best(scores)):
        every = np.array(np.meshgrid(*[range(k)] * 5)).reshape(5, -1).T
        value = row[np.arange(5), every].sum(1) + follow[every[:, :-1], every[:, 1:]].sum(1) - 1e6 * np.isin(every[:, 0], [2, 4])
        assert (every[value.argmax()] == path).all()


def test_reconciled_against_all_sets():
    r = random.Random(6)
    for _ in range(60):
        found = {(0, a, a + r.randint(1, 6)): r.random() for a in (r.randrange(15) for _ in range(7))}
        keys, best = list(found), 0.0
        for mask in range(1 << len(keys)):
            some = sorted((k for i, k in enumerate(keys) if mask >> i & 1), key=lambda k: k[1])
            if all(x[2] <= y[1] for x, y in zip(some, some[1:])):
                best = max(best, sum(found[k] for k in some))
        assert abs(sum(found[k] for k in personal_data.reconciled(found)) - best) < 1e-12


def test_windows_hold_every_stretch():
    text = "x" * 300 + "7" + "y" * 40 + "@" + "z" * 500 + "(at)" + "1" * 700
    found = personal_data.windows(text)
    for m in re.finditer(r"[0-9@]|\(at\)", text):
        for a in range(max(0, m.end() - personal_data.LONGEST), m.start() + 1):
            b = min(len(text), a + personal_data.LONGEST)
            assert any(x <= a and b <= y for x, y in found)
    assert not personal_data.windows("") and not personal_data.windows("nothing here")


def test_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = personal_data.fit(docs)
    r = random.Random(12)
    clean = [x["text"][:200] for x in docs.orderBy("doc_id").limit(400).collect() if x["text"] and len(x["text"]) > 300 and not brute_spans(x["text"])]
    rows, truth = [(None, None), (1, ""), (2, "no marks"), (3, "9" * 20_000), (3, "9" * 20_000), (4, " ".join(ODD))], {}
    for i in range(300):
        kind, text = r.choice(personal_data.KINDS), r.choice(clean)
        value = personal_data._rewritten(kind, r)
        at = text.index(" ", 90) + 1
        rows.append((100 + i, text[:at] + value + " " + text[at:]))
        truth[100 + i] = f"{kind}:{at}:{at + len(value)}"
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    df = spark.createDataFrame([(*x, *CLASH) for x in rows], DOCS)
    got = personal_data.scan(df, model).collect()
    assert len(got) == len(rows)
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    caught = by_rules = 0
    for x in got:
        own = brute_spans(texts[x["doc_id"]][0])
        assert [x[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in own) for k in BASE]
        assert x["base_sha256"] == hashlib.sha256(said(own).encode()).hexdigest()
        spans = x["spans"].split(",") if x["spans"] else []
        assert set(said([s]) for s in own) <= set(spans)
        places = [(int(s.split(":")[1]), list(BASE).index(s.split(":")[0])) for s in spans]
        assert places == sorted(places)
        if x["doc_id"] in truth:
            caught += truth[x["doc_id"]] in spans
            by_rules += truth[x["doc_id"]] in set(said([s]) for s in own)
        if (x["doc_id"] or 0) >= 1000:
            assert not spans
    assert by_rules < 120 and caught > 200
    assert not personal_data.scan(df.limit(0), model).count()
    nothing = personal_data.fit(df.where("doc_id = 2"))
    assert nothing is None and personal_data.scan(df.where("doc_id = 2"), None).first()["spans"] == ""


def brute_whitening(rows):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in fine], np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    a = (n * u - s) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    y = (n * x - s) / n @ v[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
    return [i for i, _ in fine], n, ((n * x - s) ** 2).sum(1), y, e[::-1] / e.sum()


VECTORS = "vec_id long, embedding array<float>, x string, component string"


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 12)) @ np.diag(np.geomspace(30, 0.01, 12)) + 40
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(900, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (901, None), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12)] + [(905, rows[7][1])] * 40
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], VECTORS)
    w = whitening.fit(df)
    got = whitening.whiten(df, w).collect()
    ids, n, far, y, shares = brute_whitening(rows)
    assert w.n == n == 300 and len(got) == 4 * len(ids) and w.identity_error < 1e-9
    key = lambda i, d: (-1 if i is None else i, d)
    want = sorted((*key(i, int(d)), c + 1) for i, d in zip(ids, far) for c in range(4))
    assert sorted((*key(x["vec_id"], x["deviation"]), x["component"]) for x in got) == want
    for c in range(4):
        mine = {key(x["vec_id"], x["deviation"]): x for x in got if x["component"] == c + 1}
        signs = {np.sign(mine[key(i, int(d))]["whitened"] / v) for i, d, v in zip(ids, far, y[:, c])}
        assert len(signs) == 1
        for i, d, v in zip(ids, far, y[:, c]):
            x = mine[key(i, int(d))]
            assert abs(abs(x["whitened"]) - abs(v)) < 1e-9 and x["n"] == n and abs(x["explained"] / shares[c] - 1) < 1e-9


@pytest.mark.parametrize(
    "rows,components,n",
    [
        ([], 0, 0), ([(1, [1.0, 2.0])], 0, 1), ([(1, [1.0]), (2, [1.001])], 0, 1), ([(1, [0.0]), (2, [1.0])], 1, 2), ([(1, [1.0, 1.0, 5.0]), (2, [2.0, 2.0, 5.0]), (3, [4.0, 4.0, 5.0])], 1, 3),
        ([(1, []), (2, [1.0]), (3, [0.0, 3.0])], 2, 3), ([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], 1, 2), ([(1, None)], 0, 0), ([(1, [])], 0, 1),
    ],
)
def test_whitening_of_few_or_odd_vectors(spark, rows, components, n):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], VECTORS)
    w = whitening.fit(df)
    assert w.n == n and len(w.roots) == components
    assert whitening.whiten(df, w).count() == components * len([1 for _, v in rows if v is not None])


def test_shifted_passes_keep_small_directions(spark):
    """Variances fifteen orders apart, of which one Gram matrix's eigenvectors lose the small ones."""
    r = np.random.default_rng(5)
    wide, narrow = r.integers(-(2**29), 2**29, 200), r.integers(-4, 5, 200)
    rows = [(i, [float(a), float(a) + float(b), float(b % 3)]) for i, (a, b) in enumerate(zip(wide.tolist(), narrow.tolist()))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = whitening.fit(df)
    assert len(w.roots) == 3 and w.identity_error < 1e-4
    x = whitening.scaled(F.col("embedding"))
    assert df.select(x.alias("x")).first()["x"][0] == 256 * rows[0][1][0]
