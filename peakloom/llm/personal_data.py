"""Personal data in texts: exact rules, and a character-level BiLSTM with CRF transitions for other notations.

Four kinds of span are known, each by a rule: email, ip, card, phone. The tagger learns them from labelled
spans: ``SAMPLE`` texts at most, picked by a threshold of their hashes, are searched by the rules, and ``SNIPPETS`` stretches about what
these find (and about digits and signs that they leave) are its labelled examples, each also written anew in notations
that the rules do not know: bracketed or spaced "at" and "dot", letters beyond ASCII, other separators, numbers without
a plus. It is trained on the driver in numpy, a bounded amount of work.

Every text is searched whole for marks: a digit, an @, or a bracketed "at"; a span that the tagger may add holds one and has at most
``LONGEST`` characters, so that stretches of ``LONGEST`` characters on both sides of all marks hold all of them, and the rest needs no
tagging. Stretches are cut into windows that overlap by half; each is decoded as the likeliest path. Of what the windows propose in one text, the
set without overlaps and with the largest sum of certainties is kept (reconciled globally, by the same
recurrence as for weighted intervals); a span seen in several windows counts by its largest certainty, and one
that a window's edge cuts counts nowhere, as the next window holds it whole. What overlaps a rule's span goes, and what remains must pass
its kind's exact check, so that a text without personal data stays without spans.

Defined results: null and empty texts have no spans; repeated rows give equal results; a table without any labelled span trains no
tagger, and the rules' spans are the result; an empty table gives an empty result; clashing columns play no part.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.char_tagger import PAD, Tagger, classes, trained
from peakloom.llm.common import table

KINDS = ["email", "ip", "card", "phone"]
#: Texts and snippets learnt from, snippets of one text, characters of a snippet, steps of training.
SAMPLE, SNIPPETS, PER_TEXT, LENGTH, STEPS = 4000, 500, 6, 64, 220
#: Longest added span, characters of a window (half of which the next one shares), windows tagged at once, least certainty of a span.
LONGEST, WINDOW, AT_ONCE, CERTAIN = 64, 128, 256, 0.5
Span = tuple[str, int, int]

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BEFORE_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]", re.IGNORECASE)
_AT, _DOT = re.compile(r" ?[(\[{<] ?at ?[)\]}>] ?| ?@ ?", re.IGNORECASE), re.compile(r" ?[(\[{<] ?dot ?[)\]}>] ?| ?\. ?", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a number, of whatever length, is at most 255."""
    return len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind: time in proportion to the text, as none of the searches goes back over it."""
    out: list[Span] = []
    after = 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > after and text[start - 1] in _BEFORE_HOST:
            start -= 1
        if start < m.start():
            out.append(("email", start, after := m.end()))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """The exact check of what the tagger proposes."""
    digits = _digits(text)
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", text))
        return re.fullmatch(r"[^\s@.][^\s@]*@[^\s@.]+(\.[^\s@.]+)+", plain) is not None and any(c.isalpha() for c in plain.rpartition(".")[2])
    if any(c.isalpha() for c in text) or not digits:
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and _small(p) for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", text)) > 1


def snippets_of(text: str, r: random.Random) -> list[tuple[str, str, int, int]]:
    """(text, kind, start, end) about some of the rules' spans, and, with an empty kind, about marks that belong to none."""
    spans = rule_spans(text)
    picked = r.sample(spans, min(PER_TEXT, len(spans)))
    out = []
    for kind, a, b in picked:
        if b - a < LENGTH - 8 and not any(s is not t and s[1] < b and a < s[2] for t in [(kind, a, b)] for s in spans if s != t):
            low, high = max(0, a - 40), b + 40
            out.append((text[low:high], kind, a - low, b - low))
    free = [m.start() for m in _MARK.finditer(text) if not any(a - 40 < m.start() < b + 40 for _, a, b in spans)] if len(spans) < 50 else []
    for at in r.sample(free, min(2, len(free))):
        out.append((text[max(0, at - 30) : at + 42], "", 0, 0))
    return out


def _rewritten(kind: str, r: random.Random) -> str:
    """A made-up value of a kind, in a notation that may be one the rules know."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    plain, wide = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzäöüéèñçøß"
    if kind == "email":
        at = r.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", "<at>", " [AT] "])
        dot = r.choice([".", ".", " . ", "(dot)", " [dot] ", "[dot]", " (dot) ", " [DOT] "])
        letters = r.choice([plain, wide])
        local = name(letters, 2, 9) + r.choice(["", ".", "_", "-"]) + r.choice(["", d(2), name(letters, 2, 6)])
        return local.rstrip("._-") + at + name(letters, 3, 9) + r.choice(["", dot + name(plain, 3, 8)]) + dot + r.choice(["com", "org", "net", "example", "de", "fr", "es", "io", "info"])
    if kind == "ip":
        sep = r.choice([".", "[.]", " . ", "(.)", "[dot]".replace("dot", "."), ". "])
        return sep.join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = d(r.choice([14, 15, 15, 15, 15]))
        full = next(head + c for c in "0123456789" if luhn(head + c))
        sep = r.choice(["", " ", "-", ".", "  ", "/", "_", "–", " - "])
        return sep.join([full[:4], full[4:8], full[8:12], full[12:]])
    area, mid, last = d(3), d(3), d(4)
    return r.choice([
        f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}", f"1 {area} {mid} {last}", f"001 {area} {mid} {last}", f"+1/{area}/{mid}{last}",
        f"0{area}/{mid}{last}", f"+{d(2)}_{area}_{mid}_{last}", f"+1 ({area}) {mid}-{last}", f"+{d(2)} {area} {mid}{last}", f"1-{area}-{mid}-{last}", f"+1–{area}–{mid}–{last}",
    ])


def training_rows(snippets: list[tuple[str, str, int, int]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character classes and of tags: the snippets as labelled, and the same with a value made up in place of theirs."""
    r = random.Random(seed)
    ids, tags = [], []

    def add(text: str, kind: str, a: int, b: int) -> None:
        low = max(0, min(a - r.randint(4, 24), len(text) - LENGTH)) if kind else 0
        row, tag = np.zeros(LENGTH, np.int16), np.zeros(LENGTH, np.int64)
        own = classes(text[low : low + LENGTH])
        row[: len(own)] = own
        if kind:
            k = 1 + 2 * KINDS.index(kind)
            tag[a - low] = k
            tag[a - low + 1 : b - low] = k + 1
        if not kind or b - low <= LENGTH:
            ids.append(row)
            tags.append(tag)

    for text, kind, a, b in snippets:
        add(text, kind, a, b)
        if kind:
            for other in KINDS:
                value = _rewritten(other, r)
                add(text[:a] + value + text[b:], other, a, a + len(value))
    return np.array(ids), np.array(tags)


def fit(docs: DataFrame) -> Tagger | None:
    """A tagger trained on a bounded sample of texts; none where the rules find nothing there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                h = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]
                rows += [(h, *s) for s in snippets_of(text, random.Random(h))]
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "text", "kind", "a", "b"), x)) for x in rows], schema=pa.schema([("h", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))

    n = docs.count()
    below = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    found = docs.select("text").where(F.col("text").isNotNull() & below).mapInArrow(each, "h string, text string, kind string, a int, b int").distinct()
    rows = found.orderBy("h", "text", "kind", "a").limit(4 * SNIPPETS).collect()
    by_kind = {k: [tuple(r)[1:] for r in rows if r["kind"] == k] for k in [*KINDS, ""]}
    if not any(by_kind[k] for k in KINDS):
        return None
    ids, tags = training_rows([s for k in by_kind for s in by_kind[k][: SNIPPETS // len(by_kind)]])
    return trained(ids, tags, len(KINDS), STEPS)


def windows(text: str) -> list[tuple[int, int]]:
    """Windows over all stretches about marks; in each stretch the next one begins where half of the one before is over."""
    out: list[tuple[int, int]] = []
    start = stop = -1
    bounds = []
    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - LONGEST), min(len(text), m.end() + LONGEST)
        if start >= 0 and a <= stop:
            stop = b
        else:
            bounds.append((start, stop))
            start, stop = a, b
    for start, stop in [*bounds, (start, stop)]:
        at = start
        while at < stop:
            out.append((at, min(at + WINDOW, stop)))
            if at + WINDOW >= stop:
                break
            at += WINDOW // 2
    return out


def proposals(model: Tagger, text_windows: list[str]) -> Iterator[list[tuple[int, int, int, float]]]:
    """Per window: (kind, start, end, certainty) of its spans."""
    for at in range(0, len(text_windows), AT_ONCE):
        some = text_windows[at : at + AT_ONCE]
        ids = np.full((len(some), max(map(len, some))), PAD, np.int16)
        for i, w in enumerate(some):
            ids[i, : len(w)] = classes(w)
        scores, _ = model.emissions(ids)
        z, a, b = model.marginals(scores)
        sure = np.exp(np.minimum(a + b - z[:, None, None], 0.0))
        tags = model.best(scores)
        sure = np.take_along_axis(sure, tags[..., None].astype(int), 2)[..., 0]
        for i, w in enumerate(some):
            found = []
            starts = np.flatnonzero(tags[i, : len(w)] % 2 == 1)
            for s in starts.tolist():
                e = s + 1
                while e < len(w) and tags[i, e] == tags[i, s] + 1:
                    e += 1
                found.append((int(tags[i, s] - 1) // 2, s, e, float(sure[i, s:e].min())))
            yield found


def reconciled(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end) with certainties, those without overlaps whose certainties add up to most."""
    rows = sorted(found.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [k[2] for k, _ in rows]
    value, take = [0.0], []
    for (_, start, _), sure in rows:
        before = int(np.searchsorted(ends[: len(take)], start, side="right"))
        take.append((value[before] + sure > value[-1], before))
        value.append(max(value[-1], value[before] + sure))
    out, i = [], len(rows)
    while i:
        if take[i - 1][0]:
            out.append(rows[i - 1][0])
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def added_spans(model: Tagger, texts: list[str], known: list[list[Span]]) -> list[list[Span]]:
    """What the tagger adds to the rules' spans of each text."""
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    found: list[dict] = [{} for _ in texts]
    for (i, a, b), spans in zip(where, proposals(model, [texts[i][a:b] for i, a, b in where])):
        for kind, s, e, sure in spans:
            cut = s == 0 and a > 0 or e == b - a and b < len(texts[i])
            if sure >= CERTAIN and not cut and e - s <= LONGEST:
                key = (kind, a + s, a + e)
                found[i][key] = max(sure, found[i].get(key, 0.0))
    out = []
    for text, own, spans in zip(texts, found, known):
        covered, free = sorted((a, b) for _, a, b in spans), []
        for kind, s, e in reconciled({k: v for k, v in own.items() if plausible(KINDS[k[0]], text[k[1] : k[2]]) and not _overlaps(covered, k[1], k[2])}):
            free.append((KINDS[kind], s, e))
        out.append(free)
    return out


def _overlaps(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in covered)


def scan(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, numbers of the rules' spans by kind, their digest, and all spans."""

    def said(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            known = [rule_spans(t) for t in texts]
            more = added_spans(model, texts, known) if model else [[] for _ in texts]
            every = [sorted(k + m, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for k, m in zip(known, more)]
            counts = [pa.array([sum(s[0] == kind for s in k) for k in known], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(said(k).encode()).hexdigest() for k in known], pa.string())
            columns = [b.column("doc_id"), *counts, digests, pa.array([said(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, f"doc_id long, {counts}, base_sha256 string, spans string")


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
