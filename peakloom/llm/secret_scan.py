r"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Each rule is a regular expression. From its syntax tree follows a Boolean
query that every matching text satisfies: alternatives of sets of mandatory
trigrams. The index holds a posting (trigram, document) for each trigram that
some rule's query names. Postings are joined with the queries' terms, counted by
document and alternative, and a document with all the trigrams of one
alternative is a candidate of that rule; only candidates are matched against the
expression itself. Rules without mandatory trigrams (a run of hexadecimal digits)
scan every text. The index only ever skips texts that cannot match.

Base rules, matched leftmost and without overlap per kind, a match being dropped
if it is too short: assign (a secret's name, a separator and 12+ characters),
access (``AKIA`` and 18+ characters in all), hex (16+ digits). Extra rules add spans.

Defined results: a null text counts as empty (no spans); a null doc_id is always
scanned; documents that share a doc_id are candidates together and are each
verified on their own text; repeated rows give repeated results; an empty table gives
an empty result; columns of the input that clash with the result's names are replaced.
Spans count code points and exclude their end. Lambdas see one text at a time, so
memory is bounded by the longest text.
"""

from __future__ import annotations

import re._parser as syntax
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import ascii_lower, let, plain_text, table


@dataclass(frozen=True)
class Rule:
    """kind; pattern (read alike by Java and Python); least length of ``group`` (0: whole match)."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = True


RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, False),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0, False),
]

#: Alternatives kept apart while a tree is read; more are dropped to "anything".
MOST = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(node) -> list[str] | None:
    """All strings a node can match, lower-cased, or None if too many or unbounded."""
    op, value = node
    name = str(op)
    if name == "LITERAL":
        return [chr(value).lower()]
    if name == "IN":
        out: set[str] = set()
        for o, v in value:
            if str(o) == "LITERAL":
                out.add(chr(v).lower())
            elif str(o) == "RANGE" and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _all(value[-1])
    if name == "BRANCH":
        parts = [_all(x) for x in value[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if name == "MAX_REPEAT":
        low, high, inner = value
        one = _all(inner)
        if one is None or high > 3:
            return None
        return sorted({"".join(t) for k in range(low, high + 1) for t in product(one, repeat=k)})
    return None


def _all(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MOST:
            return None
        out = [a + b for a in out for b in own]
    return out


def _alternatives(nodes) -> set[frozenset[str]]:
    """Sets of mandatory trigrams, one of which every match contains; an empty set means anything."""
    found: set[frozenset[str]] = {frozenset()}
    run = [""]

    def both(a: set, b: set) -> set:
        out = {x | y for x in a for y in b}
        return out if len(out) <= MOST else a

    def flush() -> None:
        nonlocal found, run
        found = both(found, {_trigrams(s) for s in run})
        run = [""]

    for node in nodes:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= MOST:
            run = [a + b for a in run for b in own]
            continue
        flush()
        if own is not None:
            run = own
        elif str(node[0]) == "SUBPATTERN":
            found = both(found, _alternatives(node[1][-1]))
        elif str(node[0]) == "BRANCH":
            found = both(found, {s for x in node[1][1] for s in _alternatives(x)})
        elif str(node[0]) == "MAX_REPEAT" and node[1][0] > 0:
            found = both(found, _alternatives(node[1][2]))
    flush()
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams (lower case); empty if the rule must scan every text."""
    found = _alternatives(syntax.parse(pattern))
    least = {a for a in found if not any(b < a for b in found)}
    return [] if frozenset() in found else sorted(least, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (doc_id, trigram) of the named trigrams over whole texts."""
    low = ascii_lower(plain_text("text"))
    held = let(low, lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in trigrams]), lambda g: g.isNotNull()))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): by intersecting postings, the indexed rules that each document may match."""
    terms = [(r.kind, i, g, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern)) for g in sorted(alt)]
    spark = docs.sparkSession
    query = spark.createDataFrame(terms, "kind string, alternative int, trigram string, needed int")
    postings = trigram_index(docs.where(F.col("doc_id").isNotNull()), sorted({t[2] for t in terms}))
    # The terms follow from the rules alone, so their number is fixed whatever the input.
    met = postings.join(F.broadcast(query), "trigram").groupBy("doc_id", "kind", "alternative", "needed")
    whole = met.agg(F.count_distinct("trigram").alias("n")).where("n = needed")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))


def _blocks(x: Column, each) -> Column:
    """``each`` of successive slices of an array, about as many as each has elements.

    Appending to an array copies it, and a substring is sought from a text's begin: blocks keep both to n * sqrt(n) steps.
    """
    width = F.ceil(F.sqrt(F.size(x))).cast("int")
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: each(F.slice(v, i, width)))
    return F.when(F.size(x) > 0, cut(x)).otherwise(F.array())


def _before(numbers: Column, join) -> Column:
    """For each number of an array, 0 and those before it, joined (added up, or the greatest of them)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    run = lambda x: F.aggregate(x, start, lambda a, n: F.struct(join(a["at"], n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def offset(blocks: Column) -> Column:
        first = run(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, first, lambda b, o: F.transform(b["out"], lambda v: join(v, o))))

    return let(numbers, lambda x: let(_blocks(x, run), offset))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, rank, kind) of a rule's matches: lengths of gaps and matches, added up."""
    rank = [r.kind for r in RULES].index(rule.kind)
    pattern = F.lit(rule.pattern)
    sizes = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))

    def placed(rows: Column) -> Column:
        steps = F.transform(rows, lambda x: x["g"] + x["n"])
        return let(_before(steps, lambda a, b: a + b), lambda before: F.zip_with(rows, before, span))

    def span(x: Column, at: Column) -> Column:
        s = at + x["g"]
        return F.when(x["k"] >= rule.least, F.struct(s.alias("start"), (s + x["n"]).alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind")))

    def rows(n: Column) -> Column:
        inner = sizes(rule.group) if rule.group else n
        return F.arrays_zip(n.alias("n"), inner.alias("k"), F.slice(gaps, F.lit(1), F.size(n)).alias("g"))

    found = let(let(sizes(0), rows), placed)
    return F.filter(found, lambda x: x.isNotNull())


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: the spans of all rules by start, then by the rules' order."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    clear = docs.drop("secrets", "_kinds")
    joined = clear.join(candidates(clear, indexed), "doc_id", "left") if indexed else clear.withColumn("_kinds", F.lit(None).cast("array<string>"))
    text = plain_text("text")
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")

    def found(rule: Rule) -> Column:
        if rule not in indexed:
            return F.when(text.rlike(rule.pattern), _spans(text, rule)).otherwise(empty)
        may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
        return F.when(may, _spans(text, rule)).otherwise(empty)

    return joined.withColumn("secrets", F.array_sort(F.concat(*[found(r) for r in rules]))).drop("_kinds").select(*clear.columns, "secrets")


def redact(scanned: DataFrame) -> DataFrame:
    """Replaces every span of ``secrets`` (overlapping ones as one) in ``text`` by its kind in brackets."""
    text = plain_text("text")

    def clean(spans: Column) -> Column:
        reached = _before(F.transform(spans, lambda x: x["end"]), F.greatest)
        fresh = lambda x, m: F.when(x["start"] >= m, F.struct(m.alias("a"), x["start"].alias("b"), x["kind"].alias("kind")))
        marked = F.filter(F.zip_with(spans, reached, fresh), lambda x: x.isNotNull())
        tail = F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text))
        return let(marked, lambda m: F.concat(F.array_join(F.flatten(_blocks(m, pieces)), ""), tail))

    def pieces(own: Column) -> Column:
        """What lies before each span of a block, with the span's kind."""

        def of(part: Column, first: Column) -> Column:
            return F.transform(own, lambda x: F.concat(F.substring(part, x["a"] - first + 1, x["b"] - x["a"]), F.lit("["), x["kind"], F.lit("]")))

        first, last = F.get(own, F.lit(0))["a"], F.element_at(own, -1)["b"]
        return let(F.struct(F.substring(text, first + 1, last - first).alias("part"), first.alias("first")), lambda x: of(x["part"], x["first"]))

    return scanned.withColumn("text", F.when(F.size("secrets") > 0, let(F.col("secrets"), clean)).otherwise(F.col("text")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    of = lambda k: F.filter("secrets", lambda x: x["kind"] == F.lit(k))
    counts = {f"n_{k}": F.size(of(k)).cast("long") for k in base}
    own = F.filter("secrets", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(_joined(own), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
