"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Every text gets counts over its whole length. A fixed base rule rejects the
obviously broken. Beyond it, a ladder of levels tightens a cutoff of every feature
step by step, and a level counts only if labelled documents prove it harmless: over the
good labelled documents of a stratum that the base rule keeps, the exact binomial test of "this level's
cutoffs together reject more than ``alpha`` of the good ones" must have a p-value of at
most ``delta`` over the number of strata. A stratum's levels are tested in a fixed order, loosest
first, up to the first that is not proven, so they need no further correction, and strata are
corrected for by Bonferroni: the chance that any stratum loses more than ``alpha``
of the good documents that its base rule keeps is at most ``delta``; what the fixed base rule itself rejects is not
part of the guarantee. The strictest proven level is used; a stratum
with too few labels (fewer than ln(delta / strata) / ln(1 - alpha), 144 for four strata) keeps
everything that the base rule keeps.

Defined results: a null text counts as empty (no words, so the base rule
rejects it); a null or unlabelled stratum is a stratum of its own; a doc_id
labelled twice counts as good only if every label says so, and is one trial of a stratum however often
its rows are repeated there (rejected if any of them is); repeated rows are
judged each on its own; an empty table gives an empty result. Columns of the
input are kept as they are unless they clash with the result's names, which win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_texts, let, materialize, plain_text, table, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Share of a stratum's good documents that all cutoffs together may reject, and the chance that any stratum's is exceeded.
ALPHA, DELTA = 0.03, 0.05
#: Feature -> its cutoff at each level, strictest first; a document is rejected above a cutoff.
GRID: dict[str, list[float]] = {
    "symbol_share": [0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20, 0.30, 0.50],
    "dup_line_share": [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.70],
    "repeat_share": [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18],
    "mean_word_chars": [7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0, 30.0],
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(tokens: Column) -> Column:
    """Words in windows of five that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes; a text without two equal hashes ends there.
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + F.lit(d))["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, starts), union)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def judge(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    hashed = F.transform(tokens, lambda x: F.xxhash64(x))
    return let(hashed, lambda w: F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows(w), judge)))


def measured(docs: DataFrame) -> DataFrame:
    """Adds the struct ``_stats`` with every count: one expression, so each text is split once."""
    text = plain_text("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    zero = F.lit(0).cast("long")
    stats = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, zero, lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup.alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"),
        ),
    )
    return docs.drop("_stats").withColumn("_stats", stats)


def judged(stats: DataFrame) -> DataFrame:
    """Unpacks written ``_stats``; adds the base rule's verdict and the features that have cutoffs."""
    out = stats.drop(*STATS, "base_failed", "kept", *GRID).withColumns({c: F.col("_stats")[c] for c in STATS})
    n = F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.col("_stats")["n_lines"],
            "repeat_share": F.col("n_repeat_words") / n,
            "mean_word_chars": F.col("word_chars") / n,
        }
    ).drop("_stats")


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted so that it holds to 1e-11 for small n too."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    down = F.lit(0.0)
    for k in range(1, 9):
        down = down + F.log(n.cast("double") + float(k))
    return series - down


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k below n p; 1 for larger k.

    Sums the terms downwards from k; each is the one before times a ratio below 1.
    What would follow ``terms`` terms is bounded by a geometric series and added, so
    the value is never too small.
    """
    odds = (1 - p) / p
    nd, kd = n.cast("double"), k.cast("double")
    first = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        j = kd - i.cast("double")
        return F.struct((a["t"] * j / (nd - j + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s"))

    last = F.least(k, F.lit(terms).cast("long"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, step, lambda a: a)
    ratio = kd / (nd - kd + 1) * odds
    value = let(total, lambda a: first * (a["s"] + a["t"] / (1 - ratio)))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(value)


LEVELS = len(GRID["symbol_share"])


def _over(level: int) -> Column:
    """Whether any feature is above its cutoff of a level."""
    return reduce(lambda a, b: a | b, [F.col(f) > grid[level] for f, grid in GRID.items()])


def risk_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum its strictest proven level and that level's cutoffs (null: none is proven), with the labels (n) and those rejected (k) behind it."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1")
    held = stats.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id")
    trials = held.groupBy(F.col(stratum).alias("stratum"), "doc_id").agg(*[F.max(f).alias(f) for f in GRID])
    counts = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(_over(i)).alias(f"k_{i}") for i in range(LEVELS)])
    counts = materialize(counts, "rule-counts")
    least = delta / max(1, counts.count())
    steps = counts.select("stratum", "n", F.posexplode(F.array(*[f"k_{i}" for i in reversed(range(LEVELS))])).alias("step", "k"))
    passed = binomial_tail(F.col("n"), F.col("k"), alpha) <= least
    # The first step that fails, from the loosest on, ends the sequence.
    run = F.coalesce(F.min(F.when(~passed, F.col("step"))), F.lit(LEVELS))
    tested = steps.groupBy("stratum", "n").agg(run.alias("run"), F.array_sort(F.collect_list(F.struct("step", "k"))).alias("ks"))
    chosen = tested.withColumn("level", F.when(F.col("run") > 0, LEVELS - F.col("run")))
    cutoffs = [F.get(F.array(*map(F.lit, grid)), F.col("level")).alias(f"cut_{f}") for f, grid in GRID.items()]
    return materialize(chosen.select("stratum", "n", "level", F.get("ks", F.col("run") - 1)["k"].alias("k"), *cutoffs), "rule-cutoffs")


def apply_rules(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept``: not failed by the base rule and at or under every proven cutoff of its stratum."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), *[f"cut_{f}" for f in GRID])
    joined = stats.join(cuts, stats[stratum].eqNullSafe(cuts["_stratum"]), "left")
    over = F.lit(False)
    for f in GRID:
        over = over | F.coalesce(F.col(f) > F.col(f"cut_{f}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *[f"cut_{f}" for f in GRID])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with counts and verdicts; what is selected of ``docs`` is written once."""
    stats = judged(materialize(by_texts(measured(docs), docs.count()), "rule-stats"))
    return apply_rules(stats, risk_cutoffs(stats, labels))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = judged(materialize(measured(docs).drop("text"), "rule-stats"))
    out = apply_rules(stats, risk_cutoffs(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *STATS, "base_failed", "kept")
