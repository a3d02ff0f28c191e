"""The pipeline's stages one by one, also against brute force, and the registered corpus queries beside their SQL."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import same_rows
from peakloom.llm import queries
from test_documents import SCHEMA, WORD, check_pieces, fixture_rows, jaccard_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert max(ids.values()) == 1 and docs.count() <= before.count()
    assert 0 < docs.count() < first
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_registered_names():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same_rows(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["op2_additive_quantisation", "op3_html_extraction", "op4_packing", "op7_quality_classifier", "op10_byte_bpe"])
def test_query_covers_its_table(spark, sf_dir, name):
    """Queries without SQL: the contract's columns, and every row of the table."""
    got = queries.queries()[name](spark, sf_dir)
    known = {
        "op2_additive_quantisation": ("embeddings", "query_id", {"query_id", "rank", "vec_id", "score"}),
        "op3_html_extraction": ("pages", "page_id", {"page_id", "url", "text", "n_chars"}),
        "op4_packing": ("documents", "doc_id", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
        "op7_quality_classifier": ("documents", "doc_id", {"doc_id", "held_out", "score", "predicted"}),
        "op10_byte_bpe": ("documents", "doc_id", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    }
    table, key, columns = known[name]
    assert set(got.columns) == columns
    ids = {r[0] for r in got.select(key).distinct().collect()}
    own = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select("vec_id" if key == "query_id" else key).collect()}
    assert ids == ({i for i in own if i % 20 == 0} if key == "query_id" else own)


STAGE = dict(corpus_pipeline.STAGES)
CLASHES = ["spans", "kept", "k1", "secrets", "ids", "cls", "row", "stratum", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    df = spark.createDataFrame(fixture_rows(), SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    return spark.createDataFrame(df.collect(), df.schema).repartition(3)


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def _rejected(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {x for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    return len(w) < 10 or 100 * len(hit) > 20 * len(w)


def _without_repeats(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    gone = [{x for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for x in range(k, k + window)} for w in words]
    return [(i, [x for k, x in enumerate(w) if k not in g]) for (i, _), w, g in zip(rows, words, gone)]


def _hidden(text):
    """Texts with secrets replaced, one rule after another over the spans of all."""
    rules = [(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, "assign"), ("(AKIA[A-Z0-9]+)", 18, "access"), ("([0-9a-f]{16,})", 16, "hex"), ("(gh[pousr]_[A-Za-z0-9]{36,})", 40, "forge")]
    spans = sorted((m.start(), k, m.end(), kind) for k, (p, least, kind) in enumerate(rules) for m in re.finditer(p, text) if len(m[1]) >= least)
    out, at = "", 0
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_stages_on_odd_rows(spark, sf_dir, odd):
    """Each stage on the odd rows, against brute force; columns stay, and clashing ones are untouched."""
    rows = [(i, t) for i, t, *_ in fixture_rows()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns
        assert all(r[c] == "clash" for r in got.select(*CLASHES).collect() for c in CLASHES)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
        pairs = _pairs(got)
        if name == "quality rules":
            # Strata without labels of their own: the base rule decides, or a proven level rejects more.
            assert not pairs - Counter(x for x in rows if not _rejected(x[1])) and pairs[(6, dict(rows)[6])] == 1
        elif name == "near duplicates":
            groups = jaccard_components(rows, 5, 80)
            least = {i for (i, _, c), _ in groups.items() if i is not None and i == c}
            assert {i for i, _ in pairs if i is not None} == least
            assert Counter({x: n for x, n in pairs.items() if x[0] is None}) == Counter(x for x in rows if x[0] is None)
        elif name == "substring dedup":
            assert Counter((i, tuple(WORD.findall(t or ""))) for (i, t), n in pairs.items() for _ in range(n)) == Counter((i, tuple(w)) for i, w in _without_repeats(rows))
        else:
            assert Counter((i, t) for (i, t), n in pairs.items() for _ in range(n)) == Counter((i, t and _hidden(t)) for i, t in rows)
    pack = STAGE["packing"]
    check_pieces(pack(spark, odd, sf_dir).collect(), rows, 4096)
    assert pack(spark, odd.limit(0), sf_dir).count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline on a small folder of tables."""
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    shared = text(70)
    rows = [(i, text(r.randint(40, 90))) for i in range(40)] + [(i, f"{text(30)} {shared} {text(20)}") for i in range(40, 46)]
    rows += [(50, rows[3][1]), (51, rows[4][1] + " tail"), (52, "too short"), (53, text(30) + " password: hunter2hunter2 " + text(20)), (54, None)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(i, t) for i, t in rows if not _rejected(t)]
    keep = {i for (i, _, c), _ in jaccard_components(left, 5, 80).items() if i == c}
    left = [(i, t) for i, t in left if i in keep]
    left = [(i, _hidden(" ".join(w))) for i, w in _without_repeats(left)]
    assert {50, 51, 52, 54}.isdisjoint(i for i, _ in left) and any("[assign]" in t for _, t in left)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), left, 4096)


def test_stages_over_many_partitions_write_few_files(spark, monkeypatch):
    """A small table dealt over many partitions isn't written as a file for each of them, by no stage and no operator; no row is lost."""
    import sys

    import pyarrow.dataset as ds

    from peakloom.llm import common

    written, real = {}, common.materialize

    def kept(df, tag):
        out = real(df, tag)
        written[tag] = max(written.get(tag, 0), len(ds.dataset(out.scratch_path.removeprefix("file://")).files))
        return out

    for name, module in list(sys.modules.items()):
        if getattr(module, "materialize", None) is real and name.startswith(("peakloom.llm", "corpus_pipeline")):
            monkeypatch.setattr(module, "materialize", kept)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(40)
    docs = kept(docs, "given")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    few = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "16k"}
    for k, v in few.items():
        spark.conf.set(k, v)
    try:
        given, most = docs, 2 * spark.sparkContext.defaultParallelism
        assert written.pop("given") == 40
        for name, stage in corpus_pipeline.STAGES:
            if name == "near duplicates":
                n_kept = given.count()
            out = stage(spark, given, "/root/testdata/sf0.001")
            assert out.rdd.getNumPartitions() <= most
            given = kept(out, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n_kept and given.agg(F.sum("length")).first()[0] == given.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert {"described", "links", "sets", "edges", "tokens", "runs"} <= set(written)
    assert max(written.values()) <= most, written
