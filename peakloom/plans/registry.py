"""Registered queries over the given tables, and the DuckDB SQL that they equal.

Doubles are rounded to six digits on both sides, as sums may associate differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.functions.columns import clip
from peakloom.operators import budgets, chain, coverage, fragments, intervals, peaks, reads as read_ops, scoring, stats
from peakloom.session import cut
from peakloom.sources import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS, STEP = 6, views.STEP
#: The order of records; some share a number.
ORDER = ["rec_no", "start", "end"]

#: Views of the given tables, as common table expressions; a query names those it needs.
VIEWS = {
    "reads": """reads AS (SELECT 'chr'||(l_suppkey%5+1) AS chrom, 's'||(l_linenumber%3) AS sample_id, l_partkey*25 AS "start", l_partkey*25+l_quantity::BIGINT AS "end",
        (CASE WHEN l_returnflag='R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus='F' AND l_tax>0.06::DOUBLE THEN 1024 ELSE 0 END)::INT AS flag,
        round(l_discount*600)::INT AS mapq, l_orderkey*8+l_linenumber AS rec_no FROM lineitem)""",
    "kept": """kept AS (SELECT * FROM reads WHERE (flag & 3844)=0 AND mapq>=10)""",
    "pairs": """pairs AS (SELECT chrom, sample_id, "start", "end", mapq, rec_no, flag + 1 + CASE WHEN (rec_no//8)%4<>0 THEN 2 ELSE 0 END + CASE
    WHEN (rec_no%8)%2=0 THEN 128 ELSE 64 END
        + CASE WHEN (rec_no//8)%7=0 THEN 8 ELSE 0 END AS flag, CASE WHEN (flag & 16)<>0 THEN -(("start"*13)%1300) ELSE ("start"*13)%1300 END AS tlen,
        CASE WHEN (rec_no//8)%11=0 THEN 'chr0' ELSE chrom END AS mate_chrom, "end"-"start" AS qlen FROM reads)""",
    "proper": """proper AS (SELECT * FROM pairs
    WHERE (flag & 1)<>0 AND (flag & 2)<>0 AND (flag & 128)=0 AND (flag & 8)=0 AND mate_chrom=chrom AND tlen<>0 AND abs(tlen)>=qlen AND abs(tlen)<=1000)""",
    "fragments": """fragments AS (SELECT event_type AS chrom, epoch_us(ts::TIMESTAMP)//1000000 AS "start", epoch_us(ts::TIMESTAMP)//1000000+1+floor(value)::BIGINT AS "end", user_id::VARCHAR AS barcode, 1::BIGINT AS n FROM events)""",
    "regions": """regions AS (SELECT 'chr'||(o_custkey%5+1) AS chrom, (o_orderkey*37)%500000 AS "start", (o_orderkey*37)%500000+100+(o_orderkey%7)*50 AS "end"
    FROM orders)""",
    "sizes": """sizes AS (SELECT chrom, (ceil(max("end")/50.0::DOUBLE)*50)::BIGINT AS size, substr(chrom,4)::INT AS ord FROM reads GROUP BY 1)""",
    "signal": """signal AS (SELECT chrom, sample_id, bin*50 AS "start", count(*)::DOUBLE AS value
    FROM (SELECT chrom, sample_id, unnest(generate_series("start"//50,("end"-1)//50)) AS bin FROM kept) GROUP BY ALL)""",
    "matrix": """matrix AS (SELECT g.chrom, g.sample_id, g."start", coalesce(s.value,0.0::DOUBLE) AS value FROM (SELECT * FROM (SELECT DISTINCT chrom,"start"
    FROM signal) JOIN (SELECT DISTINCT chrom,sample_id FROM signal) USING (chrom)) g
        LEFT JOIN signal s ON g.chrom=s.chrom AND g.sample_id=s.sample_id AND g."start"=s."start")""",
    "scores": """scores AS (SELECT chrom, "start", m - median(m) OVER (PARTITION BY chrom) AS score FROM (SELECT chrom, "start", median(value) AS m FROM matrix
    GROUP BY 1,2))""",
    "centred": """centred AS (SELECT chrom, sample_id, "start", v - median(v) OVER (PARTITION BY chrom, sample_id) AS value
    FROM (SELECT *, log2(greatest(value,0)+1) AS v FROM matrix))""",
}
_NEEDS = {
    "kept": ["reads"], "pairs": ["reads"], "proper": ["pairs"], "sizes": ["reads"], "signal": ["kept"], "matrix": ["signal"], "scores": ["matrix"], "centred": ["matrix"],
}


def _with(names: str) -> str:
    out: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names.split():
        add(n)
    return "WITH RECURSIVE " + ", ".join(VIEWS[n] for n in out) if out else ""


def query(sql: str | None = None, uses: str = ""):
    """Registers a query by its function's name, with the SQL it equals."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = _with(uses)
            ORACLES[f.__name__] = (head + (", " if sql.lstrip().startswith("+") else " ") if head else "") + sql.lstrip().removeprefix("+")
        return f

    return add


def _r(c, name: str):
    return F.round(c, DIGITS).alias(name)


SPAN = ["chrom", "sample_id", "start", "end"]


@query("SELECT chrom, sample_id, \"start\", \"end\", flag, mapq FROM kept", "kept")
def read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ops.keep(views.reads(spark, sf_dir)).select(*SPAN, "flag", "mapq")


@query("SELECT chrom, sample_id, \"start\", \"end\" FROM kept WHERE (flag & 16)=16", "kept")
def read_filter_include(spark, sf_dir):
    return read_ops.keep(views.reads(spark, sf_dir), include=16).select(*SPAN)


@query("""SELECT chrom, sample_id, greatest(CASE WHEN tlen>=0 THEN "start" ELSE "end"-abs(tlen) END,0) AS "start", CASE
    WHEN tlen>=0 THEN "start"+abs(tlen) ELSE "end" END AS "end" FROM proper""", "proper")
def fragment_span(spark, sf_dir):
    return read_ops.fragment_spans(read_ops.proper_fragments(views.pairs(spark, sf_dir))).select(*SPAN)


@query("""SELECT chrom, sample_id, greatest(CASE WHEN (flag & 16)<>0 THEN "end"-3-150 ELSE "start"+2 END,0) AS "start", CASE
    WHEN (flag & 16)<>0 THEN "end"-3 ELSE "start"+2+150 END AS "end" FROM kept""", "kept")
def read_span_extended(spark, sf_dir):
    return read_ops.extended(read_ops.keep(views.reads(spark, sf_dir)), 150, 2, 3).select(*SPAN)


@query("""SELECT chrom, sample_id, greatest("start",5000) AS "start", least("end",20000) AS "end" FROM kept WHERE "end">5000 AND "start"<20000""", "kept")
def region_clip(spark, sf_dir):
    return read_ops.clipped(read_ops.keep(views.reads(spark, sf_dir)), 5000, 20000).select(*SPAN)


_COVER = """SELECT chrom, sample_id, bin*50 AS "start", count(*) AS n FROM (SELECT chrom, sample_id, unnest(generate_series({0})) AS bin FROM kept) GROUP BY ALL"""


@query(_COVER.format('"start"//50,("end"-1)//50'), "kept")
def coverage_bins(spark, sf_dir):
    return coverage.binned(read_ops.keep(views.reads(spark, sf_dir)), STEP)


@query(_COVER.format('"start"//50,("end"-1)//50'), "kept")
def coverage_delta(spark, sf_dir):
    return coverage.binned_by_deltas(read_ops.keep(views.reads(spark, sf_dir)), STEP)


@query("""SELECT chrom, sample_id, (("start"+"end")//2)//50*50 AS "start", count(*) AS n FROM kept GROUP BY ALL""", "kept")
def coverage_center(spark, sf_dir):
    return coverage.binned(read_ops.centres(read_ops.keep(views.reads(spark, sf_dir))), STEP)


@query("""SELECT chrom, sample_id, (CASE WHEN (flag & 16)<>0 THEN "end"-1 ELSE "start" END)//50*50 AS "start", count(*) AS n FROM kept GROUP BY ALL""", "kept")
def coverage_fiveprime(spark, sf_dir):
    return coverage.binned(read_ops.counted_spans(read_ops.keep(views.reads(spark, sf_dir)), "5p"), STEP)


@query("""SELECT * FROM (SELECT k.chrom, sample_id, greatest(CASE WHEN (flag & 16)<>0 THEN "end"-2000 ELSE "start" END,0) AS "start",
    least(CASE WHEN (flag & 16)<>0 THEN "end" ELSE "start"+2000 END,size) AS "end" FROM kept k JOIN sizes z ON k.chrom=z.chrom) WHERE "start"<"end\"""", "kept sizes")
def spans_within_contigs(spark, sf_dir):
    spans = read_ops.extended(read_ops.keep(views.reads(spark, sf_dir)), 2000)
    return read_ops.within_contigs(spans, views.chrom_sizes(spark, sf_dir)).select(*SPAN)


@query("""+c AS (SELECT sample_id, chrom, "start"//250 AS own, count(*) AS n FROM reads GROUP BY ALL),
w AS (SELECT chrom, m, chunk, greatest(least(chunk-10,m-21),0) AS lo FROM (SELECT chrom, m, unnest(range(0,m)) AS chunk
    FROM (SELECT chrom, ceil(size/250.0::DOUBLE)::BIGINT AS m FROM sizes)))
SELECT c.sample_id, w.chrom, w.chunk, sum(n)::BIGINT AS n FROM w JOIN c ON c.chrom=w.chrom AND c.own>=w.lo AND c.own<w.lo+21 AND c.own<m GROUP BY ALL""", "reads sizes")
def chunk_density(spark, sf_dir):
    return fragments.densities(views.reads(spark, sf_dir), views.chrom_sizes(spark, sf_dir), 250, 21)


@query()
def fragment_length_se(spark, sf_dir):
    """Strands of the given reads by position; tests hold the operator against brute force."""
    return fragments.single_end_lengths(views.pairs(spark, sf_dir), views.chrom_sizes(spark, sf_dir))


@query("""SELECT chrom, bin*3600 AS "start", sum(n)::BIGINT AS n FROM (SELECT chrom, n, unnest(generate_series("start"//3600,("end"-1)//3600)) AS bin FROM fragments)
    GROUP BY ALL""", "fragments")
def fragment_coverage(spark, sf_dir):
    return coverage.binned(views.fragments(spark, sf_dir), 3600, ["chrom"], "n")


@query("""SELECT chrom, p//3600*3600 AS "start", sum(n)::BIGINT AS n FROM (SELECT chrom, n, unnest([ "start", "end"-1 ]) AS p FROM fragments)
    GROUP BY ALL""", "fragments")
def fragment_cutsites(spark, sf_dir):
    return coverage.binned(read_ops.cut_sites(views.fragments(spark, sf_dir)), 3600, ["chrom"], "n")


@query("SELECT chrom, count(DISTINCT barcode) AS cells FROM fragments GROUP BY 1", "fragments")
def barcode_distinct(spark, sf_dir):
    return views.fragments(spark, sf_dir).groupBy("chrom").agg(F.count_distinct("barcode").alias("cells"))


@query("""SELECT chrom, count(*) AS n FROM fragments WHERE barcode IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey%3=0) GROUP BY 1""", "fragments")
def barcode_allow(spark, sf_dir):
    listed = views.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("barcode"))
    return read_ops.allowed(views.fragments(spark, sf_dir), listed).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT sample_id, count(*) FILTER (WHERE (flag & 4)=0) AS mapped, count(*) FILTER (WHERE (flag & 4)<>0) AS unmapped FROM reads
    WHERE chrom NOT IN ('chrX','chrY','chrM','chr5') GROUP BY 1""", "reads")
def mapped_counts(spark, sf_dir):
    kept = read_ops.on_chromosomes(views.reads(spark, sf_dir), skip=["chrX", "chrY", "chrM", "chr5"])
    return kept.groupBy("sample_id").agg(F.count_if(~read_ops.has(4)).alias("mapped"), F.count_if(read_ops.has(4)).alias("unmapped"))


#: Records of a sample in order, as operators that look at the first ones see them.
_FIRST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rec_no, "start", "end") AS k FROM pairs{0}) """


@query(
    "+" + _FIRST.format("") + """, fine AS (SELECT sample_id, qlen, row_number() OVER (PARTITION BY sample_id ORDER BY k) AS j FROM ranked
    WHERE k<=4096 AND (flag & 4)=0 AND qlen>0)
    SELECT sample_id, floor(median(qlen))::BIGINT AS length FROM fine WHERE j<=32 GROUP BY 1""", "pairs",
)
def read_length_median(spark, sf_dir):
    return read_ops.read_lengths(views.pairs(spark, sf_dir))


@query("+" + _FIRST.format(" WHERE mapq>=10 AND (flag & 2308)=0") + "SELECT sample_id, floor(quantile_cont(qlen,0.75))::BIGINT AS length FROM ranked WHERE k<=1000 GROUP BY 1", "pairs")
def read_length_p75(spark, sf_dir):
    return read_ops.mapped_lengths(views.pairs(spark, sf_dir))


@query(
    "+" + _FIRST.format(" WHERE (flag & 4)=0") + """, top AS (SELECT chrom FROM sizes ORDER BY size DESC, ord LIMIT 3),
    least AS (SELECT sample_id, least(greatest(floor(avg(qlen)),1),1000) AS low FROM ranked WHERE qlen>0 AND k<=4096 GROUP BY 1),
    mates AS (SELECT r.sample_id, low, abs(tlen) AS size, row_number() OVER (PARTITION BY r.sample_id ORDER BY k) AS j FROM ranked r
    JOIN least l ON r.sample_id=l.sample_id
        WHERE (flag & 1)<>0 AND (flag & 2)<>0 AND (flag & 128)=0 AND (flag & 8)=0 AND mate_chrom=chrom AND chrom IN (SELECT chrom
    FROM top) AND abs(tlen) BETWEEN low AND 1000)
    SELECT sample_id, least(greatest(floor(median(size)),max(low)),1000)::BIGINT AS length FROM mates WHERE j<=4096 GROUP BY 1""", "pairs sizes",
)
def fragment_length_pe(spark, sf_dir):
    found = fragments.paired_end_lengths(views.pairs(spark, sf_dir), views.chrom_sizes(spark, sf_dir))
    return found.select("sample_id", F.col("fragment").cast("long").alias("length"))


@query("+" + _FIRST.format("") + "SELECT sample_id, bool_or((flag & 1)<>0) AS paired FROM ranked WHERE k<=1000 GROUP BY 1", "pairs")
def paired_end(spark, sf_dir):
    return read_ops.paired_samples(views.pairs(spark, sf_dir))


@query(
    """+late AS (SELECT r.chrom, max_by("end", ("start"*1000000000+rec_no)*100+"end"-"start") AS e FROM kept r JOIN sizes z ON r.chrom=z.chrom WHERE "end">size-2000000
    GROUP BY 1)
    SELECT r.chrom, min("start") AS range_start, coalesce(max(e),max("end")) AS range_end FROM kept r JOIN sizes z ON r.chrom=z.chrom LEFT
    JOIN late ON late.chrom=r.chrom GROUP BY 1""", "kept sizes",
)
def chrom_range(spark, sf_dir):
    return coverage.covered_range(read_ops.keep(views.reads(spark, sf_dir)), views.chrom_sizes(spark, sf_dir))


@query("""SELECT chrom, (sum(greatest(n,1))*2)::BIGINT AS mapped FROM fragments WHERE chrom<>'view' AND barcode IN (SELECT c_custkey::VARCHAR FROM customer
    WHERE c_custkey%3=0) GROUP BY 1""", "fragments")
def fragment_totals(spark, sf_dir):
    listed = views.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("barcode"))
    return read_ops.fragment_totals(views.fragments(spark, sf_dir), "cutsite", ("chrom",), ["view"], listed)


@query("SELECT chrom, size, ord FROM sizes ORDER BY size DESC, ord LIMIT 3", "sizes")
def top_contigs(spark, sf_dir):
    return views.chrom_sizes(spark, sf_dir).orderBy(F.desc("size"), "ord").limit(3)


_NORM = """SELECT s.chrom, s.sample_id, s."start", round(s.value*({0}),5) AS value FROM signal s
    JOIN (SELECT sample_id, count(*)::DOUBLE AS mapped, avg("end"-"start") AS len FROM reads GROUP BY 1) m ON s.sample_id=m.sample_id"""


def _normalised(spark, sf_dir, method: str) -> DataFrame:
    found = views.reads(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("mapped"), F.avg(F.col("end") - F.col("start")).alias("len"))
    factors = found.select("sample_id", coverage.scale_factor(method, 1e8, STEP, F.col("mapped"), F.col("len")).alias("factor"))
    return coverage.scaled(views.signal(spark, sf_dir), factors)


@query(_NORM.format("1e8::DOUBLE/(greatest(m.mapped,1)*greatest(m.len,1))"), "signal")
def norm_rpgc(spark, sf_dir):
    return _normalised(spark, sf_dir, "RPGC").select("chrom", "sample_id", "start", "value")


@query(_NORM.format("1.0::DOUBLE/greatest(m.mapped/1e6::DOUBLE*0.05::DOUBLE,1e-12::DOUBLE)"), "signal")
def norm_rpkm(spark, sf_dir):
    return _normalised(spark, sf_dir, "RPKM").select("chrom", "sample_id", "start", "value")


@query(_NORM.format("1.0::DOUBLE/greatest(m.mapped/1e6::DOUBLE,1e-12::DOUBLE)"), "signal")
def norm_cpm(spark, sf_dir):
    return _normalised(spark, sf_dir, " CPM").select("chrom", "sample_id", "start", "value")


@query("""+z AS (SELECT chrom, sample_id, "start", CASE WHEN value>3 THEN value ELSE 0 END AS value FROM signal) SELECT z.* FROM z
    JOIN (SELECT chrom, sample_id, min("start") AS a, max("start") AS b FROM z WHERE value>0 GROUP BY 1,2) e ON z.chrom=e.chrom AND z.sample_id=e.sample_id
    WHERE z."start" BETWEEN a AND b""", "signal")
def track_trim(spark, sf_dir):
    track = views.signal(spark, sf_dir).withColumn("value", F.when(F.col("value") > 3, F.col("value")).otherwise(0.0))
    return coverage.trimmed(track).select("chrom", "sample_id", "start", "value")


def _matrix(spark, sf_dir) -> DataFrame:
    return coverage.matrix(views.signal(spark, sf_dir)).select("chrom", "sample_id", "start", "value")


def _scores(spark, sf_dir) -> DataFrame:
    m = stats.central(_matrix(spark, sf_dir), "median")
    middle = m.groupBy("chrom").agg(F.median("value").alias("_m"))
    return m.join(middle, "chrom").select("chrom", "start", (F.col("value") - F.col("_m")).alias("score"))


@query("SELECT * FROM matrix", "matrix")
def sample_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("""SELECT chrom, "start", round(median(value),6) AS value FROM matrix GROUP BY 1,2""", "matrix")
def central_median(spark, sf_dir):
    return stats.central(_matrix(spark, sf_dir), "median").select("chrom", "start", _r("value", "value"))


@query("""SELECT chrom, "start", round(avg(value),6) AS value FROM matrix GROUP BY 1,2""", "matrix")
def central_mean(spark, sf_dir):
    return stats.central(_matrix(spark, sf_dir), "mean").select("chrom", "start", _r("value", "value"))


@query("""SELECT chrom, "start", round(list_sort(list(value))[1+round_even((count(*)-1)*0.25::DOUBLE,0)::BIGINT],6) AS value FROM matrix GROUP BY 1,2""", "matrix")
def central_quantile_nearest(spark, sf_dir):
    return stats.central(_matrix(spark, sf_dir), "quantile", q=0.25).select("chrom", "start", _r("value", "value"))


_TRIM = """+lists AS (SELECT chrom, "start", list_sort(list(value)) AS l FROM matrix GROUP BY 1,2),
    inside AS (SELECT chrom, "start", list_filter(l, lambda x: x>=l[1+round_even((len(l)-1)*0.05::DOUBLE,0)::BIGINT] AND x<=l[1+round_even((len(l)-1)*0.95::DOUBLE,0)::BIGINT]) AS l FROM lists) """


@query(_TRIM + """SELECT chrom, "start", round(list_avg(l),6) AS value FROM inside""", "matrix")
def central_tmean(spark, sf_dir):
    return stats.central(_matrix(spark, sf_dir), "tmean").select("chrom", "start", _r("value", "value"))


@query("""SELECT chrom, "start", round(median(d),6) AS value FROM (SELECT *, abs(value-median(value) OVER (PARTITION BY chrom,"start")) AS d FROM matrix)
    GROUP BY 1,2""", "matrix")
def dispersion_mad(spark, sf_dir):
    return stats.dispersion(_matrix(spark, sf_dir), "mad").select("chrom", "start", _r("value", "value"))


@query("""SELECT chrom, "start", round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) AS value FROM matrix GROUP BY 1,2""", "matrix")
def dispersion_iqr(spark, sf_dir):
    return stats.dispersion(_matrix(spark, sf_dir), "iqr").select("chrom", "start", _r("value", "value"))


@query("""SELECT chrom, "start", round(stddev_pop(value),6) AS value FROM matrix GROUP BY 1,2""", "matrix")
def dispersion_std(spark, sf_dir):
    return stats.dispersion(_matrix(spark, sf_dir), "std").select("chrom", "start", _r("value", "value"))


@query(_TRIM + """SELECT chrom, "start", round(CASE WHEN len(l)>1 THEN list_stddev_samp(l) ELSE 0 END,6) AS value FROM inside""", "matrix")
def dispersion_tstd(spark, sf_dir):
    return stats.dispersion(_matrix(spark, sf_dir), "tstd").select("chrom", "start", _r("value", "value"))


@query("""+l AS (SELECT list_sort(list(score)) AS l FROM scores) SELECT q, round(l[1+ceil((len(l)-1)*q)::BIGINT],4) AS value
    FROM l, (SELECT unnest([0.01::DOUBLE,0.25::DOUBLE,0.5::DOUBLE,0.75::DOUBLE,0.99::DOUBLE]) AS q)""", "scores")
def score_quantiles_higher(spark, sf_dir):
    return stats.higher_quantiles(_scores(spark, sf_dir), [0.01, 0.25, 0.5, 0.75, 0.99], "score")


def _centred(spark, sf_dir) -> DataFrame:
    return stats.centred_log(_matrix(spark, sf_dir)).select("chrom", "sample_id", "start", "value")


@query("""SELECT chrom, sample_id, "start", round(value,6) AS value FROM centred""", "centred")
def log2_center(spark, sf_dir):
    return _centred(spark, sf_dir).select("chrom", "sample_id", "start", _r("value", "value"))


#: Windows of 31 loci, or of a short track's odd length; below five loci the spread about the median stands in.
VIEWS["variances"] = """numbered AS (
    SELECT *, CASE WHEN n>=31 THEN 31 ELSE n-1+n%2 END AS w FROM (SELECT *, row_number() OVER t - 1 AS i, count(*) OVER (PARTITION BY chrom,sample_id) AS n, lead(value)
    OVER t AS nx
    FROM centred WINDOW t AS (PARTITION BY chrom,sample_id ORDER BY "start"))),
mads AS (SELECT chrom, sample_id, median(d) AS mad FROM (SELECT chrom, sample_id, abs(value-median(value) OVER (PARTITION BY chrom,sample_id)) AS d FROM numbered
    WHERE n<5) GROUP BY 1,2),
sums AS (SELECT *, sum(value) OVER whole AS s, sum(value*value) OVER whole AS q, sum(value*nx) OVER pairs AS c, last_value(value) OVER whole AS l FROM numbered
    WINDOW whole AS (PARTITION BY chrom,sample_id ORDER BY "start" ROWS BETWEEN CURRENT ROW AND w-1 FOLLOWING), pairs AS (PARTITION BY chrom,sample_id
    ORDER BY "start" ROWS BETWEEN CURRENT ROW AND greatest(w-2,0) FOLLOWING)),
moments AS (SELECT *, greatest(q-w*m*m,0) AS g0, c-m*(s-l)-m*(s-value)+(w-1)*m*m AS g1 FROM (SELECT *, s/w AS m FROM sums)),
innovations AS (SELECT chrom, sample_id, i, greatest(g0/w*(1-beta*beta),0) AS v
    FROM (SELECT *, least(greatest(g1/(g0*(1+1.0::DOUBLE/(w+1))+1e-4::DOUBLE*(g0+1)),0),0.99::DOUBLE) AS beta FROM moments)),
variances AS (SELECT a.chrom, a.sample_id, a."start", a.value, CASE
    WHEN n<5 THEN greatest(pow(greatest(1.4826::DOUBLE*mad,1e-6::DOUBLE),2),1e-8::DOUBLE) ELSE greatest(b.v,1e-8::DOUBLE) END AS variance
    FROM numbered a LEFT JOIN mads ON a.chrom=mads.chrom AND a.sample_id=mads.sample_id
    JOIN innovations b ON a.chrom=b.chrom AND a.sample_id=b.sample_id AND b.i=least(greatest(a.i-w//2,0),a.n-w))"""
VIEWS["bins"] = """bins AS (
    SELECT chrom, sample_id, (r*b-1)//n AS bin, median(abs(value)) AS x, median(variance) AS v, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY chrom,sample_id ORDER BY round(abs(value),9),
    round(variance,9), "start") AS r, greatest(4,floor(1+log2(n+1)))::BIGINT AS b
        FROM (SELECT *, count(*) OVER (PARTITION BY chrom,sample_id) AS n FROM variances)) GROUP BY ALL)"""
_NEEDS |= {"variances": ["centred"], "bins": ["variances"]}


@query("""SELECT chrom, sample_id, "start", round(variance,6) AS variance FROM variances""", "variances")
def ar1_variance(spark, sf_dir):
    return scoring.local_variances(_centred(spark, sf_dir)).select("chrom", "sample_id", "start", _r("variance", "variance"))


@query("SELECT chrom, sample_id, bin, round(x,4) AS x, round(v,4) AS v, n FROM bins", "bins")
def variance_bins(spark, sf_dir):
    found = stats.variance_bins(scoring.local_variances(_centred(spark, sf_dir)))
    return found.select("chrom", "sample_id", "bin", F.round("x", 4).alias("x"), F.round("v", 4).alias("v"), "n")


@query("""+c AS (SELECT *, sum(n) OVER w AS w1, sum(n*v) OVER w AS s1 FROM bins WINDOW w AS (PARTITION BY chrom,sample_id ORDER BY bin)),
    pr AS (SELECT a.chrom, a.sample_id, a.bin AS a, b.bin AS b, (b.s1-(a.s1-a.n*a.v))/(b.w1-(a.w1-a.n)) AS mean FROM c a
    JOIN c b ON a.chrom=b.chrom AND a.sample_id=b.sample_id AND a.bin<=b.bin),
    tails AS (SELECT chrom, sample_id, a, b, min(mean) OVER (PARTITION BY chrom,sample_id,a ORDER BY b DESC) AS t FROM pr)
    SELECT chrom, sample_id, b AS bin, round(max(t),4) AS fit FROM tails GROUP BY 1,2,3""", "bins")
def variance_trend_pava(spark, sf_dir):
    found = stats.isotonic_trend(stats.variance_bins(scoring.local_variances(_centred(spark, sf_dir))))
    return found.select("chrom", "sample_id", "bin", F.round("fit", 4).alias("fit"))


@query("""SELECT chrom, "start", round(sum(value/m)/sum(1/m),6) AS mean, round(sqrt(1/sum(1/m)),6) AS standard_error, round(sum(value/m)/sum(1/m)/sqrt(1/sum(1/m))-1,6) AS score FROM (SELECT *, greatest((28*variance+5*0.1::DOUBLE)/33,1e-3::DOUBLE) AS m FROM variances) GROUP BY 1,2""", "variances")
def wls_combine(spark, sf_dir):
    v = scoring.local_variances(_centred(spark, sf_dir)).withColumns({"raw": F.col("variance"), "prior": F.lit(0.1)})
    v = v.withColumn("moderated", F.greatest((28 * F.col("raw") + 5 * F.col("prior")) / 33, F.lit(1e-3)))
    return stats.combine(v).select("chrom", "start", _r("mean", "mean"), _r("standard_error", "standard_error"), _r("score", "score"))


VIEWS["zs"] = """zs AS (SELECT a.chrom, a."start", a.d/s.sc AS z FROM (SELECT chrom, "start", score - median(score) OVER (PARTITION BY chrom) AS d FROM scores) a
    JOIN (SELECT chrom, greatest(1.4826::DOUBLE*median(abs(d)),1e-6::DOUBLE) AS sc FROM (SELECT chrom, score - median(score) OVER (PARTITION BY chrom) AS d FROM scores)
    WHERE d<=0 GROUP BY 1) s ON a.chrom=s.chrom)"""
_NEEDS["zs"] = ["scores"]


@query("""SELECT chrom, "start", round(z,6) AS z FROM zs""", "zs")
def z_standardize(spark, sf_dir):
    return stats.standardised(_scores(spark, sf_dir), "score").select("chrom", "start", _r("z", "z"))


@query(
    """SELECT zs.chrom, count(*) FILTER (WHERE z>2 AND score>1.5::DOUBLE) AS candidates, count(*) AS loci
    FROM zs JOIN scores ON scores.chrom=zs.chrom AND scores."start"=zs."start" GROUP BY 1""", "zs",
)
def candidate_mask(spark, sf_dir):
    z = stats.exceeding(stats.standardised(_scores(spark, sf_dir), "score"), 2.0, 1.5)
    return z.groupBy("chrom").agg(F.count_if("candidate").alias("candidates"), F.count(F.lit(1)).alias("loci"))


_P = "orders_p AS (SELECT o_orderkey AS k, ((o_orderkey*7919)%100003)*((o_orderkey*7919)%100003)/10000600009.0::DOUBLE AS p FROM orders)"


def _p_values(spark, sf_dir) -> DataFrame:
    x = (F.col("o_orderkey") * 7919) % 100003
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (x * x / F.lit(10000600009.0)).alias("p"))


@query(f"""WITH {_P}, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM orders_p)
    SELECT k, round(p,6) AS p, round(least(1,min(p*m/r) OVER (ORDER BY p DESC)),6) AS q FROM r""")
def bh_qvalues(spark, sf_dir):
    return stats.q_values(_p_values(spark, sf_dir)).select("k", _r("p", "p"), _r("q", "q"))


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM orders_p) SELECT k FROM r WHERE p<=coalesce((SELECT max(p) FROM r
    WHERE p<=0.01::DOUBLE*r/m),-1)""")
def bh_mask(spark, sf_dir):
    return stats.q_values(_p_values(spark, sf_dir)).where("q <= 0.01").select("k")


@query("""SELECT chrom, sample_id, "start", round(value-greatest(avg(value) OVER (PARTITION BY chrom,"start"),0),6) AS value FROM centred""", "centred")
def residual_template(spark, sf_dir):
    return budgets.residuals(_centred(spark, sf_dir)).select("chrom", "sample_id", "start", _r("value", "value"))


@query("""SELECT chrom, round(avg(CASE WHEN score>1.5 THEN 1.0::DOUBLE ELSE 0 END),6) AS tail_share, round(avg(CASE
    WHEN score>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS positive_share, round(avg(greatest(score-1.5::DOUBLE,0))/2,6) AS excess FROM scores GROUP BY 1""", "scores")
def tail_occupancy(spark, sf_dir):
    return budgets.occupancy(_scores(spark, sf_dir), 1.5, 2.0).select("chrom", _r("tail_share", "tail_share"), _r("positive_share", "positive_share"), _r("excess", "excess"))


@query("""+y AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY "start") AS i, score-avg(score) OVER (PARTITION BY chrom) AS y, count(*)
    OVER (PARTITION BY chrom) AS n FROM scores) SELECT a.chrom, k::INT AS lag, round(sum(a.y*b.y)/(max(a.n)-k),6) AS autocovariance
    FROM y a, (SELECT unnest(range(6)) AS k), y b WHERE a.chrom=b.chrom AND b.i=a.i+k GROUP BY 1,2,k""", "scores")
def autocov_lags(spark, sf_dir):
    return stats.autocovariance(_scores(spark, sf_dir), 5, "score").select("chrom", "lag", _r("autocovariance", "autocovariance"))


#: Autocorrelation time of the scores' soft exceedance: pairs of lags are added up as long as they are positive.
_GAMMA = """+s AS (SELECT chrom, score, row_number() OVER (PARTITION BY chrom ORDER BY "start") AS i, count(*) OVER (PARTITION BY chrom) AS n, median(score)
    OVER (PARTITION BY chrom) AS m FROM scores),
sc AS (SELECT chrom, greatest(1.4826::DOUBLE*median(m-score),1e-6::DOUBLE) AS sc FROM s WHERE score<m GROUP BY 1),
x AS (SELECT s.chrom, i, n, least(greatest((score-m)/coalesce(sc,1e-6::DOUBLE)-2,0),1) AS x FROM s LEFT JOIN sc ON s.chrom=sc.chrom),
y AS (SELECT *, x-avg(x) OVER (PARTITION BY chrom) AS y FROM x),
wide AS (SELECT chrom, i, n, y, unnest(range(0, 1+least(n-1,greatest(16,4*least(n,101))))) AS k FROM y),
cov AS (SELECT a.chrom, a.k, sum(a.y*b.y)/(max(a.n)-a.k) AS c FROM wide a JOIN y b ON b.chrom=a.chrom AND b.i=a.i+a.k GROUP BY 1,2),
rho AS (SELECT a.chrom, a.k, least(greatest(a.c/b.c,-1),1) AS r FROM cov a JOIN cov b ON b.chrom=a.chrom AND b.k=0 WHERE a.k>=1 AND b.c>1e-12::DOUBLE),
pairs AS (SELECT chrom, (k-1)//2 AS j, sum(r) AS p FROM rho GROUP BY 1,2 HAVING count(*)=2),
taus AS (SELECT chrom, 1+2*sum(p) AS tau FROM pairs WHERE j<coalesce((SELECT min(j) FROM pairs q WHERE q.chrom=pairs.chrom AND q.p<=0),1000000) GROUP BY 1)
SELECT s.chrom, round(least(greatest(0.5::DOUBLE*ceil(greatest(coalesce(max(tau),1),1))*coalesce(median(score) FILTER (WHERE score>0),1),0.5::DOUBLE),10),6) AS gamma,
count(*) FILTER (WHERE score>0) AS n_positive FROM s LEFT JOIN taus ON s.chrom=taus.chrom GROUP BY 1"""


@query(_GAMMA, "scores")
def gamma_auto(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return chain.gamma(s, budgets.bootstrap_budget(s, draws=0)).select("chrom", _r("gamma", "gamma"), "n_positive")


@query("""SELECT chrom, round(least(greatest((count(*) FILTER (WHERE score>1))/count(*)::DOUBLE*2,0.005::DOUBLE),0.1::DOUBLE),6) AS budget FROM scores
    GROUP BY 1""", "scores")
def budget_clip(spark, sf_dir):
    raw = _scores(spark, sf_dir).groupBy("chrom").agg((F.count_if(F.col("score") > 1) / F.count(F.lit(1))).alias("raw"))
    return raw.select("chrom", _r(chain.final_budget(F.col("raw"), 2.0), "budget"))


#: Forward pass of the chain as a recursion, then the fill from the right, at penalty 1 and switch cost 1.
_CHAIN = """+s AS (SELECT chrom, "start", score, row_number() OVER (PARTITION BY chrom ORDER BY "start") AS i, count(*) OVER (PARTITION BY chrom) AS n FROM scores),
f AS (SELECT chrom, i, n, score-1 AS d, -1 AS e FROM s WHERE i=1 UNION ALL SELECT s.chrom, s.i, s.n, (CASE WHEN f.d<-1 OR (f.d=-1 AND f.e<0) THEN -1
    WHEN f.d>1 OR (f.d=1 AND f.e>0) THEN 1 ELSE f.d END)+s.score-1, (CASE WHEN f.d<-1 OR (f.d=-1 AND f.e<0) THEN 0 WHEN f.d>1 OR (f.d=1 AND f.e>0) THEN 0 ELSE f.e END)-1
    FROM f JOIN s ON s.chrom=f.chrom AND s.i=f.i+1),
v AS (SELECT chrom, i, CASE WHEN i=n THEN CASE WHEN d>0 OR (d=0 AND e>0) THEN 1 ELSE 0 END WHEN d>1 OR (d=1 AND e>0) THEN 1 WHEN d<-1 OR (d=-1 AND e<0) THEN 0 END AS z
    FROM f),
zz AS (SELECT s.chrom, s."start", s.score, s.i, s.n, first_value(v.z IGNORE NULLS) OVER (PARTITION BY s.chrom
    ORDER BY s.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM s JOIN v ON s.chrom=v.chrom AND s.i=v.i) """


@query(_CHAIN + """SELECT chrom, "start", z::SMALLINT AS z FROM zz""", "scores")
def chain_solve(spark, sf_dir):
    return chain.select(_scores(spark, sf_dir), 1.0, penalty=1.0).select("chrom", "start", "z")


@query(_CHAIN + """SELECT chrom, round(sum(-score*z)+sum(coalesce(abs(z-lz),0)),6) AS objective FROM (SELECT *, lag(z) OVER (PARTITION BY chrom ORDER BY i) AS lz
    FROM zz) GROUP BY 1""", "scores")
def objective_value(spark, sf_dir):
    found = chain.select(_scores(spark, sf_dir), 1.0, penalty=1.0).withColumn("cost", F.lit(1.0))
    return stats.objective(found).select("chrom", _r("objective", "objective"))


_MERGE = """SELECT chrom, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY chrom
    ORDER BY "start","end" ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN "start"<=max("end") OVER (PARTITION BY chrom
    ORDER BY "start","end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {0})) GROUP BY chrom, g"""
_BINS = """, sel AS (SELECT chrom, "start", nx AS "end" FROM (SELECT *, lead("start") OVER (PARTITION BY chrom ORDER BY i) AS nx FROM zz)
    WHERE z=1 AND nx IS NOT NULL) """


def _peaks(spark, sf_dir) -> DataFrame:
    return intervals.selected_regions(chain.select(_scores(spark, sf_dir), 1.0, penalty=1.0), STEP)


@query(_CHAIN + _BINS + _MERGE.format("sel"), "scores")
def peaks_merge(spark, sf_dir):
    """Flagship: consensus regions from reads, end to end."""
    return _peaks(spark, sf_dir)


@query(_CHAIN + _BINS + f"""SELECT * FROM ({_MERGE.format("sel")}) WHERE "end"-"start">=150""", "scores")
def peaks_min_length(spark, sf_dir):
    return intervals.long_enough(_peaks(spark, sf_dir), 150)


@query(_MERGE.format("regions"), "regions")
def regions_merge(spark, sf_dir):
    return intervals.merged(views.regions(spark, sf_dir))


@query(_CHAIN + _BINS + """, un AS (SELECT chrom, "start", "end" FROM regions UNION ALL SELECT * FROM sel) """ + _MERGE.format("un"), "scores regions")
def peaks_combine(spark, sf_dir):
    return intervals.combined(views.regions(spark, sf_dir), _peaks(spark, sf_dir))


@query("""SELECT p.chrom, p."start", p."end", r.sample_id, count(*) AS n FROM regions p JOIN kept r ON p.chrom=r.chrom AND p."start"<r."end" AND r."start"<p."end"
    GROUP BY ALL""", "regions kept")
def interval_counts(spark, sf_dir):
    return intervals.overlap_counts(views.regions(spark, sf_dir), read_ops.keep(views.reads(spark, sf_dir)))


@query("""+x AS (SELECT DISTINCT chrom, "start", "end" FROM regions), c AS (SELECT x.*, s.sample_id, (SELECT count(*) FROM kept r
    WHERE r.chrom=x.chrom AND r.sample_id=s.sample_id AND r."start"<x."end" AND x."start"<r."end") AS n FROM x, (SELECT DISTINCT sample_id FROM kept) s)
SELECT chrom, "start", "end", coalesce(sum(n) FILTER (WHERE sample_id='s0'),0)::BIGINT AS s0, coalesce(sum(n) FILTER (WHERE sample_id='s1'),0)::BIGINT AS s1, coalesce(sum(n) FILTER (WHERE sample_id='s2'),0)::BIGINT AS s2 FROM c GROUP BY 1,2,3""", "regions kept")
def count_matrix(spark, sf_dir):
    kept = read_ops.keep(views.reads(spark, sf_dir))
    cells = peaks.counted(views.regions(spark, sf_dir).distinct(), kept, kept.select("sample_id").distinct())
    return cells.groupBy("chrom", "start", "end").pivot("sample_id", ["s0", "s1", "s2"]).agg(F.sum("n")).na.fill(0)


@query(f"""+a AS ({_MERGE.format("(SELECT * FROM regions WHERE (\"start\"//37)%2=0)")}), b AS ({_MERGE.format("(SELECT * FROM regions WHERE (\"start\"//37)%3=0)")}),
    i AS (SELECT coalesce(sum(least(a."end",b."end")-greatest(a."start",b."start")),0)::BIGINT AS x FROM a
    JOIN b ON a.chrom=b.chrom AND a."start"<b."end" AND b."start"<a."end")
SELECT x AS "both", ((SELECT sum("end"-"start") FROM a)+(SELECT sum("end"-"start") FROM b)-x)::BIGINT AS either, round(x/((SELECT sum("end"-"start")
    FROM a)+(SELECT sum("end"-"start") FROM b)-x)::DOUBLE,6) AS jaccard FROM i""", "regions")
def interval_jaccard(spark, sf_dir):
    r = views.regions(spark, sf_dir)
    found = intervals.jaccard(r.where("(start div 37) % 2 = 0"), r.where("(start div 37) % 3 = 0"))
    return found.select("both", "either", _r("jaccard", "jaccard"))


@query("""+x AS (SELECT DISTINCT chrom, "start", "end" FROM regions),
    t AS (SELECT x.chrom, x."start", x."end", max_by(s."start", s.score*1e9::DOUBLE - s."start") AS best FROM x LEFT
    JOIN scores s ON s.chrom=x.chrom AND s."start">=x."start" AND s."start"<x."end" GROUP BY 1,2,3) SELECT chrom, "start", "end", CASE
    WHEN best IS NULL THEN -1 ELSE greatest(least(best+25-"start","end"-"start"-1),0) END AS "offset" FROM t""", "regions scores")
def summit_offsets(spark, sf_dir):
    loci = _scores(spark, sf_dir).withColumnRenamed("score", "value")
    return intervals.summits(views.regions(spark, sf_dir), loci, STEP)


@query("""+obs AS (SELECT "start", chrom, score AS value FROM scores WHERE chrom<>'chr1'), nul AS (SELECT list_sort(list(score)) AS l FROM scores WHERE chrom='chr1'),
    d AS (SELECT DISTINCT value FROM obs), pp AS (SELECT value, (len(l)-len(list_filter(l, lambda x: x<value))+1)/(len(l)+1)::DOUBLE AS p FROM d, nul)
    SELECT obs.chrom, obs."start", round(p,6) AS p FROM obs JOIN pp USING (value)""", "scores")
def ecdf_survival(spark, sf_dir):
    s = _scores(spark, sf_dir).select("chrom", "start", F.col("score").alias("value"), F.lit(0).alias("g"))
    found = stats.survival(s.where("chrom <> 'chr1'"), s.where("chrom = 'chr1'"), "g")
    return found.select("chrom", "start", _r("p", "p"))


_STAT = """x AS (SELECT DISTINCT chrom, "start", "end" FROM regions),
hits AS (SELECT x.*, r.sample_id, count(*) AS n FROM x JOIN kept r ON x.chrom=r.chrom AND x."start"<r."end" AND r."start"<x."end" GROUP BY ALL),
c AS (SELECT x.*, s.sample_id, coalesce(n,0) AS n FROM x CROSS JOIN (SELECT DISTINCT sample_id FROM kept) s
    LEFT JOIN hits h ON h.chrom=x.chrom AND h."start"=x."start" AND h."end"=x."end" AND h.sample_id=s.sample_id),
st AS (SELECT chrom, "start", "end", quantile_cont(log2(greatest(n*1000.0::DOUBLE/("end"-"start")+1,1)),0.75) AS value FROM c GROUP BY 1,2,3)"""


def _stat(spark, sf_dir) -> DataFrame:
    """Raw counts of every region and sample, zeros included; ``peaks.narrow_peaks`` scales counts."""
    kept = read_ops.keep(views.reads(spark, sf_dir))
    return stats.peak_signal(peaks.counted(views.regions(spark, sf_dir).distinct(), kept, kept.select("sample_id").distinct()))


@query(f"""+{_STAT} SELECT chrom, "start", "end", round(value,6) AS value FROM st""", "regions kept")
def peak_signal_stat(spark, sf_dir):
    return _stat(spark, sf_dir).select("chrom", "start", "end", _r("value", "value"))


@query(f"""+{_STAT}, top AS (SELECT quantile_cont(value,0.99) AS q FROM st)
    SELECT chrom, "start", "end", floor(least(250+value/q*750,1000)+1e-9::DOUBLE)::INT AS score, round(-log10(("start"%997+1)/1000.0::DOUBLE+1e-10::DOUBLE),4) AS p_score
    FROM st, top""", "regions kept")
def narrowpeak_score(spark, sf_dir):
    rows = _stat(spark, sf_dir).withColumn("p", (F.col("start") % 997 + 1) / 1000.0)
    rows = rows.withColumn("q", F.col("p")).withColumn("value", F.col("value") + 1e-12)
    return stats.display_score(rows).select("chrom", "start", "end", "score", "p_score")


@query("""SELECT chrom, count(DISTINCT d) AS steps FROM (SELECT chrom, lead("start") OVER (PARTITION BY chrom ORDER BY "start")-"start" AS d FROM scores)
    GROUP BY 1""", "scores")
def fixed_step_check(spark, sf_dir):
    w = Window.partitionBy("chrom").orderBy("start")
    gaps = _scores(spark, sf_dir).withColumn("d", F.lead("start").over(w) - F.col("start"))
    return gaps.groupBy("chrom").agg(F.count_distinct("d").alias("steps"))


@query()
def whittaker_baseline(spark, sf_dir):
    found = scoring.moderated(_centred(spark, sf_dir))
    return found.select("chrom", "sample_id", "start", _r("value", "value"))


@query()
def score_loci(spark, sf_dir):
    return scoring.score_loci(_matrix(spark, sf_dir))


@query()
def wild_bootstrap_budget(spark, sf_dir):
    return budgets.bootstrap_budget(_scores(spark, sf_dir))


@query()
def eb_budgets(spark, sf_dir):
    return budgets.shrunk_budgets(budgets.bootstrap_budget(_scores(spark, sf_dir)))


@query()
def consensus_peaks(spark, sf_dir):
    """Reads to regions with estimated budgets: scoring, bootstrap, shrinkage, calibrated chain."""
    tracks = cut(scoring.moderated(_centred(spark, sf_dir)))
    s = cut(stats.combine(tracks))
    shares = cut(budgets.matrix_budget(tracks, s))
    found = budgets.shrunk_budgets(shares)
    found = found.withColumn("budget", clip(F.col("budget"), 0.005, 0.1))
    return intervals.selected_regions(chain.select(s, chain.gamma(s, shares), budgets=found), STEP)


@query()
def narrowpeak_full(spark, sf_dir):
    reads = views.reads(spark, sf_dir)
    return peaks.narrow_peaks(_peaks(spark, sf_dir), read_ops.keep(reads), views.chrom_sizes(spark, sf_dir), aligned=reads)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
