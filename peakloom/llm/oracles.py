"""DuckDB SQL for the registered corpus queries that SQL can express."""

from peakloom.llm.quality_rules import ALPHA, DELTA, GRID, LEVELS, MAX_REPEAT_PERCENT, MIN_WORDS
from peakloom.llm.secret_scan import RULES

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP1 = """WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html,'') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, octet_length(encode(h)) AS b, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS k FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', substr(x, 5*(i//4)+1, 1))-1)*65536 + (strpos('0123456789abcdef', substr(x, 5*(i//4)+2, 1))-1)*4096
 + (strpos('0123456789abcdef', substr(x, 5*(i//4)+3, 1))-1)*256 + (strpos('0123456789abcdef', substr(x, 5*(i//4)+4, 1))-1)*16 + (strpos('0123456789abcdef', substr(x, 5*(i//4)+5, 1))-1)) // (32768 >> (5*(i%4))::INT)) % 32, 1)), lambda a, c: a || c) AS payload_digest,
CASE WHEN k=1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k>1 THEN top END AS refers_to FROM d"""

_GRID = ", ".join(f"({i}, {', '.join(f'{grid[i]}::DOUBLE' for grid in GRID.values())})" for i in range(LEVELS))
_OP6 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text,'') AS t, {_WORDS.format("coalesce(text,'')")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w)-3)) AS i FROM w WHERE len(w)>=5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c>1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i+5)) AS j FROM twice) GROUP BY 1),
f AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))),0)::BIGINT AS word_chars, (length(t)-length(regexp_replace(t,'[#*$%&|<>]','','g')))::BIGINT AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, len(string_split(t, chr(10))) AS n_lines, coalesce(rep.n,0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.r=rep.r),
g AS (SELECT *, (len(l)-len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words<{MIN_WORDS} OR 100*n_repeat_words>{MAX_REPEAT_PERCENT}*n_words AS base_failed FROM f),
h AS (SELECT *, {{'symbol_share': n_symbols/greatest(word_chars,1)::DOUBLE, 'dup_line_share': n_dup_lines/n_lines::DOUBLE, 'repeat_share': n_repeat_words/greatest(n_words,1)::DOUBLE, 'mean_word_chars': word_chars/greatest(n_words,1)::DOUBLE}} AS x FROM g),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING min(quality)=1),
trials AS (SELECT lang, h.doc_id, max(x.symbol_share) AS s, max(x.dup_line_share) AS d, max(x.repeat_share) AS p, max(x.mean_word_chars) AS m FROM h JOIN good ON h.doc_id=good.doc_id WHERE NOT base_failed GROUP BY 1,2),
grid(level, s, d, p, m) AS (VALUES {_GRID}),
c AS (SELECT t.lang, grid.level, count(*) AS n, count(*) FILTER (WHERE t.s>grid.s OR t.d>grid.d OR t.p>grid.p OR t.m>grid.m) AS k FROM trials t, grid GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k>=n*{ALPHA!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(k+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln({ALPHA!r}::DOUBLE)+(n-i)*ln(1-{ALPHA!r}::DOUBLE)))) END AS q FROM c),
proven AS (SELECT lang, level, bool_and(q<={DELTA!r}::DOUBLE/(SELECT count(DISTINCT coalesce(lang,'')) FROM c)) OVER (PARTITION BY lang ORDER BY level DESC) AS ok FROM tails),
cuts AS (SELECT lang, min(level) AS level FROM proven WHERE ok GROUP BY 1)
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(x.symbol_share>grid.s OR x.dup_line_share>grid.d OR x.repeat_share>grid.p OR x.mean_word_chars>grid.m, false) AS kept
FROM h LEFT JOIN cuts ON h.lang IS NOT DISTINCT FROM cuts.lang LEFT JOIN grid ON grid.level=cuts.level"""


def _spans(rule, rank: int) -> str:
    """One rule's spans: positions from the lengths of gaps and matches before each."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))),0) AS s, length(m[i]) AS n, length(k[i]) AS size, {rule.least} AS least
 FROM (SELECT r, g, m, k, unnest(range(1, len(m)+1)) AS i FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS k FROM d))"""


_BASE = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
_OP9 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS t FROM documents),
a AS ({" UNION ALL ".join(_spans(r, i) for i, r in enumerate(RULES))}),
s AS (SELECT r, rank, kind, s, kind||':'||s::BIGINT||':'||(s+n)::BIGINT AS x FROM a WHERE size>=least),
j AS (SELECT r, count(*) FILTER (WHERE kind='assign') AS n_assign, count(*) FILTER (WHERE kind='access') AS n_access, count(*) FILTER (WHERE kind='hex') AS n_hex, string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({_BASE})) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN j ON d.r=j.r"""

_OP5 = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT r, list_distinct(CASE WHEN len(w)>=3 THEN list_transform(range(1, len(w)-1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w)>0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l, doc_id FROM d),
x AS MATERIALIZED (SELECT r, len(l) AS n, unnest(l) AS s FROM g),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.s=b.s AND a.r<>b.r AND 100*least(a.n,b.n)>=90*greatest(a.n,b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100*count(*)>=90*(a.n+b.n-count(*))),
reach AS (SELECT r AS a, r AS b FROM g UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a=reach.b)
SELECT g.doc_id, len(g.l)::BIGINT AS n_shingles, c.component_id FROM g JOIN (SELECT reach.a, min(o.doc_id) AS component_id FROM reach JOIN g o ON o.r=reach.b GROUP BY 1) c ON c.a=g.r"""

_OP8 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text,'')")} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i+34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w)-33)) AS i FROM d WHERE len(w)>=35)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c>1),
gone AS (SELECT r, list(DISTINCT j) AS l FROM (SELECT r, unnest(range(i, i+35)) AS j FROM twice) GROUP BY 1),
words AS (SELECT d.r, unnest(range(1, len(w)+1)) AS j, unnest(w) AS x FROM d),
g AS (SELECT r, unnest(l) AS j FROM gone),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.j) AS t FROM words LEFT JOIN g ON g.r=words.r AND g.j=words.j WHERE g.j IS NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(l),0)::BIGINT AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM d LEFT JOIN gone ON gone.r=d.r LEFT JOIN kept ON kept.r=d.r"""

ORACLES: dict[str, str] = {
    "op1_warc": _OP1,
    "op5_ngram_join": _OP5,
    "op6_quality_rules": _OP6,
    "op8_substring_dedup": _OP8,
    "op9_secret_scan": _OP9,
}
