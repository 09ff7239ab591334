"""SQL for DuckDB that gives the rows of the queries it can express, over the same tables."""

from __future__ import annotations

from .secrets import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"

LINES = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
often AS MATERIALIZED (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN often o ON o.key = k.key GROUP BY r, doc_id"""

MIXING = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM documents),
s AS MATERIALIZED (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS top FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source) x),
f AS MATERIALIZED (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(top) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM s WINDOW b AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT source, source_size, coalesce(least(top, (SELECT arg_min(level, top / w) FROM f WHERE top >= level * w) * w), 0.0) AS target FROM f),
p AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, CASE WHEN whole < 3 THEN target - whole * p.source_size ELSE 0.0 END AS rest, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""


def _secrets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for order, rule in enumerate(RULES):
        rx = quoted(rule.pattern)
        parts.append(
            f"""SELECT r, {order} AS o, '{rule.kind}' AS kind, unnest(string_split_regex(text, {rx})[:-2]) AS gap, unnest(regexp_extract_all(text, {rx}, 0)) AS hit, unnest(regexp_extract_all(text, {rx}, {rule.group})) AS val, unnest(range(len(regexp_extract_all(text, {rx}, 0)))) AS i, {rule.least} AS least, {str(rule.base).lower()} AS base FROM d WHERE regexp_matches(text, {rx})"""
        )
    spans = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o){cond}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED ({" UNION ALL ".join(parts)}),
x AS MATERIALIZED (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, length(hit) AS n FROM m),
y AS MATERIALIZED (SELECT *, e - n AS s FROM x WHERE length(val) >= least)
SELECT d.doc_id, {counts}, sha256({spans(" FILTER (WHERE base)")}) AS base_sha256, {spans(" FILTER (WHERE kind IS NOT NULL)")} AS spans FROM d LEFT JOIN y ON y.r = d.r GROUP BY d.r, d.doc_id"""


def _contamination(size: int = 8) -> str:
    norm = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    sizes = range(1, size + 1)
    items = " UNION ALL ".join(f"SELECT item, {n} AS n, {gram(n)} AS g, words FROM bw WHERE words {'>=' if n == size else '='} {n} WINDOW o AS (PARTITION BY b ORDER BY i)" for n in sizes)
    docs = " UNION ALL ".join(f"SELECT r, i, {n} AS n, {gram(n)} AS g FROM dw WHERE EXISTS (SELECT 1 FROM ig WHERE ig.n = {n}) WINDOW o AS (PARTITION BY r ORDER BY i)" for n in sizes)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {norm("text")} AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
b AS MATERIALIZED (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, {norm("text")} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS MATERIALIZED (SELECT b, item, len(ws) AS words, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM b),
ig AS MATERIALIZED (SELECT DISTINCT item, n, g FROM ({items}) u WHERE g IS NOT NULL),
hits AS MATERIALIZED (SELECT q.r, q.i, q.n, ig.item FROM ({docs}) q JOIN ig ON ig.n = q.n AND ig.g = q.g),
words AS (SELECT r, count(DISTINCT hp) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS hp FROM hits) z GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) z GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


NEAR = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
w AS MATERIALIZED (SELECT r, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS MATERIALIZED (SELECT DISTINCT r, g FROM (SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WHERE n >= 5 WINDOW o AS (PARTITION BY r ORDER BY i) UNION ALL SELECT r, string_agg(w, ' ' ORDER BY i) FROM w WHERE n < 5 GROUP BY r) u WHERE g IS NOT NULL),
named AS MATERIALIZED (SELECT r, md5(string_agg(g, chr(1) ORDER BY g)) AS s, count(*) AS n FROM g GROUP BY r),
one AS MATERIALIZED (SELECT s, min(r) AS r, any_value(n) AS n, count(*) AS n_same FROM named GROUP BY s),
sg AS MATERIALIZED (SELECT one.s, one.n, g.g FROM one JOIN g USING (r)),
links AS MATERIALIZED (SELECT a.s AS a, b.s AS b FROM sg a JOIN sg b ON a.g = b.g AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
sym AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE q(a, b) AS (SELECT s, s FROM one UNION SELECT q.a, sym.b FROM q JOIN sym ON sym.a = q.b) SELECT a, min(b) AS label FROM q GROUP BY a),
cls AS (SELECT label, min(doc_id) AS class_id FROM reach JOIN named ON named.s = reach.a JOIN d USING (r) GROUP BY label),
deg AS (SELECT a, count(*) AS n_links FROM sym GROUP BY a)
SELECT d.doc_id, CASE WHEN named.s IS NULL THEN d.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_same, 1) AS n_same FROM d LEFT JOIN named USING (r) LEFT JOIN one ON one.s = named.s LEFT JOIN reach ON reach.a = named.s LEFT JOIN cls ON cls.label = reach.label LEFT JOIN deg ON deg.a = named.s"""

ORACLES = {
    "op2_ngram_jaccard_join": NEAR,
    "op6_source_mixing": MIXING,
    "op7_decontamination": _contamination(),
    "op8_line_dedup": LINES,
    "op10_secret_scan": _secrets(),
}
