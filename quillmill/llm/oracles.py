"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, word, lead(word, 1) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM g),
v AS (SELECT doc_id, pos, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c),
r AS (SELECT doc_id, sum(hit)::BIGINT AS n FROM v GROUP BY 1),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM l GROUP BY 1),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN lower(coalesce(source, '')) LIKE '%://%' THEN regexp_extract(lower(source), '://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE lower(coalesce(source, '')) END AS host FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::BIGINT) AS k FROM f GROUP BY 1),
p AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) END AS weight FROM p),
o AS (SELECT host, (k + mean * weight) / (n + weight) <= 0.5 AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM f JOIN o USING (host)
"""

ORACLES = {"op5_host_rules": OP5}

OP4 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w)),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM win),
h AS (SELECT doc_id, unnest(range(s, s + 13)) AS pos FROM f WHERE hit),
gone AS (SELECT DISTINCT doc_id, pos FROM h),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) FILTER (g.pos IS NULL) AS kept, count(g.pos) AS n FROM t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
ORACLES["op4_recompression_dedup"] = OP4

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id
"""
ORACLES["op10_minhash_near_dedup"] = OP10

_TEST_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
WITH d AS (SELECT doc_id, {_TEST_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_TEST_WORDS} AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM q),
o AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k)),
m AS (SELECT doc_id, i, k, item_id FROM o JOIN q USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1),
x AS (SELECT win, k, term, count(*) AS c FROM (SELECT win, k, unnest(string_split(win, ' ')) AS term FROM (SELECT DISTINCT win, k FROM q)) GROUP BY 1, 2, 3),
dw AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d) WHERE term IN (SELECT term FROM x)),
y AS (SELECT x.*, count(*) OVER (PARTITION BY win) AS kinds, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), term) AS r FROM x LEFT JOIN (SELECT term, count(*) AS n FROM dw GROUP BY 1) USING (term)),
a AS (SELECT DISTINCT doc_id, win, k, kinds, unnest(range(pos - k - 2, pos + 1)) AS s FROM dw JOIN y USING (term) WHERE r = 1),
a2 AS (SELECT DISTINCT a.* FROM a JOIN y USING (win) JOIN dw ON dw.doc_id = a.doc_id AND dw.term = y.term AND dw.pos BETWEEN s AND s + a.k + 2 WHERE r = least(2, a.kinds)),
z AS (SELECT doc_id, win, s FROM (SELECT a2.doc_id, win, s, a2.kinds, c, count(*) AS n FROM a2 JOIN y USING (win) JOIN dw ON dw.doc_id = a2.doc_id AND dw.term = y.term AND dw.pos BETWEEN s AND s + a2.k + 2 GROUP BY 1, 2, 3, 4, y.term, c HAVING count(*) >= c) GROUP BY doc_id, win, s, kinds HAVING count(*) = kinds),
e AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT doc_id, win FROM z) JOIN q USING (win) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
"""
ORACLES["op8_positional_decontamination"] = OP8


def mixing_sql(documents: str) -> str:
    """The mixture with production parameters over a table of that name."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len({_WORDS})::BIGINT AS n_tokens FROM {documents}),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY 1),
p AS (SELECT *, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS share FROM s WHERE tokens > 0),
g AS (SELECT k, sum(exp(k / 1024.0::DOUBLE * ln(share))) AS z, max(exp(k / 1024.0::DOUBLE * ln(share)) / share) AS m FROM p, range(0, 1025) r(k) GROUP BY 1),
e AS (SELECT coalesce(min(k) FILTER (m / z <= 1.25), 1024) AS k FROM g),
w AS (SELECT p.*, floor(exp(e.k / 1024.0::DOUBLE * ln(share)) / z * (SELECT sum(tokens) FROM s)::DOUBLE)::BIGINT AS budget, ceil(n_docs / 4096.0)::BIGINT AS blocks FROM p, e JOIN g USING (k)),
a AS (SELECT d.doc_id, d.source, d.n_tokens, w.tokens, w.budget, ('0x' || substr(md5('mix-1|block|' || d.doc_id), 1, 8))::BIGINT % blocks AS block FROM d JOIN w USING (source)),
b AS (SELECT source, block, sum(n_tokens)::BIGINT AS held, any_value(budget) AS budget, any_value(tokens) AS tokens FROM a GROUP BY 1, 2),
c AS (SELECT *, unnest(range(0, floor(budget / tokens)::BIGINT + 1)) AS pass FROM b),
o AS (SELECT source, block, pass, budget - pass * tokens AS remain, coalesce(sum(held) OVER (PARTITION BY source, pass ORDER BY md5('mix-1|' || source || '|' || pass || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
r AS (SELECT a.doc_id, source, n_tokens, pass, block, remain, before + coalesce(sum(n_tokens) OVER (PARTITION BY source, block, pass ORDER BY md5('mix-1|' || pass || '|' || a.doc_id), a.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM a JOIN o USING (source, block) WHERE before < remain)
SELECT doc_id, source, n_tokens, pass, block, place::BIGINT AS place FROM r WHERE place < remain
"""


ORACLES["op9_temperature_mixing"] = mixing_sql("documents")

OP7 = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS win FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 48)) AS i FROM b)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM w) WHERE lo < doc_id),
g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS new FROM h),
r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, run, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt, a FROM s),
t AS (SELECT b.doc_id, x, sum(z - k.a)::BIGINT AS gone, count(k.a) AS n, min(k.a) AS f,
  string_agg(substr(x, 2 * z - 1, 2 * (coalesce(nxt, length(x) // 2 + 1) - z)), '' ORDER BY k.a) AS rest FROM b LEFT JOIN k USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, n::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n = 0 THEN x ELSE substr(x, 1, 2 * (f - 1)) || rest END)) AS kept_sha256 FROM t
"""
ORACLES["op7_suffix_dedup"] = OP7


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other: a(k) assigns parts to the codebooks b(k)."""
    distance = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r AS e, x FROM part WHERE r < {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, n.d, n.e, x FROM (SELECT a.r, a.p, any_value(a.x) AS x, min({{'d': {distance}, 'e': b.e}}) AS n FROM part a JOIN b{n} b USING (p) GROUP BY 1, 2))")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY 1, 2, 3),
m{n} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY 1, 2),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, e))""")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN coded USING (r), digest"


ORACLES["op11_vector_codes"] = _vector_codes()

#: CRC-32 of a decimal number: a shift register over its digits, eight steps a byte.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({c}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP12 = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS key, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM t),
c AS (SELECT conv_id, {_CRC.format(c="conv_id")} % 4 AS h, conv_id - conv_id % 20 AS lead_id FROM (SELECT DISTINCT conv_id FROM o)),
n AS (SELECT conv_id, h, lead_id, least(h, (SELECT count(*) FROM o WHERE o.conv_id = c.lead_id)) AS taken FROM c),
b AS (SELECT n.conv_id, o.pos AS d, key, words FROM n JOIN o ON o.conv_id = n.lead_id AND o.pos < h
  UNION ALL SELECT conv_id, pos - h + taken, key, words FROM n JOIN o USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, d + 1 AS depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, d + 1 = count(*) OVER (PARTITION BY conv_id) AS ends FROM b
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM b) FROM c),
g AS (SELECT path, min(conv_id) AS conv_id, any_value(depth)::BIGINT AS depth, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY 1),
k AS (SELECT path, left(path, (32 * (depth - 1))::BIGINT) AS up, depth, conv_id, n_convs, words, ids FROM g),
ch AS (SELECT up AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1),
f AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (path)),
a AS (SELECT left(path, 32 * unnest(range(0, depth + 1))) AS path, n_children, (n_convs - 1) * words AS saved FROM f),
s AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN k u ON f.depth > 0 AND u.path = f.up
"""
ORACLES["op12_prefix_trie"] = OP12
