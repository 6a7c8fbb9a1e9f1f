"""Queries on markup faults and on the comparison of texts with their transcriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lint as L
from ..functions import page_check as P
from ..functions import text as T
from ..operators import bags, replies
from . import views
from .registry import picked, query, quoted
from .text_queries import GRAMS, ITEM, ITEM_TEXT, MARKUP, NUMBERS, PAIR, WORDS, bag_sql

# RE2 has no lookbehind: escaped dollars are put aside first.
_BARE = rf"replace(regexp_replace(md, '(?s)<!--.*?-->', ' ', 'g'), '\$', chr(1))"
_M = f"{MARKUP}, m AS (SELECT doc_id, {_BARE} AS t FROM markup)"
_D = rf"{_M}, d AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\$\$')) % 2 = 1 THEN [] ELSE regexp_extract_all(t, '(?s)\$\$(.*?)\$\$', 1) END AS ds FROM m)"


def _md(spark, sf_dir):
    return views.markup(spark, sf_dir)


@query(rf"WITH {_M} SELECT doc_id, len(regexp_extract_all(t, '\$\$')) % 2 = 1 AS unmatched FROM m")
def lint_display(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.unmatched_display(F.col("md")).alias("unmatched"))


@query(rf"WITH {_D} SELECT doc_id, len(list_filter(ds, lambda b: regexp_matches(b, '\n\s*\n'))) > 0 AS blank_line, len(list_filter(ds, lambda b: contains(b, '*['))) > 0 AS review_note, len(list_filter(ds, lambda b: len(regexp_extract_all(b, '\\tag\b')) > 1)) > 0 AS tags FROM d")
def lint_block(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.display_faults(F.col("md")).alias("f")).select("doc_id", "f.*")


@query(
    rf"""WITH {_M}, e AS (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '\\begin\{{(\w+\*?)\}}', 1))) AS env FROM m),
    c AS (SELECT doc_id, env FROM e WHERE (length(t) - length(replace(t, '\begin{{' || env || '}}', ''))) // (length(env) + 8) <> (length(t) - length(replace(t, '\end{{' || env || '}}', ''))) // (length(env) + 6))
    SELECT m.doc_id, coalesce(string_agg(env, ',' ORDER BY env), '') AS unbalanced FROM m LEFT JOIN c USING (doc_id) GROUP BY 1"""
)
def lint_env(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.unbalanced(F.col("md")), ",").alias("unbalanced"))


_NOTE = r"(?m)^\[\^(\w+)\]:[ \t]*(.*)$"
_HOLDER = L.PLACEHOLDER.replace("(?i)", "(?i)")


@query(
    rf"""WITH {MARKUP}, m AS (SELECT doc_id, regexp_replace(md, '(?s)<!--.*?-->', ' ', 'g') AS t FROM markup),
    n AS (SELECT doc_id, regexp_replace(t, '{_NOTE}', ' ', 'g') AS prose, unnest(regexp_extract_all(t, '{_NOTE}', 1)) AS label, regexp_replace(unnest(regexp_extract_all(t, '{_NOTE}', 2)), '^\s+|\s+$', '', 'g') AS body FROM m)
    SELECT doc_id, label, fault FROM (SELECT doc_id, label, CASE WHEN body = '' OR trim(body, '[]*. ') = label THEN 'stub' WHEN regexp_matches(trim(body, '[]* '), '{_HOLDER}') THEN 'placeholder'
      WHEN length(body) > 40 AND contains(prose, rtrim(body, '.')) THEN 'repeat' END AS fault FROM n) WHERE fault IS NOT NULL"""
)
def lint_note(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.explode(L.note_faults(F.col("md"))).alias("n")).select("doc_id", "n.label", "n.fault")


# Scalar SQL over t, a text without comments in which chr(1) stands for an escaped dollar.
_ASIDE = r"replace({}, chr(1), '\$')"
_MARKERS = r"""list_transform(regexp_extract_all({t}, '[.,;:?!)"”’*]\$\^\{{?\d{{1,3}}\}}?\$|[A-Za-z]\$\^\{{?\d{{2,3}}\}}?\$'), lambda x: substr(x, 2))"""
_FUSED = r"regexp_extract_all({t}, '(?m)^(?:\[\^\d+\][^:\s]|\[<u>\d+</u>\]\S)')"
_MATH_RE2 = r"(?s)\$\$.*?\$\$|\$(?:\\.|[^$\\\n])*\$"
_NO_MATH = rf"replace(regexp_replace({{t}}, '{_MATH_RE2}', ' ', 'g'), chr(1), '\$')"
_TABLE_COMMAND = r"regexp_matches({p}, '\\(?:multicolumn|multirow|hline|cline)\b')"
_OUTSIDE = r"regexp_extract_all({p}, '\\begin\{{(?:align|aligned|equation|eqnarray|gather|gathered|multline|split|array|cases|[pbvBV]?matrix)\*?\}}|\\tag\*?\{{[^}}]*\}}')"
_LINKS = r"""list_filter(regexp_extract_all({u}, '!?\[[^\]\n]*\]\((?:\s[^)\n]*|[^<)\n][^)\n]*\s[^)\n]*)\)'), lambda x: NOT regexp_matches(trim(regexp_extract(x, '\]\((.*)\)$', 1)), '^\S+\s+(".*"|''.*''|\(.*\))$'))"""
# ps: what the dollar signs part; j: the part after one of them
_MONEY_AT = r"""(CASE WHEN ps[j - 1] = '' THEN j = 2 ELSE regexp_matches(right(ps[j - 1], 1), '[\s(“—–-]') END)
    AND regexp_matches(array_to_string(ps[j:], '$'), '^\d[\d,]*(\.\d+)?(s\b|[\s,.;:)–-]|$)') AND NOT (len(ps) > j AND regexp_matches(ps[j], '^[\d,.]*$'))
    AND (len(ps) = j OR contains(ps[j], chr(10)) OR ps[j] LIKE '% ' OR len(regexp_extract_all(regexp_replace(ps[j], '\\[A-Za-z]+(\{[^}]*\})?', ' ', 'g'), '[A-Za-z]{2,}')) >= 4)"""
_PIECES = "list_filter(list_transform([string_split({t}, '$$')], lambda xs: list_transform(range(1, len(xs) + 1), lambda k: CASE WHEN k % 2 = 1 OR k = len(xs) THEN CASE WHEN k > 1 THEN 'x' ELSE '' END || xs[k] || CASE WHEN k < len(xs) THEN '$' ELSE '' END END))[1], lambda x: x IS NOT NULL)"
_MONEY_IN = _MONEY_AT.replace("{", "{{").replace("}", "}}")
_MONEY = rf"flatten(list_transform({_PIECES}, lambda p: list_transform([string_split(p, '$')], lambda ps: list_transform(list_filter(range(2, len(ps) + 1), lambda j: {_MONEY_IN}), lambda j: substr(replace('$' || array_to_string(ps[j:], '$'), chr(1), '\$'), 1, 12)))[1]))"


@query(rf"WITH {_M} SELECT doc_id, array_to_string({_MARKERS.format(t='t')}, '|') AS markers FROM m")
def lint_marker(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.math_markers(F.col("md")), "|").alias("markers"))


@query(rf"WITH {_M} SELECT doc_id, array_to_string({_FUSED.format(t='t')}, '|') AS fused FROM m")
def lint_fused(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.fused_labels(F.col("md")), "|").alias("fused"))


@query(rf"WITH {_M}, n AS (SELECT doc_id, {_NO_MATH.format(t='t')} AS p FROM m) SELECT doc_id, {_TABLE_COMMAND.format(p='p')} AS table_command, array_to_string({_OUTSIDE.format(p='p')}, '|') AS outside FROM n")
def lint_latex(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.latex_outside(F.col("md")).alias("f")).select("doc_id", "f.table_command", F.array_join("f.outside", "|").alias("outside"))


@query(rf"WITH {_M} SELECT doc_id, array_to_string({_LINKS.format(u=_ASIDE.format('t'))}, '|') AS links FROM m")
def lint_link(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.spaced_links(F.col("md")), "|").alias("links"))


@query(rf"WITH {_M} SELECT doc_id, array_to_string({_MONEY.format(t='t')}, '|') AS amounts FROM m")
def lint_money(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.money(F.col("md")), "|").alias("amounts"))


_ONE_TAG = r"""array_to_string(list_transform([string_split(t, '$$')], lambda xs: list_transform(range(1, len(xs) + 1), lambda k: CASE WHEN k % 2 = 0 AND k < len(xs) AND len(regexp_extract_all(xs[k], '\\tag\*?\{([^{}]*)\}')) > 1 THEN regexp_replace(xs[k], '\\tag\*?\{([^{}]*)\}', '\\qquad (\1)', 'g') ELSE xs[k] END))[1], '$$')"""


@query(rf"WITH {MARKUP}, m AS (SELECT doc_id, replace(md, '\$', chr(1)) AS t FROM markup) SELECT doc_id, {_ASIDE.format(_ONE_TAG)} AS md FROM m")
def one_tag(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.one_tag(F.col("md")).alias("md"))


_ESCAPED = f"list_transform([string_split(t, '$')], lambda ps: ps[1] || array_to_string(list_transform(range(2, len(ps) + 1), lambda j: CASE WHEN {_MONEY_AT} THEN chr(1) ELSE '$' END || ps[j]), ''))[1]"


@query(rf"WITH {MARKUP}, m AS (SELECT doc_id, replace(md, '\$', chr(1)) AS t FROM markup) SELECT doc_id, {_ASIDE.format(_ESCAPED)} AS md FROM m")
def escape_money(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.escape_money(F.col("md")).alias("md"))


_REPLIES = ['json {"wrong": ["a \\beta"], "missing": []}', "no object", '{"wrong": []', '{"missing": ["x"]} end', "[1]", '{"b": {"c": 1}, "a": 2}']


@query(
    rf"""WITH r AS (SELECT doc_id, regexp_extract({picked('doc_id', _REPLIES)} || ' ', '(?s)\{{.*\}}') AS raw FROM documents), p AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS t FROM (SELECT doc_id, regexp_replace(raw, '\\([A-Za-z][A-Za-z])', '\\\\\1', 'g') AS t FROM r))
    SELECT doc_id, array_to_string(list_sort(json_keys(t)), ',') AS fields, array_to_string(coalesce(json_extract_string(t, '$.wrong[*]'), []), '|') AS wrong, array_to_string(coalesce(json_extract_string(t, '$.missing[*]'), []), '|') AS missing FROM p"""
)
def parse_check(spark, sf_dir):
    found = T.as_object(F.concat(views.pick(F.col("doc_id"), _REPLIES), F.lit(" ")))
    keys = F.array_join(F.array_sort(F.map_keys(F.from_json("found", "map<string,string>"))), ",")
    d = views.table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    return d.select("doc_id", keys.alias("fields"), *(F.array_join(T.texts_of(F.col("found"), k), "|").alias(k) for k in ("wrong", "missing")))


@query(
    rf"""WITH {_M}, s AS (SELECT doc_id, [tex: regexp_extract_all(t, '(?s)\$\$(.*?)\$\$', 1)] AS x, regexp_extract_all(t, '(?s)\$\$(.*?)\$\$', 1) AS shown, string_split_regex(regexp_replace(t, '(?s)\$\$(.*?)\$\$', ' ', 'g'), '\n\s*\n') AS ps FROM m)
    SELECT doc_id, len(shown)::BIGINT AS n_display, replace(array_to_string(shown, '|'), chr(1), '\$') AS displays,
      replace(array_to_string(flatten(list_transform(ps, lambda p: regexp_extract_all(p, '(?s)\$((?:\\.|[^$\\])+?)\$', 1))), '|'), chr(1), '\$') AS inlines FROM s""".replace("[tex: regexp_extract_all(t, '(?s)\\$\\$(.*?)\\$\\$', 1)] AS x, ", "")
)
def formulas(spark, sf_dir):
    f = L.formulas(F.col("md"))
    of = lambda shown: F.array_join(F.transform(F.filter("f", lambda x: x["is_display"] == F.lit(shown)), lambda x: x["tex"]), "|")
    d = _md(spark, sf_dir).select("doc_id", f.alias("f"))
    return d.select("doc_id", F.size(F.filter("f", lambda x: x["is_display"])).cast("long").alias("n_display"), of(True).alias("displays"), of(False).alias("inlines"))


_SPLIT = rf"""{_M}, p1 AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_MATH_RE2}', ' ', 'g'), '!\[Page \d+(?: scan|, figure \d+)\]\([^)\n]*\)', ' ', 'g'),
    '(?m)^\*\*(?:Figure|Picture) [\d.]+ - transcribed by [^*\n]*:\*\*$', ' ', 'g'), '\]\([^)\s]*\)', '] ', 'g'), '\*\[[^\]]*\]\*', ' ', 'g') AS p FROM m),
  sp AS (SELECT doc_id, array_to_string(regexp_extract_all(t, '{_MATH_RE2}'), ' ') || ' ' || array_to_string(regexp_extract_all(p, '(?m)^>.*$'), ' ') AS other,
    regexp_replace(regexp_replace(regexp_replace(p, '(?m)^>.*$', ' ', 'g'), '(?m)^## Page \d+\s*$', ' ', 'g'), '\[\^(\w+)\]:?', ' ', 'g') AS prose FROM p1)"""


_PARTS_RE2 = rf"(?s)```.*?```|`[^`\n]+`|{_MATH_RE2.removeprefix('(?s)')}"


@query(
    rf"""WITH {MARKUP}, m AS (SELECT doc_id, replace(md, '\$', chr(1)) AS t FROM markup), c AS (SELECT doc_id, regexp_extract_all(t, '(?s)<!--.*?-->') AS cs, string_split_regex(t, '(?s)<!--.*?-->') AS ps FROM m),
    x AS (SELECT doc_id, cs, array_to_string(list_transform(ps, lambda p: regexp_replace(p, '{_PARTS_RE2}', '', 'g')), '') AS plain, flatten(list_transform(ps, lambda p: regexp_extract_all(p, '{_PARTS_RE2}'))) AS xs FROM c),
    k AS (SELECT doc_id, plain, cs, list_filter(xs, lambda x: x LIKE '`%') AS code, list_filter(xs, lambda x: x LIKE '$$_%') AS display, list_filter(xs, lambda x: x LIKE '$%' AND x NOT LIKE '$$_%') AS inl FROM x)
    SELECT doc_id, replace(plain, chr(1), '\$') AS plain, {", ".join(f"replace(array_to_string({c}, '|'), chr(1), '{chr(92)}$') AS {n}" for c, n in (("cs", "comments"), ("code", "code"), ("display", "displays"), ("inl", "inlines")))} FROM k"""
)
def markup_segments(spark, sf_dir):
    d = _md(spark, sf_dir).select("doc_id", L.segments(F.col("md")).alias("s"))
    of = lambda kind, sep: F.array_join(F.transform(F.filter("s", lambda x: x["kind"] == kind), lambda x: x["text"]), sep)
    return d.select("doc_id", of("text", "").alias("plain"), of("comment", "|").alias("comments"), of("code", "|").alias("code"), of("display", "|").alias("displays"), of("inline", "|").alias("inlines"))


@query(rf"WITH {_SPLIT} SELECT doc_id, replace(prose, chr(1), '\$') AS prose, replace(other, chr(1), '\$') AS other FROM sp")
def split_md(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.split_md(F.col("md")).alias("s")).select("doc_id", "s.*")


@query(rf"WITH {_SPLIT} SELECT doc_id, array_to_string(list_filter(string_split(replace(prose, chr(1), '\$'), chr(10)), lambda x: ltrim(x) LIKE '|%'), ' ') AS table_text FROM sp")
def table_text(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.table_text(L.split_md(F.col("md"))["prose"]).alias("table_text"))


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'ok' WHEN quality = 0 THEN 'flagged' END, 'no-page-file') AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def verify_left(spark, sf_dir):
    checked = views.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "flagged").alias("status"))
    return views.table(spark, sf_dir, "documents").select("doc_id").join(checked, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("no-page-file")).alias("status"))


# The whole check of pairs, in SQL: tokens, joined words, bags, and the rules of forgiveness that the pairs
# can need (words in other text, fused letters, lost accents). Spaced thousands and run-on markers
# are tested on written cases.
_SPLIT_PAIR = _SPLIT.replace(_M, f"{PAIR}, m AS (SELECT doc_id, {_BARE} AS t FROM pair)")
_PLAIN_SQL = "regexp_replace(lower({}), 'ffi|ffl|ff|fi|fl', '', 'g')"
_CHECK = rf"""{_SPLIT_PAIR},
  st AS (SELECT doc_id, native, md, len({WORDS.format("native")}) AS n_words, CASE WHEN contains(md, '{P.NOTES_MARK}') THEN 'notes' WHEN len({WORDS.format("native")}) + len({NUMBERS.format("native")}) < 20 THEN 'no-text-layer' ELSE 'compared' END AS stage FROM pair),
  ps AS (SELECT st.doc_id, native, md, {_ASIDE.format("prose")} AS prose, {_ASIDE.format("other")} AS other FROM st JOIN sp USING (doc_id) WHERE stage = 'compared'),
  kw AS (SELECT doc_id, token, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, {WORDS.format("prose")} AS ws FROM ps)) GROUP BY 1, 2),
  tk AS (SELECT doc_id, unnest(ts) AS tok, unnest(gs) AS gap, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(native, '[A-Za-z]+') AS ts, regexp_extract_all(native, '[A-Za-z]+([^A-Za-z]*)', 1) AS gs FROM ps)),
  nx AS (SELECT *, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tk),
  cd AS (SELECT nx.*, contains(gap, chr(10)) AND nxt IS NOT NULL AND k1.token IS NOT NULL AND (k2.token IS NULL OR regexp_full_match(gap, '[-\x{{ad}}\x{{2010}}]\s*\n\s*')) AS j FROM nx LEFT JOIN kw k1 ON k1.doc_id = nx.doc_id AND k1.token = {_PLAIN_SQL.format("tok || nxt")} LEFT JOIN kw k2 ON k2.doc_id = nx.doc_id AND k2.token = {_PLAIN_SQL.format("tok")}),
  rn AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, j ORDER BY i) AS run FROM cd),
  jn AS (SELECT *, j AND row_number() OVER (PARTITION BY doc_id, j, run ORDER BY i) % 2 = 1 AS joins FROM rn),
  jx AS (SELECT *, lag(joins, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS gone FROM jn),
  ow AS (SELECT doc_id, token, count(*) AS n, min(i) AS pos FROM (SELECT doc_id, i, {_PLAIN_SQL.format("CASE WHEN joins THEN tok || nxt ELSE tok END")} AS token FROM jx WHERE NOT gone) WHERE length(token) >= 3 GROUP BY 1, 2),
  ot AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(other, '[A-Za-z]+'), lambda w: {_PLAIN_SQL.format("w")}), '') AS letters, array_to_string({NUMBERS.format("other")}, ' ') AS in_math FROM ps),
  m0 AS (SELECT o.doc_id, o.token, o.n - coalesce(k.n, 0) AS n, o.pos FROM ow o LEFT JOIN kw k ON k.doc_id = o.doc_id AND k.token = o.token JOIN ot ON ot.doc_id = o.doc_id WHERE o.n > coalesce(k.n, 0) AND NOT contains(letters, o.token)),
  x0 AS (SELECT k.doc_id, k.token, k.n - coalesce(o.n, 0) AS n, k.pos FROM kw k LEFT JOIN ow o ON k.doc_id = o.doc_id AND k.token = o.token WHERE k.n > coalesce(o.n, 0)),
  fu AS (SELECT m0.*, left(m0.token, -1) AS stem, kw.token IS NOT NULL OR list_contains({[*P.SHORT_WORDS]}, left(m0.token, -1)) AS fused FROM m0 LEFT JOIN kw ON kw.doc_id = m0.doc_id AND kw.token = left(m0.token, -1)),
  fs AS (SELECT doc_id, stem AS token, sum(n) AS n FROM fu WHERE fused GROUP BY 1, 2),
  m1 AS (SELECT * FROM fu WHERE NOT fused),
  x1 AS (SELECT x0.doc_id, x0.token, x0.n - coalesce(fs.n, 0) AS n, x0.pos FROM x0 LEFT JOIN fs ON fs.doc_id = x0.doc_id AND fs.token = x0.token WHERE x0.n > coalesce(fs.n, 0)),
  ac AS (SELECT m1.doc_id, m1.token, m1.n, m1.pos, arg_min(x1.token, x1.pos) AS whole FROM m1 JOIN x1 ON x1.doc_id = m1.doc_id AND length(x1.token) = length(m1.token) + 1 AND len(list_filter(range(1, length(x1.token) + 1), lambda i: contains('{P.DROPPABLE}', x1.token[i]) AND substr(x1.token, 1, i - 1) || substr(x1.token, i + 1) = m1.token)) > 0 GROUP BY ALL),
  ad AS (SELECT ac.*, x1.n AS have, coalesce(sum(ac.n) OVER (PARTITION BY ac.doc_id, whole ORDER BY ac.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ac JOIN x1 ON x1.doc_id = ac.doc_id AND x1.token = whole),
  mi AS (SELECT m1.doc_id, m1.token, m1.n - coalesce(least(ad.n, greatest(0, have - used)), 0) AS n FROM m1 LEFT JOIN ad ON ad.doc_id = m1.doc_id AND ad.token = m1.token),
  ex0 AS (SELECT x1.doc_id, x1.token, x1.n - least(x1.n, coalesce(s.n, 0)) AS n FROM x1 LEFT JOIN (SELECT doc_id, whole, sum(n) AS n FROM ad GROUP BY 1, 2) s ON s.doc_id = x1.doc_id AND s.whole = x1.token),
  {bag_sql("on_", "ps", "doc_id", NUMBERS.format("native"))}, {bag_sql("kn", "ps", "doc_id", NUMBERS.format("prose"))}, {bag_sql("cn", "ps", "doc_id", NUMBERS.format("array_to_string(regexp_extract_all(md, '(?s)<!--.*?-->'), ' ')"))},
  nm AS (SELECT o.doc_id, o.token, greatest(o.n - coalesce(k.n, 0), 0) - coalesce(c.n, 0) AS n FROM on_ o LEFT JOIN kn k ON k.doc_id = o.doc_id AND k.token = o.token LEFT JOIN cn c ON c.doc_id = o.doc_id AND c.token = o.token JOIN ot ON ot.doc_id = o.doc_id WHERE NOT contains(in_math, o.token)),
  nx0 AS (SELECT k.doc_id, k.token, k.n - coalesce(o.n, 0) AS n FROM kn k LEFT JOIN on_ o ON k.doc_id = o.doc_id AND k.token = o.token),
  tt AS (SELECT doc_id, array_to_string(list_filter(string_split(prose, chr(10)), lambda x: ltrim(x) LIKE '|%'), ' ') AS tab FROM ps WHERE %IMAGE%),
  {bag_sql("tw", "tt", "doc_id", WORDS.format("tab"))}, {bag_sql("tn", "tt", "doc_id", NUMBERS.format("tab"))},
  sx AS (SELECT doc_id, token, least(ex0.n, tw.n) AS n FROM ex0 JOIN tw USING (doc_id, token) WHERE ex0.n > 0),
  sn AS (SELECT doc_id, token, least(nx0.n, tn.n) AS n FROM nx0 JOIN tn USING (doc_id, token) WHERE nx0.n > 0),
  ex AS (SELECT ex0.doc_id, ex0.token, ex0.n - coalesce(sx.n, 0) AS n FROM ex0 LEFT JOIN sx USING (doc_id, token)),
  nx2 AS (SELECT nx0.doc_id, nx0.token, nx0.n - coalesce(sn.n, 0) AS n FROM nx0 LEFT JOIN sn USING (doc_id, token)),
  sd AS (SELECT doc_id, token, n, 'm' AS side FROM mi UNION ALL SELECT doc_id, token, n, 'x' FROM ex UNION ALL SELECT doc_id, token, n, 'nm' FROM nm UNION ALL SELECT doc_id, token, n, 'nx' FROM nx2 UNION ALL SELECT doc_id, token, n, 'i' FROM sx UNION ALL SELECT doc_id, token, n, 'i' FROM sn),
  tl AS (SELECT doc_id, {", ".join(f"list({{'n': -n, 'token': token}}) FILTER (side = '{k}') AS l_{k}" for k in ("m", "x", "nm", "nx", "i"))} FROM sd WHERE n > 0 GROUP BY 1),
  df AS (SELECT doc_id, string_agg(token || ':' || n, ' ' ORDER BY token || ':' || n) FILTER (side = 'm') AS missing, string_agg(token || ':' || n, ' ' ORDER BY token || ':' || n) FILTER (side = 'x') AS extra, string_agg(token || ':' || n, ' ' ORDER BY token || ':' || n) FILTER (side = 'nm') AS numbers_missing, string_agg(token || ':' || n, ' ' ORDER BY token || ':' || n) FILTER (side = 'nx') AS numbers_extra,
    coalesce(sum(n) FILTER (side IN ('m', 'x')), 0) AS dw, coalesce(sum(n) FILTER (side IN ('nm', 'nx')), 0) AS dn FROM sd WHERE n > 0 GROUP BY 1),
  ck AS (SELECT st.doc_id, CASE WHEN stage <> 'compared' THEN stage WHEN coalesce(dw, 0) > 1 OR coalesce(dn, 0) > 0 THEN 'flagged' ELSE 'ok' END AS status, n_words::INT AS n_words, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra, coalesce(numbers_missing, '') AS numbers_missing, coalesce(numbers_extra, '') AS numbers_extra,
    stage <> 'notes' AND contains(md, '{P.OCR_MARK}') AS ocr, stage <> 'notes' AND contains(md, '{P.CUT_MARK}') AS truncated, stage = 'notes' AS notes FROM st LEFT JOIN df USING (doc_id))"""
_PAGE_CHECK, _CHECK = _CHECK, _CHECK.replace("%IMAGE%", "false")
_FAULTS = rf"""fl AS (SELECT doc_id, len(regexp_extract_all(t, '\$\$')) % 2 = 1 OR len(list_filter(regexp_extract_all(t, '(?s)\$\$(.*?)\$\$', 1), lambda b: regexp_matches(b, '\n\s*\n') OR contains(b, '*[') OR len(regexp_extract_all(b, '\\tag\b')) > 1)) > 0
    OR len(list_filter(list_distinct(regexp_extract_all(t, '\\begin\{{(\w+\*?)\}}', 1)), lambda e: (length(t) - length(replace(t, '\begin{{' || e || '}}', ''))) // (length(e) + 8) <> (length(t) - length(replace(t, '\end{{' || e || '}}', ''))) // (length(e) + 6))) > 0 AS math,
  len({_MARKERS.format(t="t")}) + len({_FUSED.format(t="t")}) + len({_MONEY.format(t="t")}) + len({_LINKS.format(u=_ASIDE.format("t"))}) + len({_OUTSIDE.format(p=_NO_MATH.format(t="t"))}) > 0 OR {_TABLE_COMMAND.format(p=_NO_MATH.format(t="t"))} AS markup FROM m)"""
_FLAGGED = f"WITH {_CHECK}, {_FAULTS}, v AS (SELECT ck.*, math, markup, status = 'flagged' OR ocr OR truncated OR math OR markup AS flagged FROM ck JOIN fl USING (doc_id))"


def _checked(spark, sf_dir):
    return P.check_pages(views.docpair(spark, sf_dir))


@query(f"WITH {_CHECK} SELECT doc_id, status IN ('notes', 'no-text-layer') AS skipped, n_words FROM ck")
def verify_status(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", F.col("status").isin("notes", "no-text-layer").alias("skipped"), "n_words")


@query(f"{_FLAGGED} SELECT doc_id, status, ocr, truncated, math, markup, flagged FROM v")
def verify_flagged(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "status", "ocr", "truncated", (F.size("math") > 0).alias("math"), (F.size("markup") > 0).alias("markup"), "flagged")


# Faults in the order and with the details in which pages are told of them.
_BLOCK_FAULTS = r"list_filter([CASE WHEN regexp_matches(b, '\n\s*\n') THEN 'blank_line' END, CASE WHEN contains(b, '*[') THEN 'review_note' END, CASE WHEN len(regexp_extract_all(b, '\\tag\b')) > 1 THEN 'tags' END], lambda k: k IS NOT NULL)"
_NOTE_FAULT = rf"""CASE WHEN body = '' OR trim(body, '[]*. ') = label THEN 'stub' WHEN regexp_matches(trim(body, '[]* '), '{_HOLDER}') THEN 'placeholder' WHEN length(body) > 40 AND contains(prose, rtrim(body, '.')) THEN 'repeat' END"""
_TOLD = rf"""
  mf AS (SELECT doc_id, t, len(regexp_extract_all(t, '\$\$')) % 2 = 1 AS odd, regexp_extract_all(t, '(?s)\$\$(.*?)\$\$', 1) AS shown FROM m),
  me AS (SELECT doc_id, list('environment: ' || env ORDER BY env) AS envs FROM (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '\\begin\{{(\w+\*?)\}}', 1))) AS env FROM m)
    WHERE (length(t) - length(replace(t, '\begin{{' || env || '}}', ''))) // (length(env) + 8) <> (length(t) - length(replace(t, '\end{{' || env || '}}', ''))) // (length(env) + 6) GROUP BY 1),
  mn AS (SELECT doc_id, list(fault || ': ' || label ORDER BY i) FILTER (fault IS NOT NULL) AS notes FROM (SELECT doc_id, i, label, {_NOTE_FAULT} AS fault FROM (SELECT doc_id, regexp_replace(t, '{_NOTE}', ' ', 'g') AS prose, unnest(range(1, len(regexp_extract_all(t, '{_NOTE}', 1)) + 1)) AS i,
      unnest(regexp_extract_all(t, '{_NOTE}', 1)) AS label, regexp_replace(unnest(regexp_extract_all(t, '{_NOTE}', 2)), '^\s+|\s+$', '', 'g') AS body FROM m)) GROUP BY 1),
  fd AS (SELECT mf.doc_id, list_transform(list_concat(CASE WHEN odd THEN ['unmatched'] ELSE flatten(list_transform(shown, lambda b: {_BLOCK_FAULTS})) END, coalesce(envs, [])), lambda x: {{'kind': 'math', 'detail': x}}) AS math,
    list_transform(list_concat(coalesce(notes, []), list_transform({_MARKERS.format(t="t")}, lambda x: 'marker: ' || x), list_transform({_FUSED.format(t="t")}, lambda x: 'fused: ' || x), list_transform({_MONEY.format(t="t")}, lambda x: 'money: ' || x),
      CASE WHEN {_TABLE_COMMAND.format(p=_NO_MATH.format(t="t"))} THEN ['table_command'] ELSE [] END, list_transform({_OUTSIDE.format(p=_NO_MATH.format(t="t"))}, lambda x: 'outside: ' || x), list_transform({_LINKS.format(u=_ASIDE.format("t"))}, lambda x: 'link: ' || left(x, 60))),
      lambda x: {{'kind': 'markup', 'detail': {_ASIDE.format("x")}}}) AS markup FROM mf LEFT JOIN me USING (doc_id) LEFT JOIN mn USING (doc_id))"""
_TOP = "coalesce(array_to_string(list_transform(list_sort({})[:20], lambda e: CASE WHEN e.n < -1 THEN e.token || 'x' || -e.n ELSE e.token END), ' '), '-')"
_BAD = "status = 'flagged'"
_LINES = [("flagged", _BAD, "n_words::VARCHAR"), ("missing", _BAD, _TOP.format("l_m")), ("extra", _BAD, _TOP.format("l_x"))]
_LINES += [(f"numbers {k}", f"{_BAD} AND (l_nm IS NOT NULL OR l_nx IS NOT NULL)", _TOP.format(c)) for k, c in (("missing", "l_nm"), ("extra", "l_nx"))]
_LINES += [("from image", f"{_BAD} AND l_i IS NOT NULL", _TOP.format("l_i")), ("cut off", "truncated", "''"), ("local OCR", "ocr", "''"), ("study notes", "notes", "''")]


def _lines_sql(check: str, gone: str = "false") -> str:
    """Every line of every page, in order; gone: which pages have no file."""
    single = ", ".join(f"CASE WHEN {c} THEN {{'kind': {quoted(k)}, 'detail': {d}}} END" for k, c, d in _LINES)
    return f"""WITH {check}, {_TOLD}, al AS (SELECT ck.doc_id, list_concat(list_filter([{single}], lambda x: x IS NOT NULL), CASE WHEN {gone} THEN [] ELSE list_concat(math, markup) END) AS ls FROM ck LEFT JOIN tl USING (doc_id) JOIN fd USING (doc_id))
    SELECT doc_id, unnest(range(0, len(ls)))::INT AS place, unnest(ls).kind AS kind, unnest(ls).detail AS detail FROM al"""


@query(_lines_sql(_CHECK))
def verify_lines(spark, sf_dir):
    return P.report_lines(_checked(spark, sf_dir), ["doc_id"])


#: Pages with an image, and pages that were selected but have no file.
_IMAGE, _GONE = "doc_id % 2 = 0", "doc_id % 31 = 7"
_SEEN = _PAGE_CHECK.replace("%IMAGE%", _IMAGE).replace(PAIR, f"{PAIR.replace('pair AS', 'all_pairs AS', 1)}, pair AS (SELECT doc_id, native, CASE WHEN {_GONE} THEN '' ELSE md END AS md FROM all_pairs)")
_SEEN = _SEEN.replace("  ck AS (", "  c0 AS (") + f", ck AS (SELECT * REPLACE (CASE WHEN {_GONE} THEN 'no-page-file' ELSE status END AS status, CASE WHEN {_GONE} THEN 0 ELSE n_words END AS n_words) FROM c0)"


def _verified(spark, sf_dir):
    pair, d = views.docpair(spark, sf_dir), F.col("doc_id")
    return P.verify(pair.select("doc_id", "native", (d % 2 == 0).alias("image")), pair.filter(d % 31 != 7).select("doc_id", "md"), ["doc_id"])


@query(_lines_sql(_SEEN, _GONE))
def verify_pages(spark, sf_dir):
    return P.report_lines(_verified(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {_SEEN}, {_TOLD}, v AS (SELECT ck.*, NOT {_GONE} AND len(math) > 0 AS bad_math, NOT {_GONE} AND len(markup) > 0 AS bad_markup, l_i IS NOT NULL AS image FROM ck JOIN fd USING (doc_id) LEFT JOIN tl USING (doc_id))
    SELECT {", ".join(f"count(*) FILTER (status = '{k}') AS {k.replace('-', '_')}" for k in ("ok", "flagged", "no-text-layer", "no-page-file"))}, count(*) FILTER (ocr) AS ocr, count(*) FILTER (bad_math) AS math, count(*) FILTER (bad_markup) AS markup, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (notes) AS notes, count(*) FILTER (image) AS image_tables, count(*) FILTER (NOT {_GONE} AND ({_BAD} OR ocr OR truncated OR bad_math OR bad_markup)) AS to_look_at FROM v"""
)
def verify_report(spark, sf_dir):
    return P.report_totals(_verified(spark, sf_dir))


#: Texts against the markup that was made of them: every kind of fault, with its details.
_MARKED = _CHECK.replace(PAIR, f"{MARKUP}, pair AS (SELECT doc_id, text AS native, md FROM documents JOIN markup USING (doc_id))")


@query(_lines_sql(_MARKED))
def verify_markup(spark, sf_dir):
    pair = views.markup(spark, sf_dir).join(views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("native")), "doc_id")
    return P.report_lines(P.check_pages(pair), ["doc_id"])


_PARDON = f"{PAIR}, {bag_sql('a', 'pair', 'doc_id', WORDS.format('native'))}"


@query(f"WITH {_PARDON}, o AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(md, '[A-Za-z]+'), lambda w: regexp_replace(lower(w), 'ffi|ffl|ff|fi|fl', '', 'g')), '') AS letters FROM pair) SELECT a.doc_id, token, n FROM a JOIN o USING (doc_id) WHERE NOT contains(letters, token)")
def pardon(spark, sf_dir):
    pair = views.docpair(spark, sf_dir)
    letters = F.array_join(F.transform(F.regexp_extract_all("md", F.lit(T.WORD), F.lit(0)), lambda w: F.regexp_replace(F.lower(w), T.LIGATURES, "")), "")
    a = bags.bag(pair, ["doc_id"], T.words(F.col("native")))
    return a.join(pair.select("doc_id", letters.alias("letters")), "doc_id").filter(~F.contains("letters", F.col("token"))).select("doc_id", "token", "n")


@query(f"WITH {_CHECK} SELECT * FROM ck")
def check_page(spark, sf_dir):
    listed = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), " ")
    c = _checked(spark, sf_dir)
    return c.select("doc_id", "status", "n_words", *(listed(k).alias(k) for k in ("missing", "extra", "numbers_missing", "numbers_extra")), "ocr", "truncated", "notes")


_KEY = "CASE WHEN doc_id % 3 = 0 THEN native ELSE md END"
_CHECKS = ['{"wrong": ["a"], "missing": []}', 'so: {"wrong": ["a", "b"], "missing": ["c"]}', "unreadable", "{}"]
_HEADS = ["> notes", "> notes, revised once\n>\n> and more"]
_OF_PAIR = ITEM_TEXT.replace("text ||", "native ||", 1)
_LOWER_WORDS = "regexp_extract_all(lower({}), '[a-z]+')"


@query(
    rf"""WITH {PAIR}, g AS (SELECT doc_id, md, {_OF_PAIR} AS page_text, {_KEY} AS key FROM pair),
    i AS (SELECT doc_id, md, page_text, list_distinct(list_concat(regexp_extract_all(page_text, '\([0-9]{{1,2}}[A-Z]?\.[0-9]{{1,3}}[a-z]?\)'), regexp_extract_all(page_text, {ITEM}))) AS items,
      list_distinct(regexp_extract_all(regexp_replace(key, '(?s)<!--.*?-->', '', 'g'), '[0-9]+\.[0-9]{{2,}}')) AS ds, {_LOWER_WORDS.format("md")} AS mw, {_LOWER_WORDS.format("page_text")} AS pw FROM g)
    SELECT doc_id AS page, len(list_intersect({GRAMS.format("mw")}, {GRAMS.format("pw")}))::BIGINT AS copied,
      len(list_filter(items, lambda x: regexp_matches(md, '(^|[^0-9.])' || regexp_escape(string_split(translate(x, '()', ''), ' ')[-1]) || '($|[^0-9])')))::BIGINT AS items_kept, len(items)::BIGINT AS items,
      len(list_filter(ds, lambda x: contains(md, x)))::BIGINT AS decimals_kept, len(ds)::BIGINT AS decimals, [1, 2, 0, 0][doc_id % 4 + 1]::BIGINT AS wrong, [0, 1, 0, 0][doc_id % 4 + 1]::BIGINT AS missing, doc_id % 2 = 1 AS revised FROM i"""
)
def notes_eval(spark, sf_dir):
    d = F.col("doc_id")
    pair = views.docpair(spark, sf_dir)
    notes = pair.select(d.alias("page"), F.expr(_OF_PAIR).alias("page_text"), F.concat(views.pick(d, _HEADS), F.lit("\n\n"), F.col("md")).alias("study"), F.when(d % 3 == 0, F.col("native")).otherwise(F.col("md")).alias("key"), views.pick(d, _CHECKS).alias("check"))
    return replies.evaluate_notes(notes)
