"""Queries on the structure of formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas as X
from . import views
from .registry import picked, query, quoted

PIECES = [
    "x+1", r"\frac{a}{b}", r"\frac{a}", "{c", "d}", r"\left( y \right)", r"\left[ z", r"\right) w", r"\begin{matrix} p & q \\ \end{matrix}", r"\begin{cases} r", r"\end{cases}",
    "s^", "t_{u}", r"\sqrt[3]{v}", r"\hat", r"\frac12", r"x^\frac{a}{b}", r"\\ e", "& f", r"\begin{aligned}", r"\end{aligned}", r"\sqrt", r"\alpha\beta", "} {", r"\text{if }",
]
_MIX = ["{d}", "({d} // 3) * 7", "{d} * 11 + 5", "({d} // 25) * 3"]


def _tex(spark, sf_dir):
    d = F.col("doc_id")
    parts = [d, F.floor(d / 3) * 7, d * 11 + 5, F.floor(d / 25) * 3]
    tex = F.concat_ws(" ", *(views.pick(p.cast("long"), PIECES) for p in parts))
    # each formula twice, and once with its document's number, so that equal and distinct ones meet
    md = F.concat(F.lit("a $$"), tex, F.lit("$$ b $$"), tex, F.lit("$$ c $$"), tex, F.lit(" "), d.cast("string"), F.lit("$$"))
    return views.table(spark, sf_dir, "documents").select("doc_id", md.alias("md"))


_TOKENS = r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}|\\(?:left|right)\s*(?:\\[A-Za-z]+|[^\s\\])|\\sqrt\s*\[[^\[\]{}\\]*\]|\\[A-Za-z]+|\\.|[{}&^_]|[^\s\\]|\s+"
_NAMES = lambda n: "|".join(k for k, v in X.ARGUMENTS.items() if v == n)

# The stack in SQL: a letter for each thing that is open (g, l, e; x: waits for its last argument, y: for one
# before it), with places and environments beside it. A symbol takes off `y?x*` at the end.
_SQL = rf"""
WITH RECURSIVE f AS (SELECT doc_id, {" || ' ' || ".join(picked(m.format(d="doc_id"), PIECES) for m in _MIX)} AS tex FROM documents),
a AS (SELECT doc_id, unnest([0, 1, 2]) AS place, unnest([tex, tex, tex || ' ' || doc_id]) AS tex FROM f),
t AS (SELECT DISTINCT tex, regexp_extract_all(tex, {quoted(_TOKENS)}) AS ts FROM a),
r AS (SELECT tex, ts, 1 AS i, 0 AS pos, '' AS st, []::INT[] AS ps, []::VARCHAR[] AS es, NULL::VARCHAR AS kind, NULL::INT AS spot FROM t
  UNION ALL
  SELECT tex, ts, i + 1, pos + length(tok), base || push, list_concat(ps[:length(base)], list_transform(range(length(push)), lambda z: pos)), list_concat(es[:length(base)], list_transform(range(length(push)), lambda z: env)),
    CASE WHEN closes AND regexp_matches(st, '[xy]$') THEN 'argument' WHEN pops <> '' AND (right(st, 1) <> pops OR es[length(st)] IS DISTINCT FROM env) THEN CASE pops WHEN 'g' THEN 'group' WHEN 'l' THEN 'left' ELSE 'environment' END END,
    CASE WHEN closes AND regexp_matches(st, '[xy]$') THEN ps[length(st)] WHEN pops <> '' AND (right(st, 1) <> pops OR es[length(st)] IS DISTINCT FROM env) THEN pos END
  FROM (SELECT *, CASE WHEN pops <> '' THEN regexp_replace(left(st, -1), 'y?x*$', '') WHEN push = '' AND NOT closes AND NOT regexp_matches(tok, '^\s') THEN regexp_replace(st, 'y?x*$', '') ELSE st END AS base
    FROM (SELECT *, CASE WHEN tok = '}}' THEN 'g' WHEN tok LIKE '\right%' THEN 'l' WHEN tok LIKE '\end%' THEN 'e' ELSE '' END AS pops,
        CASE WHEN tok = '{{' THEN 'g' WHEN tok LIKE '\left%' THEN 'l' WHEN tok LIKE '\begin%' THEN 'e' WHEN tok IN ('^', '_') OR regexp_full_match(tok, '\\({_NAMES(1)})') OR tok LIKE '\sqrt%[%' THEN 'x' WHEN regexp_full_match(tok, '\\({_NAMES(2)})') THEN 'xy' ELSE '' END AS push,
        tok IN ('}}', '&', '\\') OR tok LIKE '\right%' OR tok LIKE '\end%' AS closes, nullif(regexp_extract(tok, '^\\(?:begin|end)\s*\{{(.*)\}}$', 1), '') AS env
      FROM (SELECT *, ts[i] AS tok FROM r WHERE kind IS NULL AND i <= len(ts))))),
e AS (SELECT tex, coalesce(kind, CASE right(st, 1) WHEN 'g' THEN 'group' WHEN 'l' THEN 'left' WHEN 'e' THEN 'environment' WHEN '' THEN NULL ELSE 'argument' END) AS kind, coalesce(spot, ps[length(st)]) AS spot FROM r WHERE kind IS NOT NULL OR i > len(ts))
SELECT doc_id, place::INT AS place, kind, spot::INT AS "at" FROM a JOIN e USING (tex) WHERE kind IS NOT NULL
"""


@query(_SQL)
def formula_check(spark, sf_dir):
    return X.formula_faults(_tex(spark, sf_dir), ["doc_id"]).select("doc_id", "place", "kind", "at")
