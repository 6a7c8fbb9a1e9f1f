"""Queries on positioned text and on arithmetic checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from . import views
from .registry import picked, query

_SPANS = """s AS (SELECT l_orderkey AS page, (floor((l_linenumber - 1) / 2) * 12)::DOUBLE AS y, (l_suppkey % 100)::DOUBLE * 5 AS x0, (l_suppkey % 100)::DOUBLE * 5 + l_quantity AS x1, l_returnflag || l_partkey AS text, l_linestatus = 'O' AS bold, l_linenumber AS n FROM lineitem)"""


@query(f"WITH {_SPANS} SELECT page, count(*) AS n_spans, count(DISTINCT y) AS n_rows, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY 1")
def spans_rows(spark, sf_dir):
    return views.spans(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n_spans"), F.count_distinct("y").alias("n_rows"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"WITH {_SPANS} SELECT page, n FROM s WHERE y > 6 AND y < 30")
def crop_rows(spark, sf_dir):
    return layout.crop(views.spans(spark, sf_dir), 6, 30).select("page", "n")


@query(f"""WITH RECURSIVE {_SPANS}, d AS (SELECT page, n, y / 12 * 2 + n % 3 AS y FROM s), a AS (SELECT page, min(y) AS y FROM d GROUP BY 1 UNION ALL SELECT a.page, (SELECT min(y) FROM d WHERE d.page = a.page AND d.y > a.y + 2.5) AS y FROM a WHERE a.y IS NOT NULL)
  SELECT page, n, y, (SELECT max(a.y) FROM a WHERE a.page = d.page AND a.y <= d.y) AS row_y FROM d""")
def row_group(spark, sf_dir):
    drift = views.spans(spark, sf_dir).withColumn("y", F.col("y") / 12 * 2 + (F.col("n") % 3))
    return layout.row_groups(drift, ["page"]).select("page", "n", "y", "row_y")


@query(f"""WITH {_SPANS}, g AS (SELECT *, x0 - lag(x1) OVER w AS gap FROM s WINDOW w AS (PARTITION BY page, y ORDER BY x0, x1, text)),
  c AS (SELECT *, sum((gap IS NULL OR gap >= 3)::INT) OVER (PARTITION BY page, y ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS cell FROM g)
  SELECT page, y, cell::BIGINT AS cell, min(x0) AS x0, arg_max(x1, (x0, x1, text)) AS x1, trim(string_agg(CASE WHEN gap < 0.8 THEN '' ELSE ' ' END || text, '' ORDER BY x0, x1, text)) AS text, bool_or(bold) AS bold FROM c GROUP BY page, y, cell""")
def cell_merge(spark, sf_dir):
    return layout.merge_cells(views.spans(spark, sf_dir), ["page", "y"]).withColumn("cell", F.col("cell").cast("long"))


_EDGES = [("a", 60.0), ("b", 150.0), ("c", 300.0), ("d", 420.0)]


@query(f"""WITH {_SPANS}, e AS (SELECT *, list_sort([{", ".join(f"{{'d': abs({v} - x1), 'col': '{n}'}}" for n, v in _EDGES)}])[1] AS b FROM s), c AS (SELECT page, y, n, x0, CASE WHEN b.d <= 4 THEN b.col END AS col FROM e)
  SELECT page, n, col, col IS NOT NULL AND row_number() OVER (PARTITION BY page, y, col ORDER BY x0, n) > 1 AS filled FROM c""")
def nearest_edge(spark, sf_dir):
    return layout.nearest_edge(views.spans(spark, sf_dir), _EDGES, ["page", "y"], ["x0", "n"]).select("page", "n", "col", "filled")


@query(f"WITH {_SPANS} SELECT page, n, CASE WHEN NOT regexp_matches(ltrim(text, 'ANR'), '^[0-9.,\\s-]+$') THEN 'label' " + " ".join(f"WHEN abs(x1 - {v}) <= 4 THEN '{n}'" for n, v in _EDGES) + " ELSE 'label' END AS col FROM s")
def edge_tolerance(spark, sf_dir):
    s = views.spans(spark, sf_dir)
    return s.select("page", "n", layout.column_of(F.col("x1"), F.expr("ltrim('ANR', text)"), _EDGES).alias("col"))


@query(f"WITH {_SPANS} SELECT page, n, greatest(0, len(list_filter([40.0, 120.0, 260.0, 400.0], lambda c: x0 >= c - 6)) - 1)::INT AS col FROM s")
def asof_column(spark, sf_dir):
    return views.spans(spark, sf_dir).select("page", "n", layout.column_start(F.col("x0"), [40, 120, 260, 400]).alias("col"))


_RULES = "r AS (SELECT DISTINCT l_orderkey AS page, (l_linenumber * 5)::DOUBLE AS y FROM lineitem WHERE l_returnflag = 'R')"


@query(f"""WITH {_SPANS}, {_RULES}, d AS (SELECT DISTINCT page, y FROM s), p AS (SELECT page, y, lag(y) OVER (PARTITION BY page ORDER BY y) AS prior FROM d)
  SELECT page, y, EXISTS (SELECT 1 FROM r WHERE r.page = p.page AND r.y > p.prior AND r.y < p.y) AS new_row FROM p""")
def rule_between(spark, sf_dir):
    rules = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 5).cast("double").alias("y")).distinct()
    return layout.rule_between(views.spans(spark, sf_dir).select("page", "y").distinct(), rules, ["page"])


@query("SELECT l_orderkey, l_linenumber, sum((l_returnflag = 'N')::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS record FROM lineitem")
def record_id(spark, sf_dir):
    r = layout.record_ids(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], F.col("l_returnflag") == "N", ["l_suppkey"])
    return r.select("l_orderkey", "l_linenumber", "record")


@query("""WITH r AS (SELECT conv_id, turn, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS rec FROM conversations)
  SELECT conv_id, rec::BIGINT AS rec, md5(string_agg(text, ' ' ORDER BY turn, text)) AS label FROM r GROUP BY 1, 2""")
def wrapped_label(spark, sf_dir):
    r = layout.record_ids(views.table(spark, sf_dir, "conversations"), ["turn", "text"], F.col("role") == "user", ["conv_id"])
    label = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return r.groupBy("conv_id", F.col("record").alias("rec")).agg(F.md5(F.array_join(label, " ")).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)")
def section_change(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return layout.section_changes(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], F.col("l_returnflag")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("""WITH f AS (SELECT l_suppkey AS k, string_agg(l_returnflag, '' ORDER BY l_orderkey, l_linenumber, l_partkey) AS found, string_agg(CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 1 THEN 'X' ELSE l_returnflag END, '' ORDER BY l_orderkey, l_linenumber, l_partkey) AS toc FROM lineitem GROUP BY 1)
  SELECT k, found = toc AS matches FROM f""")
def toc_match(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey"))
    listed = F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") == 1), "X").otherwise(F.col("l_returnflag"))
    return layout.same_order(li.withColumn("name", F.col("l_returnflag")), li.withColumn("name", listed), ["k"], ["l_orderkey", "l_linenumber", "l_partkey"], "name")


@query("""WITH t AS (SELECT l_orderkey AS page, arg_max(l_returnflag || l_partkey, (l_linenumber, l_partkey, l_returnflag)) AS title FROM lineitem GROUP BY 1)
  SELECT o_orderkey, title, contains(title, o_orderstatus) AS agrees FROM orders LEFT JOIN t ON page = o_orderkey""")
def toc_title(spark, sf_dir):
    title = F.max_by(F.concat("l_returnflag", F.col("l_partkey").cast("string")), F.struct("l_linenumber", "l_partkey", "l_returnflag"))
    t = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(title.alias("title"))
    return views.table(spark, sf_dir, "orders").join(t, "o_orderkey", "left").select("o_orderkey", "title", F.contains("title", F.col("o_orderstatus")).alias("agrees"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice)::BIGINT AS w FROM lineitem), s AS (SELECT k, sum(n)::BIGINT AS n, sum(w)::BIGINT AS w, count(*) AS c FROM p GROUP BY 1)
  , t AS (SELECT k, n + (k % 11 = 0)::BIGINT AS tn, w + c + (k % 7 = 0)::BIGINT AS tw FROM s) SELECT k, n = tn AS exact, abs(w - tw) <= c AS close FROM s JOIN t USING (k)""")
def sum_vs_total(spark, sf_dir):
    p = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round("l_extendedprice").cast("long").alias("w"))
    wrong = lambda by: (F.col("k") % by == 0).cast("long")
    totals = p.groupBy("k").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("c"))
    return layout.sums_to_total(p, totals.select("k", (F.col("n") + wrong(11)).alias("n"), (F.col("w") + F.col("c") + wrong(7)).alias("w")), ["k"])


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) <= 1 AS one_total FROM lineitem GROUP BY 1")
def total_unique(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") <= 1).alias("one_total"))


_PARTIAL = ["code", "freq", "wfreq", "pct"]


@query(f"SELECT event_id, len(list_filter([CASE WHEN event_id % 6 <> 0 THEN 'label' END, nullif({picked('event_id', [*_PARTIAL, ''])}, '')], lambda c: c IS NULL)) = 0 AS complete FROM events")
def row_complete(spark, sf_dir):
    e = F.col("event_id")
    cells = F.array(F.when(e % 6 != 0, "label"), F.nullif(views.pick(e, [*_PARTIAL, ""]), F.lit("")))
    return views.table(spark, sf_dir, "events").select("event_id", F.forall(cells, lambda c: c.isNotNull()).alias("complete"))


_CV = "c AS (SELECT l_suppkey AS t, l_orderkey + 1 AS x, l_linenumber / 10.0::DOUBLE AS p, round(sqrt((1 - l_linenumber / 10.0::DOUBLE) / (l_orderkey + 1)) * (30 + l_suppkey % 5) + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END, 1) AS v FROM lineitem)"


@query(f"""WITH {_CV}, k AS (SELECT t, list_sort(list(v / sqrt((1 - p) / x))) AS ks FROM c GROUP BY 1) SELECT t, x, p, v FROM c JOIN k USING (t) WHERE abs(ks[len(ks) // 2 + 1] * sqrt((1 - p) / x) - v) > 0.05 + 0.002 * v""")
def cv_fit(spark, sf_dir):
    p = F.col("l_linenumber") / 10.0
    v = F.sqrt((1 - p) / (F.col("l_orderkey") + 1)) * (30 + F.col("l_suppkey") % 5) + F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(0)
    c = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("t"), (F.col("l_orderkey") + 1).alias("x"), p.alias("p"), F.round(v, 1).alias("v"))
    return layout.cv_fit(c, ["t"])


def _boxes(spark, sf_dir):
    return views.spans(spark, sf_dir).select("page", (F.col("y") + F.col("n") * 3).alias("top"), F.col("x0").alias("left"), F.lit(10.0).alias("height"), F.concat("text", F.when(F.col("bold"), "-").otherwise("")).alias("text"))


@query(f"WITH {_SPANS} SELECT page, text || CASE WHEN bold THEN '-' ELSE '' END AS text, row_number() OVER (PARTITION BY page ORDER BY round_even((y + n * 3) / 20, 0), x0, text || CASE WHEN bold THEN '-' ELSE '' END)::INT AS place FROM s")
def ocr_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir), ["page"]).select("page", "text", "place")


@query(f"""WITH {_SPANS}, b AS (SELECT page, y + n * 3 AS top, x0, text || CASE WHEN bold THEN '-' ELSE '' END AS text FROM s), o AS (SELECT *, row_number() OVER w AS place, lead(top) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY page ORDER BY round_even(top / 20, 0), x0, text))
  SELECT page, trim(string_agg(CASE WHEN nxt IS NULL THEN text WHEN nxt - (top + 10) > 8 THEN text || chr(10) || chr(10) WHEN text LIKE '%-' THEN left(text, -1) ELSE text || ' ' END, '' ORDER BY place)) AS text FROM o GROUP BY 1""")
def ocr_join(spark, sf_dir):
    return layout.join_ocr(layout.reading_order(_boxes(spark, sf_dir), ["page"]), ["page"])


_WRAPS = ["one two", "cut-", "this or", "a + b,", "9", "17", "Group:", "see (", "p|q", "either/"]


@query(
    f"""WITH l AS (SELECT l_orderkey AS cell, l_linenumber, l_linenumber * 12 + (l_partkey % 5 = 0)::INT * l_linenumber AS y, 460 + l_quantity * 2 AS x1, {picked("l_partkey + l_linenumber", _WRAPS)} AS t FROM lineitem),
    w AS (SELECT *, lag(t) OVER d AS pt, lag(x1) OVER d AS px, lag(y) OVER d AS py, first(t) OVER d AS head, row_number() OVER d AS place FROM l WINDOW d AS (PARTITION BY cell ORDER BY y, x1, t)),
    j AS (SELECT *, CASE WHEN pt IS NULL OR (cell % 2 = 0 AND regexp_full_match(t, '\\d+') AND regexp_matches(pt, '\\d$')) THEN '' WHEN y - py > 14 THEN '<br><br>' WHEN head = 'Group:' THEN '<br>'
      WHEN px + 4.6 * (length(regexp_extract(t, '^\\s*(\\S*)', 1)) + 1) > 578 THEN ' ' WHEN regexp_matches(pt, '[A-Za-z]-$') THEN '' WHEN regexp_matches(pt, '(\\bor|\\band|\\+|,|\\(|-|/)$') THEN ' ' ELSE '<br>' END AS joint FROM w)
    SELECT cell, replace(string_agg(joint || t, '' ORDER BY place), '|', '\\|') AS text FROM j GROUP BY 1"""
)
def soft_wrap(spark, sf_dir):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (n * 12 + (p % 5 == 0).cast("int") * n).alias("y"), (F.lit(460) + F.col("l_quantity") * 2).alias("x1"), views.pick(p + n, _WRAPS).alias("text"))
    return layout.cell_texts(layout.joints(lines, ["cell"], F.lit(578.0), F.col("cell") % 2 == 0), ["cell"])
