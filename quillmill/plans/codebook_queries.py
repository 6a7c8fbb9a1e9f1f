"""Queries on codebooks: spans of a synthetic one, made of orders, as variables with categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import codebook as C
from . import views
from .views import size_hint
from .registry import picked, query, quoted

FIELDS = list(C.DICTIONARY.fields)
#: Lines of a page, and the height of one.
LINES, HEIGHT = 40, 15
#: Orders' numbers to a range of a document's lines, and bytes of the table for each part that is dealt.
ORDERS, DEAL_BYTES = 97_000, 4 << 20
# Kinds of lines, by what an order's number leaves by 7 and the line's number: headings may be missing,
# doubled or out of place, so all modes meet all events.
KINDS = [
    ["variable", "field", "more", "table", "numbers", "label", "total"],
    ["variable", "field", "field", "more", "table", "numbers", "total"],
    ["variable", "more", "table", "label", "numbers", "numbers", "total"],
    ["contents", "listed", "listed", "field", "listed", "table", "listed"],
    ["variable", "table", "numbers", "label", "label", "field", "more"],
    ["field", "more", "table", "numbers", "total", "label", "total"],
    ["variable", "field", "table", "total", "numbers", "table", "numbers"],
]


def _at(x0: float, x1: float, text: Column, bold: bool = False) -> list[Column]:
    return [F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), text.alias("text"), F.lit(bold).alias("bold")]


def _packed(k: Column, n: Column, p: Column) -> Column:
    """An item as one number, null if it doesn't fit: 31, 4 and 28 bits."""
    fits = k.between(0, (1 << 31) - 1) & n.between(0, 15) & p.between(0, (1 << 28) - 1)
    return F.when(fits, F.shiftleft(k, 32) + F.shiftleft(n, 28) + p)


def _unpacked(item: Column) -> Column:
    return F.struct(F.shiftright(item, 32).alias("k"), F.shiftright(item, 28).bitwiseAND(F.lit(15)).alias("n"), item.bitwiseAND(F.lit((1 << 28) - 1)).alias("p"))


def codebook_lines(spark, sf_dir) -> DataFrame:
    """doc, page and lines, an array of items in order (k, n, p: order, line's number, part), dealt by document
    and page: a document for every 97th order, a line for each of its items. A line's number is its place among
    the document's orders of one range, after the lines of the ranges before. Items are exchanged as one
    number each (those that don't fit, as structs): by document and range, then as pieces of pages."""
    table = views.table(spark, sf_dir, "lineitem")
    item = [F.col(f"l_{name}").cast("long").alias(x) for name, x in (("orderkey", "k"), ("linenumber", "n"), ("partkey", "p"))]
    k, n, p = (F.col(x) for x in "knp")
    fitting, odd = _packed(k, n, p), F.when(_packed(k, n, p).isNull(), F.struct("k", "n", "p"))
    packed = table.select(*item).select(fitting.alias("_item"), odd.alias("_odd"))
    of_range = [F.expr(f"coalesce(shiftright(_item, 32), _odd.k) {by}") for by in ("% 97", f"div {ORDERS}")]
    ranges = [c.alias(name) for c, name in zip(of_range, ("doc", "part"), strict=True)]
    before = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = packed.select(*ranges).groupBy("doc", "part").count().select("doc", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    items = packed.repartition(*of_range).select(*ranges, F.coalesce("_odd", _unpacked(F.col("_item"))).alias("_i")).select("doc", "part", "_i.*")
    own = F.row_number().over(Window.partitionBy("doc", "part").orderBy("k", "n", "p")) - 1
    lines = items.withColumn("own", own).join(parts, ["doc", "part"]).withColumn("page", F.expr(f"(before + own) div {LINES} + 1"))
    pieces = lines.groupBy("doc", "part", "page").agg(F.collect_list(fitting).alias("_items"), F.collect_list(odd).alias("_odd"))
    deals = max(spark.sparkContext.defaultParallelism, size_hint(table) // DEAL_BYTES)
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    pages = pieces.select("doc", "page", "_items", "_odd").repartition(deals, "doc", "page").groupBy("doc", "page").agg(whole("_items"), whole("_odd"))
    mixed = F.sort_array(F.concat(F.transform("_items", _unpacked), "_odd"))
    ordered = F.when(F.size("_odd") == 0, F.transform(F.sort_array("_items"), _unpacked)).otherwise(mixed)  # as numbers they have the same order
    return pages.select("doc", "page", ordered.alias("lines"))


def codebook_pages(spark, sf_dir) -> DataFrame:
    """doc, page and spans, an array (y, x0, x1, text, bold): those of the lines. They are made where the lines
    lie, so what is dealt is the lines."""
    kinds = F.array(*(F.array(*map(F.lit, x)) for x in KINDS))
    kind = lambda i: F.get(F.get(kinds, (i["k"] % 7).cast("int")), (i["n"] - 1).cast("int"))
    lines = F.transform("lines", lambda i: F.struct(kind(i).alias("kind"), *(i[x].alias(x) for x in "knp")))
    pages = codebook_lines(spark, sf_dir).select("doc", "page", lines.alias("lines"))
    return pages.select("doc", "page", F.flatten(F.transform("lines", _spans)).alias("spans"))


def _spans(line: Column, place: Column) -> Column:
    """The spans of a line at a place of its page (0, 1, ...)."""
    kind, k, n, p = (line[x] for x in ("kind", "k", "n", "p"))
    s = lambda c: c.cast("string")
    lit = F.lit
    number = views.pick(k + n, FIELDS)
    lines = {
        "variable": [_at(40, 110, lit(C.DICTIONARY.heading), True), _at(120, 170, F.concat(lit("V"), s(k))), _at(200, 240, lit("Length:"), True), _at(250, 260, s(k % 9)), _at(300, 350, lit("Position:"), True), _at(360, 380, s(p))],
        "field": [_at(40, 100, F.concat(number, lit(":")), True), _at(178, 300, F.concat(lit("text "), s(p))), _at(310, 330, lit("end"))],
        "more": [_at(178, 290, F.concat(F.when(n % 2 == 0, "- ").otherwise(""), lit("more "), s(p)))],
        "table": [_at(40, 140, lit("Answer Categories"), True), _at(280, 306, lit("Code"), True), _at(350, 387, lit("Frequency"), True)],
        "numbers": [_at(40, 150, F.concat(lit("answer "), s(p % 5))), _at(290, 306.5, s(n)), _at(350, 386, F.concat(s(p % 9 + 1), lit(",000"))), _at(440, 485, s(p)), _at(500, 523, lit("12.5"))],
        "label": [_at(40, 150, F.concat(lit("wrapped "), s(p % 7)))],
        "total": [_at(40, 90, lit("Total"), True), _at(350, 387, s(k)), _at(440, 485, s(p)), _at(500, 523, lit("100.0"))],
        "contents": [_at(40, 100, lit("Variable")), _at(150, 200, lit("Position")), _at(250, 330, lit("Description"))],
        "listed": [_at(40, 100, F.concat(lit("V"), s(p))), _at(150, 200, s(k)), _at(250, 330, F.concat(lit("about "), s(n))), _at(340, 535, F.concat(F.when(p % 2 == 0, "..... ").otherwise(""), s(p % 300)))],
    }
    y = F.lit(60.0) + place * HEIGHT
    spans = [F.when(kind == name, F.array(*(F.struct((y + i * 0.25).alias("y"), *cell) for i, cell in enumerate(cells)))) for name, cells in lines.items()]
    return F.coalesce(*spans, F.array().cast("array<struct<y:double,x0:double,x1:double,text:string,bold:boolean>>"))


# The same machine over whole documents in SQL, from the kinds of lines.
_BOOK = rf"""
li AS (SELECT l_orderkey % 97 AS doc, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, [{", ".join(f"[{', '.join(map(quoted, x))}]" for x in KINDS)}][l_orderkey % 7 + 1][l_linenumber] AS kind,
  row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS line FROM lineitem),
c1 AS (SELECT *, last_value(CASE WHEN kind IN ('variable', 'contents') THEN kind END IGNORE NULLS) OVER d AS const FROM li WINDOW d AS (PARTITION BY doc ORDER BY line)),
c2 AS (SELECT *, CASE WHEN kind IN ('variable', 'contents') OR (const = 'variable' AND kind IN ('field', 'table')) THEN kind END AS event FROM c1),
c3 AS (SELECT *, last_value(event IGNORE NULLS) OVER d AS latest, last_value(CASE WHEN event IN ('variable', 'field') THEN event END IGNORE NULLS) OVER d AS opened,
  count(*) FILTER (event = 'variable') OVER d AS record, count(*) FILTER (event IN ('variable', 'field')) OVER d AS slot FROM c2 WINDOW d AS (PARTITION BY doc ORDER BY line)),
c4 AS (SELECT *, CASE WHEN const IS NULL THEN 'none' WHEN const = 'contents' THEN 'contents' WHEN latest = 'table' THEN 'table' ELSE 'fields' END AS mode FROM c3),
b AS (SELECT *, count(*) FILTER (mode = 'table' AND event IS NULL AND kind = 'numbers') OVER (PARTITION BY doc ORDER BY line) AS category FROM c4)"""
_PAGE = f"(line // {LINES} + 1)::BIGINT"


def _read(spark, sf_dir):
    return C.parsed(C.rows_of_pages(codebook_pages(spark, sf_dir), ["doc"]), ["doc"])


@query(rf"WITH {_BOOK} SELECT doc, record::BIGINT AS record, 'V' || k AS name, (k % 9)::VARCHAR AS length, p::VARCHAR AS position, {_PAGE} AS page FROM b WHERE event = 'variable'")
def codebook_variables(spark, sf_dir):
    return C.variables(_read(spark, sf_dir), ["doc"])


@query(
    rf"""WITH {_BOOK}, x AS (SELECT doc, record, slot, line, event, CASE WHEN event = 'field' THEN {picked("k + n", FIELDS)} END AS field,
      CASE WHEN event = 'field' THEN 'text ' || p || ' end' WHEN kind = 'more' AND n % 2 = 0 THEN ' — more ' || p ELSE ' more ' || p END AS piece FROM b WHERE event = 'field' OR (event IS NULL AND mode = 'fields' AND opened = 'field' AND kind = 'more')),
    s AS (SELECT doc, record, slot, max(field) AS field, trim(string_agg(piece, '' ORDER BY line)) AS value FROM x GROUP BY 1, 2, 3)
    SELECT doc, record::BIGINT AS record, field, arg_max(value, slot) AS value FROM s GROUP BY ALL"""
)
def codebook_fields(spark, sf_dir):
    return C.fields(_read(spark, sf_dir), ["doc"])


@query(
    rf"""WITH {_BOOK}, x AS (SELECT doc, record, category, line, kind, n, p, CASE kind WHEN 'numbers' THEN 'answer ' || p % 5 WHEN 'label' THEN 'wrapped ' || p % 7 WHEN 'more' THEN CASE WHEN n % 2 = 0 THEN '- ' ELSE '' END || 'more ' || p
      ELSE 'V' || p || ' ' || k || ' about ' || n || ' ' || CASE WHEN p % 2 = 0 THEN '..... ' ELSE '' END || p % 300 END AS label FROM b WHERE event IS NULL AND mode = 'table' AND kind <> 'total'),
    g AS (SELECT doc, record, category, string_agg(label, ' ' ORDER BY line) AS label, max(CASE WHEN kind = 'numbers' THEN n END) AS n, max(CASE WHEN kind = 'numbers' THEN p END) AS p FROM x GROUP BY ALL HAVING bool_or(kind = 'numbers'))
    SELECT doc, record::BIGINT AS record, (row_number() OVER (PARTITION BY doc, record ORDER BY category))::INT AS ord, label, n::VARCHAR AS code, (p % 9 + 1) || ',000' AS freq, p::VARCHAR AS wfreq, '12.5' AS pct FROM g"""
)
def codebook_categories(spark, sf_dir):
    return C.categories(_read(spark, sf_dir), ["doc"])


@query(rf"WITH {_BOOK} SELECT doc, record::BIGINT AS record, '' AS code, arg_max(k, line)::VARCHAR AS freq, arg_max(p, line)::VARCHAR AS wfreq, '100.0' AS pct FROM b WHERE kind = 'total' AND mode = 'table' GROUP BY 1, 2")
def codebook_totals(spark, sf_dir):
    return C.totals(_read(spark, sf_dir), ["doc"])


@query(
    rf"""WITH {_BOOK} SELECT doc, {_PAGE} AS page, (60 + (line % {LINES}) * {HEIGHT})::DOUBLE AS y, 'V' || p AS name, k::VARCHAR AS position, 'about ' || n AS description, (p % 300)::VARCHAR AS listed_page FROM b WHERE mode = 'contents' AND kind = 'listed' AND event IS NULL"""
)
def codebook_contents(spark, sf_dir):
    return C.contents(_read(spark, sf_dir), ["doc"])


@query(
    rf"""WITH {_BOOK}, q AS (SELECT *, bool_or(mode = 'table' AND event IS NULL AND kind = 'numbers') OVER (PARTITION BY doc, record, category) AS has FROM b)
    SELECT doc, {_PAGE} AS page, (60 + (line % {LINES}) * {HEIGHT})::DOUBLE AS y, mode, kind FROM q WHERE event IS NULL AND (mode = 'fields' AND NOT (opened = 'field' AND kind = 'more') OR mode = 'table' AND kind IN ('label', 'more', 'listed') AND NOT has)"""
)
def codebook_unread(spark, sf_dir):
    first = F.element_at(F.split("text", " "), 1)
    kind = F.when(first == "Total", "total").when(first == "answer", "numbers").when(first == "wrapped", "label").when(first.isin("more", "-"), "more").otherwise("listed")
    return C.unread(_read(spark, sf_dir), ["doc"]).select("doc", "page", "y", "mode", kind.alias("kind"))
