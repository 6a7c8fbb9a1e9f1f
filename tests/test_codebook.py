"""A codebook of known content, its pages broken at every row in turn."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import codebook as C
from quillmill.operators import layout as L
from quillmill.plans import codebook_queries as Q
from quillmill.plans.registry import ORACLES

from . import oracle

# y, then cells (x0, x1, text, bold)
LINES = [
    [(40, 90, "stray", False)],
    [(40, 100, "Variable", False), (150, 200, "Position", False), (250, 330, "Description", False)],
    [(40, 60, "AGE_1", False), (150, 170, "1-2", False), (250, 400, "Age of respondent ......", False), (500, 510, "17", False)],
    [(40, 60, "Concept:", True), (178, 200, "Contents", False), (250, 330, "are read here", False)],
    [(40, 110, "Variable Name:", True), (120, 170, "AGE_1", False), (200, 240, "Length:", True), (250, 260, "2", False), (300, 350, "Position:", True), (360, 380, "1-2", False)],
    [(178, 300, "no field yet", False)],
    [(40, 100, "Concept:", True), (178, 300, "Age", False)],
    [(40, 100, "Question Text:", True), (178, 300, "How old", False)],
    [(178, 300, "are you?", False)],
    [(178, 300, "- years", False)],
    [(40, 100, "Concept:", True), (178, 300, "Age, again", False)],
    [(40, 140, "Answer Categories", True), (280, 306, "Code", True)],
    [(40, 140, "early", False)],
    [(40, 150, "under 18", False), (290, 306, "1", False), (350, 387, "1,000", False), (440, 485, "900", False), (500, 523, "40.0", False)],
    [(40, 150, "years", False)],
    [(40, 140, "Answer Categories", True), (280, 306, "Code", True)],
    [(40, 150, "others", False), (290, 306, "2", False), (350, 387, "500", False)],
    [(40, 90, "Total", True), (350, 387, "1,500", False), (440, 485, "1,400", False), (500, 523, "100.0", False)],
    [(40, 110, "Variable Name:", True), (120, 170, "SEX", False)],
    [(40, 140, "Answer Categories", True), (280, 306, "Code", True)],
    [(40, 150, "late label", False)],
]


def read(spark, per_page):
    rows = [("d", k // per_page + 1, 60.0 + (k % per_page) * 15 + 0.2 * i, *map(float, c[:2]), *c[2:]) for k, cells in enumerate(LINES) for i, c in enumerate(cells)]
    rows += [("d", 1, 20.0, 40.0, 90.0, "running header", False), ("e", 1, 100.0, 40.0, 90.0, "nothing here", False)]
    spans = spark.createDataFrame(rows, "doc string, page int, y double, x0 double, x1 double, text string, bold boolean")
    return C.parsed(C.rows_of(spans, ["doc"]), ["doc"]).cache()


@pytest.mark.parametrize("per_page", [1, 4, 40])
def test_codebook(spark, per_page):
    r = read(spark, per_page)
    assert [(v.record, v.name, v.length, v.position) for v in C.variables(r, ["doc"]).orderBy("record").collect()] == [(1, "AGE_1", "2", "1-2"), (2, "SEX", "", "")]
    assert [(x.name, x.position, x.description, x.listed_page) for x in C.contents(r, ["doc"]).collect()] == [("AGE_1", "1-2", "Age of respondent", "17")]
    assert {(f.record, f.field): f.value for f in C.fields(r, ["doc"]).collect()} == {(1, "Concept"): "Age, again", (1, "Question Text"): "How old are you? — years"}
    assert [tuple(c)[1:] for c in C.categories(r, ["doc"]).orderBy("record", "ord").collect()] == [(1, 1, "under 18 years", "1", "1,000", "900", "40.0"), (1, 2, "others", "2", "500", "", "")]
    assert [tuple(t)[1:] for t in C.totals(r, ["doc"]).collect()] == [(1, "", "1,500", "1,400", "100.0")]
    assert sorted(u.text for u in C.unread(r, ["doc"]).collect()) == ["early", "late label", "no field yet"]
    assert {m.mode for m in r.filter(F.col("doc") == "e").collect()} == {"none"}


def test_rows_stay(spark):
    """Rows that lie by document and page are read where they lie: beyond what deals them out, only the
    pages' rows are exchanged."""
    spans = spark.range(100).selectExpr("id DIV 50 AS doc", "id DIV 10 AS page", "60.0D + id AS y", "40.0D AS x0", "90.0D AS x1", "'x' AS text", "false AS bold").repartition(3, "doc", "page")
    plan = C.unread(C.parsed(C.rows_of(spans, ["doc"]), ["doc"]), ["doc"])._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "REPARTITION_BY_NUM" not in line]
    assert len(moved) <= 2 and plan.count("SortMergeJoin") <= 1, moved


def moved_once(df):
    """Lines lie in one exchange by range and one by page, both read again by whoever needs them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [word for line in plan.split("\n") if "ReusedExchange" not in line for word in re.findall(r"REPARTITION_BY_\w+", line)]
    assert sorted(dealt) == ["REPARTITION_BY_COL", "REPARTITION_BY_NUM"] and "ReusedExchange" in plan


def test_totals_move_lines_once(spark):
    moved_once(Q.codebook_totals(spark, oracle.SF))


def test_page_rows(spark):
    """Rows and cells by one grouping are those of row_groups and merge_cells."""
    r = random.Random(5)
    texts = ["a", "b ", " c", "", "d\t\te", "f  g", None]
    spans = [(r.randrange(4), r.choice([None, *(k * 0.9 for k in range(40))]), x := r.choice([None, *(k * 1.3 for k in range(60))]), x and x + r.choice([0.5, 1.0, 4.0]), r.choice(texts), r.choice([True, False, None])) for _ in range(400)]
    df = spark.createDataFrame(sorted(set(spans), key=str), "page int, y double, x0 double, x1 double, text string, bold boolean")
    cells = L.merge_cells(L.row_groups(df, ["page"]), ["page", "row_y"])
    told = L.page_rows(df, ["page"]).select("page", F.col("y").alias("row_y"), F.inline("cells")).select(*cells.columns)
    assert sorted(map(str, told.collect())) == sorted(map(str, cells.collect())) and told.count() > 100


def test_rows_in_pages(spark):
    """Pages as arrays give the rows of their spans: in any order, some without a height, some missing; slow
    drifts among them; pages without spans give none."""
    r = random.Random(7)
    spans = [(p, r.choice([None, *(k * d for k in range(30))]), float(r.randrange(60)), 1.0, r.choice("abc"), r.random() < 0.5) for p, d in ((1, 0.9), (2, 15.0), (3, 2.5), (4, 2.6)) for _ in range(80)]
    spans = [(*s[:3], s[2] + s[3], *s[4:]) for s in spans] + [(5, None, 1.0, 2.0, "a", False)]
    df = spark.createDataFrame(spans, "page int, y double, x0 double, x1 double, text string, bold boolean")
    span = F.struct("y", "x0", "x1", "text", "bold")
    pages = df.groupBy("page").agg(F.shuffle(F.concat(F.collect_list(span), F.array(F.lit(None)))).alias("spans"))
    none = pages.select((F.col("page") + 10).alias("page"), F.slice("spans", 1, 0).alias("spans")).unionByName(pages.select((F.col("page") + 20).alias("page"), F.when(F.lit(False), F.col("spans")).alias("spans")))
    found, told = (sorted(map(str, x.collect())) for x in (L.rows_in_pages(pages.unionByName(none), ["page"]), L.page_rows(df, ["page"])))
    assert found == told and len(told) > 60
    cells = L.merge_cells(L.row_groups(df.filter("y IS NOT NULL"), ["page"]), ["page", "row_y"])
    assert sorted(map(str, L.rows_in_pages(pages, ["page"]).select("page", F.col("y").alias("row_y"), F.inline("cells")).select(*cells.columns).collect())) == sorted(map(str, cells.collect()))


def test_items_that_do_not_fit(spark, tmp_path):
    """Numbers beyond those that are packed, among others of their document, keep their place."""
    rows = [(97 * k + big, n, p + far) for k in range(60) for n in (1, 2, 3, 5, 7, 16, 20) for p in (k, 1) for far in (0, 1 << 30) for big in (0, 97 << 31)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("codebook_totals", "codebook_variables", "codebook_contents", "codebook_unread"):
        found = oracle.rows(getattr(Q, name)(spark, str(tmp_path)))
        assert found and found == oracle.sql_rows(ORACLES[name], con=con), name


def test_variables_move_lines_once(spark):
    moved_once(Q.codebook_variables(spark, oracle.SF))


def made(df, *names):
    """df's plan makes none of these columns, and no page again of its spans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(y" not in plan and not [n for n in names if f" AS {n}#" in plan]


def test_variables_make_what_they_need(spark):
    made(Q.codebook_variables(spark, oracle.SF), "_kinds", "_in_table", "_since", "_n0")


def test_contents_move_lines_once(spark):
    moved_once(Q.codebook_contents(spark, oracle.SF))


def test_unread_move_lines_once(spark):
    moved_once(Q.codebook_unread(spark, oracle.SF))


def test_contents_make_what_they_need(spark):
    made(Q.codebook_contents(spark, oracle.SF), "_since", "_n0")


def test_unread_makes_pages_once(spark):
    made(Q.codebook_unread(spark, oracle.SF))


def zipped_once(df):
    """Cells are not zipped again to number them."""
    assert not re.search(r"sequence\(1, size\(_c#", df._jdf.queryExecution().optimizedPlan().toString())


def test_contents_zip_cells_once(spark):
    zipped_once(Q.codebook_contents(spark, oracle.SF))


def test_unread_zip_cells_once(spark):
    zipped_once(Q.codebook_unread(spark, oracle.SF))


def test_cells_of_a_kind(spark):
    """Of cells in one column the last counts, the others of no column are the label; unknown texts are left out."""
    cells = [(40.0, 60.0, "a", False), (61.0, 306.0, "1", False), (100.0, 305.0, "2", False), (310.0, 387.0, None, False), (400.0, 410.0, "b", False)]
    df = spark.createDataFrame([("d", 1, 60.0, cells), ("d", 1, 80.0, cells[:1]), ("d", 1, 90.0, [])], "doc string, page int, y double, cells array<struct<x0:double,x1:double,text:string,bold:boolean>>")
    found = C.parsed(df.filter("size(cells) > 0"), ["doc"]).orderBy("y").select("label", "code", "freq").collect()
    assert [tuple(r) for r in found] == [("a b", "2", None), ("a", None, None)]


def test_cells_without_numbers(spark):
    """Cells are the same whether they are numbered or not, uneven texts among them."""
    texts = ["a", " b", "c  d", "e\tf", "", None, "g h", "i "]
    span = [(60.0 + k // 3 * 15, k * 40.0, k * 40.0 + 9, t, True) for k, t in enumerate(texts)]
    pages = spark.createDataFrame([(1, span)], "page int, spans array<struct<y:double,x0:double,x1:double,text:string,bold:boolean>>")
    numbered, plain = (L.rows_in_pages(pages, ["page"], numbered=n).select("y", F.inline("cells")).drop("cell").orderBy("y", "x0").collect() for n in (True, False))
    assert numbered == plain and [r.text for r in plain] == ["a", "b", "c d", "e f", "", None, "g h", "i"]
