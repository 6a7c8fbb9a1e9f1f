"""Codebooks from positioned rows: variables with their fields, categories and totals, and the contents.

A codebook is read by a machine with four modes: nothing yet, contents, fields of a variable, table of
its categories. A row is one of four events, or none: the contents' heading, a variable's heading, a
field's label, a table's heading. An event maps modes to modes. Two of these maps are constant (the
contents' heading, a variable's heading) and two change only the modes of a variable, so whatever maps
are composed, the result is known from the last constant event and the last event that counts: a mode is
two look-backs.

A heading outside of its place is no event, yet it needn't be known as such for the look-backs: nothing
but a variable's heading leads into a variable, and after it every heading counts.

Look-backs and running counts cross page breaks by composing pages: each page is summed up as one row
(its last headings, its counts, and its rows of numbers as far as what comes before decides on them),
these rows are put in order, and what the pages before a page come to is joined to it. Rows lie by
document and page from the first step to the last; only the pages' rows move. No document is one task's
work.

Defined cases: rows before any heading, and rows that fit nothing in their mode, are told by unread();
a field that comes again in a variable counts with its last value, and so does a total; a label without
numbers goes on the category before it in its variable; null texts are empty; a document without rows
has no results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import EDGE_TOLERANCE, column_of, crop, page_rows, rows_in_pages


@dataclass(frozen=True)
class CodebookSpec:
    """Fixed values of one kind of codebook: its words, and its positions in points."""

    top: float = 50
    bottom: float = 765
    value_x: float = 150
    fields: tuple[str, ...] = ("Question Name", "Concept", "Question Text", "Universe", "Note", "Source")
    #: Right edges of the right-aligned columns of numbers.
    columns: tuple[tuple[str, float], ...] = (("code", 306.0), ("freq", 387.0), ("wfreq", 485.0), ("pct", 523.0))
    contents: tuple[str, ...] = ("Variable", "Position", "Description")
    heading: str = "Variable Name:"
    heading_labels: tuple[str, str] = ("Length:", "Position:")
    table: tuple[str, str] = ("Answer Categories", "Code")
    total: str = "Total"
    name: str = r"^[A-Z0-9_]+$"
    leaders: tuple[str, str] = (r"^(.*?)[ .]*\.\s*(\d+)$", r"^(.*?)\s+(\d+)$")
    item: str = r"^[-•]\s"
    tolerance: float = EDGE_TOLERANCE


DICTIONARY = CodebookSpec()
EVENTS = ("contents", "variable", "field", "table")


def rows_of(spans: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, page, y and cells (x0, x1, text, bold; from the left) of the rows between header and
    footer. spans: keys, page, y, x0, x1, text, bold."""
    return crop(page_rows(spans, [*keys, "page"]), spec.top, spec.bottom)


def rows_of_pages(pages: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """rows_of of pages whose spans are one array. pages: keys, page, spans (y, x0, x1, text, bold)."""
    return crop(rows_in_pages(pages, [*keys, "page"], numbered=False), spec.top, spec.bottom)


def _event(spec: CodebookSpec) -> Column:
    first, texts = F.col("cells")[0], F.col("cells.text")
    has = lambda words: F.array_contains(texts, words)
    label = F.regexp_replace(first["text"], ":+$", "")
    return (
        F.when((first["text"] == spec.contents[0]) & has(spec.contents[1]) & has(spec.contents[2]), "contents")
        .when(first["text"] == spec.heading, "variable")
        .when(first["bold"] & first["text"].endswith(":") & label.isin(*spec.fields), "field")
        .when((first["text"] == spec.table[0]) & has(spec.table[1]), "table")
    )


def _kind(cell: Column, spec: CodebookSpec) -> Column:
    return column_of(cell["x1"], cell["text"], list(spec.columns), spec.tolerance)


def _joined(cells: Column) -> Column:
    return F.array_join(cells["text"], " ")


def parsed(rows: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """rows with event; mode (none, contents, fields, table); record, slot and category, which count the
    variables, the headings of variables and fields, and the rows of numbers so far; kind (what a row
    without event is: listed, value, total, numbers, label, or null); counted, whether its variable has had
    a row of numbers; label and the columns of numbers."""
    page = [*keys, "page"]
    e = F.col("_heading")
    # rows without a key have no place below; told here, so that the pages and their rows read the same exchange
    known = rows.filter(reduce(Column.__and__, (F.col(k).isNotNull() for k in page)))
    r = known.withColumns({"_heading": _event(spec), "_kinds": F.transform("cells", lambda c: _kind(c, spec))})
    # a row's last cell of a kind is looked up; only a row that has kinds besides labels is parted
    texts, kinds = F.col("cells.text"), F.col("_kinds")
    last_of = lambda name: F.get(texts, (F.size("cells") - F.array_position(F.reverse(kinds), name)).cast("int"))
    labels = F.when(F.size(F.array_remove(kinds, "label")) == 0, F.array_join(texts, " ")).otherwise(_joined(F.filter("cells", lambda c, k: F.get(kinds, k) == "label")))
    r = r.withColumns({"label": labels} | {name: last_of(name) for name, _ in spec.columns})
    numbers, cells = F.coalesce(*(F.col(n) for n in ("freq", "wfreq", "pct"))), F.col("cells")
    total = (F.col("label") == spec.total) & cells[0]["bold"]
    # what a row without heading is in a table: a look-back may turn on it, so it is told first
    r = r.withColumn("_in_table", F.when(e.isNull(), F.when(total, "total").when(numbers.isNotNull(), "numbers").otherwise("label")))

    # within the page: the last headings, and rows of numbers by what tells that they are in a table:
    # the page itself (0), the page if it begins in a variable (1), what comes before the page (2)
    down = Window.partitionBy(*page).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda *names: F.last(F.when(e.isin(*names), e), True).over(down)
    many = lambda c: F.count(F.when(c, 1)).over(down)
    r = r.withColumns({"_constant": last("contents", "variable"), "_latest": last(*EVENTS), "_opened": last("variable", "field"), "_records": many(e == "variable"), "_slots": many(e.isin("variable", "field"))})
    table, of_page = F.col("_latest") == "table", F.col("_constant")
    told = [(of_page == "variable") & table, of_page.isNull() & table, of_page.isNull() & F.col("_latest").isNull()]
    r = r.withColumns({f"_n{k}": many(c & (F.col("_in_table") == "numbers")) for k, c in enumerate(told)})
    r = r.withColumn("_since", F.max(F.when(e == "variable", F.col("_n0"))).over(down))  # rows of numbers before the last variable

    # a page as one row: its last line has them all; each by itself, so that those of no use aren't made
    line = ["_constant", "_latest", "_opened", "_records", "_slots", "_n0", "_n1", "_n2", "_since"]
    pages = r.groupBy(*page).agg(*(F.max_by(n, "y").alias(n) for n in line))
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumns({f"_b{n}": F.last(n, True).over(before) for n in ("_constant", "_latest", "_opened")} | {f"_b{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in ("_records", "_slots")})
    pages = pages.withColumns({"_in1": (F.col("_b_constant") == "variable").eqNullSafe(True), "_in2": ((F.col("_b_constant") == "variable") & (F.col("_b_latest") == "table")).eqNullSafe(True)})
    counted = F.when(F.col("_since").isNotNull(), F.col("_n0") > F.col("_since")).when(_counted() > 0, True)
    pages = pages.withColumns({"_b_n": F.coalesce(F.sum(_counted()).over(before), F.lit(0)), "_b_counted": F.coalesce(F.last(counted, True).over(before), F.lit(False))})
    known = ["_b_constant", "_b_latest", "_b_opened", "_b_records", "_b_slots", "_in1", "_in2", "_b_n", "_b_counted"]
    r = r.join(pages.select(*page, *known), page)

    # together: what came before the page, and what the page says itself
    constant = F.coalesce("_constant", "_b_constant")
    in_variable = constant == "variable"
    latest, opened = (F.when(in_variable, F.coalesce(f"_{n}", f"_b_{n}")) for n in ("latest", "opened"))
    r = r.withColumns({"event": F.when(e.isin("contents", "variable") | in_variable, e), "constant": constant, "latest": latest, "opened": opened, "record": F.col("_b_records") + F.col("_records"), "slot": F.col("_b_slots") + F.col("_slots")})
    r = r.withColumn("mode", F.when(F.col("constant").isNull(), "none").when(F.col("constant") == "contents", "contents").when(F.col("latest") == "table", "table").otherwise("fields"))
    kind = (
        F.when(F.col("event").isNotNull(), None)
        .when(F.col("mode") == "contents", F.when(cells[0]["text"].rlike(spec.name) & (F.size(cells) >= 3), "listed"))
        .when(F.col("mode") == "fields", F.when((F.col("opened") == "field") & (cells[0]["x0"] > spec.value_x), "value"))
        .when(F.col("mode") == "table", F.col("_in_table"))
    )
    here = F.when(F.col("_since").isNotNull(), F.col("_n0") > F.col("_since")).otherwise(F.col("_b_counted") | (_counted() > 0))
    r = r.withColumns({"kind": kind, "category": F.col("_b_n") + _counted(), "counted": here})
    return r.drop("_heading", "_kinds", "_in_table", *line, *known)


def _counted() -> Column:
    """Rows of numbers of tables on the page so far, once it is known what came before the page."""
    return F.col("_n0") + F.when(F.col("_in1"), F.col("_n1")).otherwise(0) + F.when(F.col("_in2"), F.col("_n2")).otherwise(0)


def contents(read: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, page, y, name, position, description and listed_page of the rows of the contents."""
    text = _joined(F.slice("cells", 3, F.greatest(F.size("cells"), F.lit(1))))
    listed = F.coalesce(*(F.when(text.rlike(p), F.regexp_extract(text, p, 2)) for p in spec.leaders), F.lit(""))
    described = F.coalesce(*(F.when(text.rlike(p), F.btrim(F.regexp_extract(text, p, 1), F.lit(" ."))) for p in spec.leaders), text)
    return read.filter("kind = 'listed'").select(*keys, "page", "y", F.col("cells")[0]["text"].alias("name"), F.col("cells")[1]["text"].alias("position"), described.alias("description"), listed.alias("listed_page"))


def variables(read: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, record, name, length, position and page of every variable."""
    texts = F.col("cells.text")
    pairs = F.arrays_zip(texts.alias("a"), F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))).alias("b"))
    after = lambda label: F.coalesce(F.get(F.reverse(F.filter(pairs, lambda p: (p["a"] == label) & p["b"].isNotNull())), F.lit(0))["b"], F.lit(""))
    length, position = (after(x) for x in spec.heading_labels)
    return read.filter("event = 'variable'").select(*keys, "record", F.coalesce(F.get(texts, F.lit(1)), F.lit("")).alias("name"), length.alias("length"), position.alias("position"), "page")


def fields(read: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, record, field and value: a label's values, with the lines that go on with them."""
    own = _joined(F.filter(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c["x0"] > spec.value_x))
    text = _joined(F.col("cells"))
    more = F.when(text.rlike(spec.item), F.concat(F.lit(" — "), F.regexp_replace(text, spec.item + "+", ""))).otherwise(F.concat(F.lit(" "), text))
    lines = read.filter("event = 'field' OR kind = 'value'")
    piece = F.struct("page", "y", F.when(F.col("event") == "field", own).otherwise(more).alias("text"))
    label = F.max(F.when(F.col("event") == "field", F.regexp_replace(F.col("cells")[0]["text"], ":+$", ""))).alias("field")
    slots = lines.groupBy(*keys, "record", "slot").agg(label, F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")).alias("value"))
    return slots.groupBy(*keys, "record", "field").agg(F.max(F.struct("slot", "value"))["value"].alias("value"))


def categories(read: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, record, ord (1, 2, ...), label, code, freq, wfreq and pct of the rows of tables."""
    names = [n for n, _ in spec.columns]
    lines = read.filter("kind IN ('numbers', 'label')")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "label"))), lambda p: p["label"]), " ")
    of = lambda n: F.max(F.when(F.col("kind") == "numbers", F.coalesce(F.col(n), F.lit("")))).alias(n)
    rows = lines.groupBy(*keys, "record", "category").agg(label.alias("label"), F.bool_or(F.col("kind") == "numbers").alias("_own"), *(of(n) for n in names)).filter("_own")
    order = F.row_number().over(Window.partitionBy(*keys, "record").orderBy("category"))
    return rows.select(*keys, "record", order.alias("ord"), "label", *names)


def totals(read: DataFrame, keys: list[str], spec: CodebookSpec = DICTIONARY) -> DataFrame:
    """keys, record and the numbers of each variable's total."""
    names = [n for n, _ in spec.columns]
    last = F.max(F.struct("page", "y", *(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names)))
    return read.filter("kind = 'total'").groupBy(*keys, "record").agg(last.alias("_t")).select(*keys, "record", *(F.col(f"_t.{n}").alias(n) for n in names))


def unread(read: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, y, mode and text of the rows of variables that fit nothing: lines of no field, and
    labels before a variable's first category."""
    early = (F.col("kind") == "label") & ~F.col("counted")
    lost = F.col("event").isNull() & ((F.col("mode") == "fields") & F.col("kind").isNull() | early)
    return read.withColumn("_lost", F.coalesce(lost, F.lit(False))).filter("_lost").select(*keys, "page", "y", "mode", _joined(F.col("cells")).alias("text"))
