"""The documented cases of the rules, as literal rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions import lint as L
from quillmill.functions import page_check as C
from quillmill.functions import text as T
from quillmill.operators import catalog, formulas, layout, replies, runs, schedule, triage
from quillmill.sources import readers, sinks

NATIVE = "The firm sells goods in the market at given prices and earns revenue of 33,099,725 in the year 2014 while costs remain fixed for every unit sold."
MD = "## Page 3\n\nThe firm sells goods in the market at given prices and earns revenue of 33,099,725 in the year 2014 while costs remain fixed for every unit sold."


def checked(spark, *pairs, image=False):
    df = spark.createDataFrame([(k, n, m) for k, (n, m) in enumerate(pairs)], "k int, native string, md string")
    return C.check_pages(df, F.lit(image)).orderBy("k").collect()


CHANGES = [
    (lambda m: m, "ok"),
    (lambda m: m.replace("goods", "foods"), "flagged"),
    (lambda m: m.replace("33,099,725", "33,099,726"), "flagged"),
    (lambda m: m.replace("33,099,725", "33099725"), "ok"),
    (lambda m: m.replace(" while costs remain fixed for every unit sold", ""), "flagged"),
    (lambda m: m + "\n\n<!-- source: study notes -->", "notes"),
    (lambda m: m.replace("2014", "2014[^3]") + "\n[^3]: Note.", "ok"),
    (lambda m: m + " surplus", "ok"),
]


def test_check_page(spark):
    got = checked(spark, *((NATIVE, change(MD)) for change, _ in CHANGES), (None, None))
    assert [r.status for r in got] == [*(s for _, s in CHANGES), "no-text-layer"]
    assert got[1].missing == {"goods": 1} and got[1].extra == {"foods": 1} and got[2].numbers_extra == {"33099726": 1}
    assert [r.flagged for r in got] == [s == "flagged" for _, s in CHANGES] + [False]


def test_flag_rule(spark):
    """A page is to be looked at for its status, for OCR text, a cut-off reply or any fault."""
    marks = ["", "<!-- source: local OCR -->", "<!-- truncated -->", "$$ a", "[^8]Text", "costs $12.50 now and $7.10 then"]
    got = checked(spark, *((NATIVE, f"{MD}\n\n{m}") for m in marks))
    assert [(r.ocr, r.truncated, bool(r.math), bool(r.markup), r.flagged) for r in got[:5]] == [(False,) * 5, (True, False, False, False, True), (False, True, False, False, True), (False, False, True, False, True), (False, False, False, True, True)]
    assert [x.detail for x in got[5].markup] == ["$12.50 now a", "$7.10 then"]
    df = spark.createDataFrame([(k, NATIVE, f"{MD}\n\n{m}") for k, m in enumerate(marks)], "k int, native string, md string")
    c = C.check_pages(df)
    assert {(r.k, r.kind) for r in C.report_lines(c, ["k"]).collect() if r.k < 5} == {(1, "local OCR"), (2, "cut off"), (3, "math"), (4, "markup")}
    t = C.report_totals(c).first()
    assert (t.ocr, t.truncated, t.math, t.markup, t.to_look_at) == (1, 1, 1, 2, 5)
    notes = {r.k: r.page_notes for r in replies.page_notes(c).collect()}
    assert notes[0] == [] and "lacks its opening" in notes[3][0] and "2 dollar amounts ($12.50, $7.10)" in notes[5][-1]


def test_pages_without_a_file(spark):
    pages = spark.createDataFrame([(1, NATIVE, False), (2, NATIVE, False)], "page int, native string, image boolean")
    got = C.verify(pages, spark.createDataFrame([(1, MD)], "page int, md string"), ["page"]).orderBy("page").collect()
    assert [(r.status, r.flagged, r.n_words > 0) for r in got] == [("ok", False, True), ("no-page-file", False, False)]


def test_forgiveness(spark):
    table = MD + "\n\n| unseen | words | 77 |"
    pairs = [
        (NATIVE.replace("revenue", "rev-\nenue"), MD),
        (NATIVE.replace("revenue", "rev\nenue"), MD),
        (NATIVE.replace("firm", "firmA"), MD.replace("firm", "firm$A$")),
        (NATIVE + " nave nave", MD + " naive naive"),
        (NATIVE + " 70 000", MD + " 70000"),
        (NATIVE + " 70000", MD + " 70 000"),
        (NATIVE + " 0.992622 22", MD + " 0.9926[^22] and[^22]"),
        (NATIVE + " 1.96 96", MD + " $1.96$ x"),
        (NATIVE, table),
        (NATIVE + " test", MD + " tests"),
        (NATIVE + " grand-\nson", MD + " grand son grandson"),
    ]
    assert [r.status for r in checked(spark, *pairs)] == ["ok"] * 7 + ["ok", "flagged", "flagged", "flagged"]
    shown = checked(spark, (NATIVE, table), image=True)[0]
    assert shown.status == "ok" and shown.from_image == {"unseen": 1, "words": 1, "77": 1}


def test_joined_words(spark):
    """Halves that a line break parts; a word never joins twice."""
    df = spark.createDataFrame([("aa-\nbb-\ncc dd\nee ff", ["aabb", "bbcc", "ddee", "ddx"])], "t string, known array<string>")
    known = F.map_from_arrays("known", F.transform("known", lambda _: F.lit(1).cast("long")))
    assert df.select(C.joined_words(F.col("t"), known)).first()[0] == ["aabb", "ddee"]


def test_bags(spark):
    import random

    r = random.Random(7)
    for size in (0, 1, 40, 30_000):
        tokens = [r.choice(["a", "ab", "abc", "b", "1.5", "é"]) for _ in range(size)]
        more = [r.choice(["a", "b", "z"]) for _ in range(20)]
        df = spark.createDataFrame([(tokens, more)], "a array<string>, b array<string>").select(C.bag(F.col("a")).alias("a"), C.bag(F.col("b")).alias("b"))
        x, y = Counter(tokens), Counter(more)
        got = df.select("a", C.minus(F.col("a"), F.col("b")).alias("minus"), C.common(F.col("a"), F.col("b")).alias("common"), C.plus(F.col("a"), F.col("b")).alias("plus"), C.total(F.col("a")).alias("n")).first()
        assert (got.a, got.minus, got.common, got.plus, got.n) == (dict(x), dict(x - y), dict(x & y), dict(x + y), size)


def test_numbers(spark):
    df = spark.createDataFrame([("33,099,725 (1,2) 2.60 1,282 862,492 3.5,",)], "t string")
    assert df.select(T.numbers(F.col("t"))).first()[0] == ["33099725", "1", "2", "2.60", "1282", "862492", "3.5"]


@pytest.mark.parametrize(
    ("md", "amounts"),
    [("it costs $12.50 today", ["$12.50 today"]), ("a formula $12$ here", []), ("$1.23, 7-Up $1.12", ["$1.23, 7-Up ", "$1.12"]), ("$$ 5 $3 $$", []), (r"paid \$5 only", []), ("$$x$$$5 a", []), ("$5 is one two three four $x$", ["$5 is one two"]), (r"$5 \alpha \beta \text{ab} x$", []), ("$5 a\nb$", ["$5 a\nb$"])],
)
def test_money(spark, md, amounts):
    assert lint(spark, md, L.money) == [a[:12] for a in amounts]


def test_escape_and_tags(spark):
    assert lint(spark, "it costs $12.50 today", L.escape_money) == r"it costs \$12.50 today"
    assert lint(spark, r"$$ a \tag{1} b \tag{2} $$", L.one_tag) == r"$$ a \qquad (1) b \qquad (2) $$"
    assert lint(spark, r"$$ a \tag{1} $$ and $$ b \tag{2} \tag{3}", L.one_tag) == r"$$ a \tag{1} $$ and $$ b \tag{2} \tag{3}"
    assert lint(spark, 'json {"wrong": ["\\beta"]}', lambda c: T.texts_of(T.as_object(c), "wrong")) == ["\\beta"]
    assert lint(spark, "none", T.as_object) is None and lint(spark, "[1]", T.as_object) is None


def lint(spark, md, column):
    return spark.createDataFrame([(md,)], "md string").select(column(F.col("md"))).first()[0]


@pytest.mark.parametrize(
    ("md", "column", "bad"),
    [
        ("$$ a", L.unmatched_display, True),
        (r"\$ a $$ b $$", L.unmatched_display, False),
        ("word.$^{12}$", L.math_markers, True),
        ("m$^2$", L.math_markers, False),
        ("[^8]Text", L.fused_labels, True),
        ("[^8]: Text", L.fused_labels, False),
        ("[Exercise 9](Exercise 9)", L.spaced_links, True),
        ('[a](http://x "title")', L.spaced_links, False),
        ("[^2]: text missing from image", L.note_faults, True),
        ("[^2]: A real note.", L.note_faults, False),
    ],
)
def test_lint(spark, md, column, bad):
    assert bool(lint(spark, md, column)) is bad


def test_formulas(spark):
    got = [(x.tex, x.is_display) for x in lint(spark, "$a$ and $$b$$\n\ncost \\$5 $c$ <!-- $d$ -->\n\n$e\n\nf$", L.formulas)]
    assert got == [("b", True), ("a", False), ("c", False)]


def test_replies(spark):
    cut, stop = "length", "stop"
    rows = [("a", 1, "<!-- n -->", stop), ("a", 2, "real", stop), ("b", 1, "part", cut), ("b", 2, "whole", stop), ("c", 1, "par", cut), ("c", 2, "partial", cut), ("d", 1, "", "content_filter"), ("e", 1, "", stop), ("f", 1, "```markdown\nx\n```", stop)]
    got = {r.key: (r.text, r.outcome, r.attempts) for r in runs.resolve_replies(spark.createDataFrame(rows, "key string, attempt int, text string, finish_reason string")).collect()}
    assert got == {"a": ("real", "ok", 2), "b": ("whole", "ok", 2), "c": ("partial" + runs.CUT_OFF, "truncated", 2), "d": (None, "refused", 1), "e": (None, "failed", 1), "f": ("x", "ok", 1)}


def test_replies_with_errors(spark):
    cut, big = "length", "Error 400: context window too large"
    rows = [("a", 1, "part", cut, None), ("a", 2, None, None, big), ("b", 1, None, None, big), ("b", 2, "whole", "stop", None), ("c", 1, "part", cut, None), ("c", 2, None, None, "reset"), ("c", 3, "whole", "stop", None), ("d", 1, "x", "stop", "reset")]
    got = {r.key: (r.text, r.outcome, r.attempts) for r in runs.resolve_replies(spark.createDataFrame(rows, "key string, attempt int, text string, finish_reason string, error string")).collect()}
    assert got == {"a": ("part" + runs.CUT_OFF, "truncated", 2), "b": ("whole", "ok", 2), "c": ("whole", "ok", 3), "d": (None, "failed", 1)}


def test_schedule(spark):
    import random

    r = random.Random(5)
    rows = [(k, a, r.choice([None, None, 3.0, 45.0])) for k in range(300) for a in range(1, r.randint(1, 5) + 1)]
    df = spark.createDataFrame(rows, "key int, attempt int, retry_after double")
    got = schedule.attempts_due(df, "key", 90.0, 6).collect()
    due = {(x.key, x.attempt): x.due for x in got}
    assert len(due) == len(rows)
    for k, a, wait in rows:
        if a > 1:
            assert due[k, a] >= due[k, a - 1] + (wait or 4.0 * 2 ** (a - 2)) - 1e-6
    times = sorted(due.values())
    assert max(sum(t <= u < t + 60 - 1e-6 for u in times) for t in times) <= 90  # each minute holds the rate at most
    assert schedule.attempts_due(df.filter("attempt <> 2"), "key", 90.0, 6).filter("attempt > 1").count() == 0


def test_describe_tries_again(spark):
    def client(image, prompt, seen=[]):  # noqa: B006
        seen.append(image)
        if image == "never" or seen.count(image) < 2:
            error = RuntimeError("busy")
            error.retry_after = 0.05
            raise error
        return f"{image} after {seen.count(image)}"

    df = spark.createDataFrame([("k", "once", "p"), ("l", "never", "p")], "key string, image string, prompt string")
    for rate in (0.0, 6000.0):
        got = {x.key: x.reply for x in replies.describe(df, client, rate, lanes=2, attempts=3).collect()}
        assert got == {"k": "once after 2", "l": "*[vision call failed: RuntimeError: busy]*"}


def test_upper_median(spark):
    import random

    r = random.Random(3)
    rows = [(k, float(r.choice([v, v, 7])) if k else 7.0) for k, n in enumerate([5000, 1, 2, 3001, 40]) for v in range(n)] + [(9, None)]
    got = {x.k: x.median for x in layout.upper_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 100).collect()}
    by = {k: sorted(v for q, v in rows if q == k and v is not None) for k in {q for q, _ in rows}}
    assert got == {k: v[len(v) // 2] for k, v in by.items() if v}


def test_rows_of_a_crowded_page(spark):
    """50,000 heights that drift: no step costs the square of a page."""
    import time

    df = spark.range(50_000).select(F.lit(1).alias("page"), (F.col("id") * 2.0).alias("y"))
    start = time.time()
    rows = layout.row_groups(df, ["page"]).groupBy("row_y").count().collect()
    assert time.time() - start < 60 and {r["count"] for r in rows} == {2} and len(rows) == 25_000


@pytest.mark.parametrize("tex,fault", [
    (r"\frac{a}{b} + \sqrt[3]{x}", None), (r"\begin{a}\begin{b}\end{a}\end{b}", ("environment", 18)), (r"\frac{a}", ("argument", 0)), ("{x", ("group", 0)), ("x}", ("group", 1)),
    (r"\left( x", ("left", 0)), (r"\left\{ {x} \right.", None), (r"x^\frac12", None), (r"x^", ("argument", 1)), (r"\text{a & b}", None), (r"\hat & b", ("argument", 0)), (r"\{ x \}", None), (r"{ \right)", ("left", 2)), ("", None), ("\\", None),
])
def test_structure_of_formulas(tex, fault):
    assert formulas.first_fault(tex) == fault


def test_formulas_are_told_on_each_page(spark):
    df = spark.createDataFrame([(1, "$$x^$$ and $a$ and $$x^$$"), (2, "$x^$"), (3, None)], "page int, md string")
    faults = formulas.formula_faults(df, ["page"])
    assert sorted((r.page, r.place, r.is_display, r.kind) for r in faults.collect()) == [(1, 0, True, "argument"), (1, 1, True, "argument"), (2, 0, False, "argument")]
    assert {r.page: len(r.notes) for r in formulas.render_notes(faults, ["page"]).collect()} == {1: 2, 2: 1}
    long = "{" * 200_000
    assert formulas.first_fault(long) == ("group", 199_999)


def test_answers(spark):
    df = spark.createDataFrame([("*[vision call failed: x]*", "notes", "ocr"), ("RECITATION", None, "ocr"), ("text", "n", "o")], "a string, b string, c string")
    assert [r.t for r in df.select(replies.fallback(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == ["notes", "ocr", "text"]
    pages = spark.createDataFrame([("", 1, "*[vision call failed: x]*", None, None, None), (" ", 2, "A note.", '{"wrong": ["' + "w " * 300 + '$5 a"]}', "Better.", '{"wrong": ["' + "long words " * 60 + '"], "missing": ["costs $5 each"]}')], "page_text string, page_no int, notes string, check string, revised string, recheck string")
    failed, noted = [r.study for r in replies.study_notes(pages).collect()]
    assert failed is None and "no text layer" in noted and "..." in noted and r"costs \$5 each" in noted


def test_plain_words(spark):
    md = "cost $5, later\n\n[^1]: 1\n\n$$ a"
    checked = C.check_pages(spark.createDataFrame([("word " * 30, md)], "native string, md string"))
    notes = replies.page_notes(checked).first().page_notes
    assert "Footnote 1 has no text." in notes and any("dollar amount" in n for n in notes) and "A formula lacks its opening or closing $$." in notes
    stored = spark.createDataFrame([(1, 1), (2, None), (3, replies.WORDING)], "page int, wording int")
    assert sorted(r.page for r in replies.stale_notes(stored, replies.WORDING).collect()) == [1, 2]


def test_stale_files_and_local_names(spark):


    sources = spark.createDataFrame([("a", "2026-01-02"), ("b", "2026-01-02"), ("c", "2026-01-02")], "name string, modificationTime string")
    derived = spark.createDataFrame([("a", "2026-01-03"), ("b", "2026-01-01")], "name string, modificationTime string")
    assert sorted(r.name for r in readers.stale(derived, sources).collect()) == ["b", "c"]
    assert spark.createDataFrame([("org/model:4b",)], "t string").select(T.local_name(F.col("t")).alias("n")).first().n == "local-org-model-4b"


def test_meter(spark):
    u = spark.createDataFrame([("small", 1293, 487, 3354), ("small", None, None, None)], "model string, prompt long, completion long, total long")
    m = runs.meter(u, ["model"]).first()
    assert (m.calls, m.tokens_in, m.tokens_out) == (1, 1293, 2061)


def test_pages(spark):
    s = spark.createDataFrame([(1, None, 3), (2, "2", 9), (3, "1,3-4", 9), (4, "8-99", 9), (5, "5-3", 9)], "key int, spec string, total int")
    got: dict[int, list[int]] = {}
    for r in triage.parse_pages(s).collect():
        got.setdefault(r.key, []).append(r.page)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 3], 2: [2], 3: [1, 3, 4], 4: [8, 9]}


def test_rows_follow_their_first_span(spark):
    ys = [0.0, 2.0, 4.0, 6.0, 6.5]
    df = spark.createDataFrame([(1, y) for y in ys], "page int, y double")
    got = {r.y: r.row_y for r in layout.row_groups(df, ["page"]).collect()}
    assert got == {0.0: 0.0, 2.0: 0.0, 4.0: 4.0, 6.0: 4.0, 6.5: 4.0}


def test_figure_regions(spark):
    rows = [(1, 7, 0.0, 0.0, 100.0, 100.0), (1, 7, 0.0, 300.0, 100.0, 400.0), (1, None, 50.0, 50.0, 150.0, 150.0), (1, None, 200.0, 200.0, 300.0, 300.0), (1, None, 250.0, 250.0, 350.0, 350.0), (1, 9, 0.0, 0.0, 20.0, 20.0)]
    df = spark.createDataFrame(rows, "page int, xref int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.figure, r.xref, r.x0, r.y0) for r in triage.figure_regions(df, ["page"]).orderBy("figure").collect()]
    assert got == [(1, 7, 0.0, 0.0), (2, None, 200.0, 200.0), (3, 7, 0.0, 300.0)]  # the later cluster meets the earlier one


def test_blank_fenced_replies(spark):
    rows = [("a", 1, "```markdown\n\n```", "stop"), ("a", 2, "text", "stop"), ("b", 1, "```\n<!-- page -->\n```", "stop")]
    got = {r.key: (r.text, r.outcome, r.attempts) for r in runs.resolve_replies(spark.createDataFrame(rows, "key string, attempt int, text string, finish_reason string")).collect()}
    assert got == {"a": ("text", "ok", 2), "b": (None, "failed", 1)}


def test_free_names(spark):
    names = ["a", "A", "a (2)", "b", "b", "a", "c (2)", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    got = [r.folder for r in runs.free_names(df, ["k"]).orderBy("k").collect()]
    assert got == ["a", "A (2)", "a (2) (2)", "b", "b (2)", "a (3)", "c (2)", "c"]
    assert len({x.lower() for x in got}) == len(got)


def test_nearest_edge(spark):
    cells = [(1, 61.0), (1, 61.0), (1, 300.0), (1, 90.0), (2, 62.0)]
    df = spark.createDataFrame([(r, x, k) for k, (r, x) in enumerate(cells)], "row int, x1 double, k int")
    got = [(r.col, r.filled) for r in layout.nearest_edge(df, [("a", 60.0), ("c", 300.0)], ["row"], ["k"]).orderBy("k").collect()]
    assert got == [("a", False), ("a", True), ("c", False), (None, False), ("a", False)]


def test_study_notes(spark):
    page = "the quick brown fox jumps over the lazy dog again and again (15A.2) Table D.5"
    rows = [
        (page, 4, "A note on (15A.2).\nthe quick brown fox jumps over the lazy dog", '{"wrong": [], "missing": []}', None, None),
        (page, 4, "RECITATION", "{}", None, None),
        (page, 4, "A note on (15A.2).", '{"wrong": ["x"]}', "Better, $5 each: (15A.2), Table D.5.", "unreadable"),
    ]
    df = spark.createDataFrame(rows, "page_text string, page_no int, notes string, check string, revised string, recheck string")
    out, none, revised = [r.study for r in replies.study_notes(df).collect()]
    assert "quick brown" not in out and "Not covered: Table D.5." in out and "1 line(s)" in out and none is None
    assert "revised once" in revised and r"\$5 each" in revised and "could not be read" in revised and "Not covered" not in revised
    e = replies.evaluate_notes(df.limit(1).select(F.lit(1).alias("page"), "page_text", F.lit("> head\n\nsee (15A.2) at 1.25").alias("study"), F.lit("1.25 and 3.14 <!-- 9.99 -->").alias("key"), "check")).first()
    assert (e.items_kept, e.items, e.decimals_kept, e.decimals, e.copied, e.wrong) == (1, 2, 1, 2, 0, 0)


def test_joins(spark):
    boxes = [(1, 1, 0.0, 10.0, "cut-"), (1, 2, 11.0, 10.0, "off"), (1, 3, 40.0, 10.0, "next"), (1, 4, 51.0, 10.0, "word")]
    df = spark.createDataFrame(boxes, "page int, place int, top double, height double, text string")
    assert layout.join_ocr(df, ["page"]).first().text == "cutoff\n\nnext word"
    lines = [(1, 0.0, 500.0, "one"), (1, 10.0, 575.0, "two"), (1, 20.0, 300.0, "cut-"), (1, 30.0, 300.0, "off"), (1, 40.0, 300.0, "this or"), (1, 50.0, 9.0, "that"), (2, 0.0, 300.0, "99.9"), (2, 10.0, 300.0, "6"), (2, 40.0, 300.0, "a|b")]
    joined = layout.joints(spark.createDataFrame(lines, "cell int, y double, x1 double, text string"), ["cell"], F.lit(578.0), F.col("cell") == 2)
    assert {r.cell: r.text for r in layout.cell_texts(joined, ["cell"]).collect()} == {1: "one<br>two cut-off<br>this or that", 2: "99.96<br><br>a\\|b"}


def test_grid(spark):
    rows = [(1, 100.0, 10.0, 40.0, "Age", True), (1, 101.0, 200.0, 210.0, "12", False), (1, 120.0, 10.0, 30.0, "Sex", False), (1, 5.0, 10.0, 30.0, "header", False)]
    df = spark.createDataFrame(rows, "page int, y double, x0 double, x1 double, text string, bold boolean")
    got = sorted((r.row_y, r.label, r.code) for r in layout.grid(df, layout.GridSpec(50, 700, (("label", 10.0), ("code", 195.0))), ["page"]).collect())
    assert got == [(100.0, "Age", "12"), (120.0, "Sex", "")]


def test_catalog(spark):
    df = spark.createDataFrame([("gemini", "models/gemini-3.6-flash"), ("gemini", "gemini-embedding-1"), ("gemini", "other"), ("kimi", "k2")], "service string, model string")
    assert sorted(r.model for r in catalog.usable_models(df).collect()) == ["gemini-3.6-flash", "k2"]
    log = "## [2.0] now\n- one\n  goes on\n  - inner\n\npara\nwrapped\n## [1.0] old\n- zero\n"
    assert spark.createDataFrame([(log,)], "t string").select(T.release_section(F.col("t"), F.lit("2.0"))).first()[0] == "- one goes on\n  - inner\n\npara wrapped"


def test_describe(spark):
    df = spark.createDataFrame([(str(k), "i", "p") for k in range(3)], "key string, image string, prompt string").coalesce(1)

    def client(image, prompt, **more):
        if "temperature" in more:
            raise replies.RefusedParameter("temperature")
        return f"{prompt}{sorted(more)}"

    got = {r.key: r.reply for r in replies.describe(df, client, 6000, {"temperature": 0, "top": 1}).collect()}
    assert got == {str(k): "p['top']" for k in range(3)}


def test_sources(spark, tmp_path):
    with pytest.raises(readers.UnsupportedFormat):
        readers.read(spark, "x.xyz")
    (tmp_path / "a.pdf").write_bytes(b"%PDF one\ftwo")
    got = readers.read(spark, str(tmp_path / "a.pdf"), extract=lambda b: b.decode().split("\f")).orderBy("page_no").collect()
    assert [(r.page_no, r.native) for r in got] == [(1, "%PDF one"), (2, "two")]
    (tmp_path / "b.pdf").write_bytes(b"no such file")
    assert "Damaged" in readers.read(spark, str(tmp_path / "b.pdf"), extract=lambda b: []).first().error
    (tmp_path / "a.json").write_text('{"id": "1", "unknown": 2}')
    assert readers.read_json(spark, str(tmp_path / "a.json"), "id string, name string").first().asDict() == {"id": "1", "name": None}
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/media/a.png", "x")
        z.writestr("word/document.xml", "x")
    df = spark.createDataFrame([("a.docx", bytearray(b.getvalue())), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    assert [(r.path, r.name, r.width, bytes(r.content)) for r in readers.office_pictures(df).collect()] == [("a.docx", "word/media/a.png", None, b"x")]
    assert [r[0] for r in df.select(readers.picture_count("content")).collect()] == [1, None]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "doc_id long, page_no int, md string")
    sinks.write_documents(pages, str(tmp_path / "d"), F.lit("# t\n"))
    assert sorted(r.document for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["# t\nab\n", "# t\nc\n"]
    sinks.write_pages(pages, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    replies_ = spark.createDataFrame([("k", "t", "stop"), ("l", "t", "length")], "key string, text string, finish_reason string")
    sinks.write_cache(replies_, str(tmp_path / "c"))
    assert [r.key for r in sinks.read_cache(spark, str(tmp_path / "c")).collect()] == ["k"]


def test_stream(spark, tmp_path):
    from quillmill.streaming import progress

    feed = tmp_path / "in"
    feed.mkdir()
    lines = ['{"event":"start","run":1,"todo":4,"at":0}', '{"event":"page_done","run":1,"page":1,"cost":0.5,"at":10}', '{"event":"page_failed","run":1,"page":2,"at":20}']
    (feed / "a.json").write_text("\n".join(lines))
    q = progress.progress(progress.events(spark, str(feed))).writeStream.format("memory").queryName("progress").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from progress").first()
    assert (r.done, r.failed, r.left_over, r.cost, r.per_page, r.eta) == (1, 1, 2, 0.5, 10.0, 20)


def test_sql(spark):
    from quillmill import sql

    sql.register(spark)
    assert spark.sql("select word_list('The off words') w").first().w == ["the", "words"]
    assert spark.sql("select number_list('33,099 (1,2)') n").first().n == ["33099", "1", "2"]
    spark.createDataFrame([(NATIVE, MD)], "native string, md string").createOrReplaceTempView("some_pages")
    sql.check_view(spark, "some_pages", "some_checks")
    assert spark.sql("select status from some_checks").first().status == "ok"
    assert [tuple(r) for r in spark.sql("select * from bag_diff('one two', 'two three') order by token").collect()] == [("one", 1, 0), ("three", 0, 1)]


def test_partial(spark, tmp_path):
    from quillmill.streaming import progress

    pages = tmp_path / "pages"
    pages.mkdir()
    stream = spark.readStream.schema("doc_id long, page_no int, md string").json(str(pages))
    for name, line in (("a", '{"doc_id":1,"page_no":2,"md":"b"}'), ("b", '{"doc_id":1,"page_no":1,"md":"a"}\n{"doc_id":2,"page_no":1,"md":"c"}')):
        (pages / f"{name}.json").write_text(line)
        q = progress.write_partial(stream, str(tmp_path / "out"), F.lit("#"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r.document for r in progress.read_partial(spark, str(tmp_path / "out")).collect()) == ["#ab\n", "#c\n"]
