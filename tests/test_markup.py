"""Markup on lines of a megabyte, cutting into segments, and names of columns."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import lint as L
from quillmill.functions import page_check as P

N = 1 << 20
LONG = {
    "open": "price $5 " + "a b " * (N // 4),
    "closed": "price $5 " + "a b " * (N // 4) + "$",
    "escapes": "$" + "\\a" * (N // 2) + "$",
    "escaped and open": "$ " + "\\$" * (N // 2),
    "display": "$$ " + "a b\n" * (N // 4) + "$$",
    "open comments": "<!-- " * (N // 5),
    "amounts": "$5 " * (N // 3),
    "link": "[a](b " + "x " * (N // 2),
    "ticks": "`" * N,
    "digits": "$5 " + "1 2 " * (N // 4) + "$",
}
FUNCTIONS = {
    "split_md": lambda m: F.length(L.split_md(m)["prose"]),
    "formulas": lambda m: F.size(L.formulas(m)),
    "math_faults": lambda m: F.size(L.math_faults(m)),
    "markup_faults": lambda m: F.size(L.markup_faults(m)),
    "latex_outside": lambda m: F.size(L.latex_outside(m)["outside"]),
    "segments": lambda m: F.size(L.segments(m)),
    "escape_money": lambda m: F.length(L.escape_money(m)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_long_lines(spark, name):
    rows = spark.createDataFrame(list(LONG.items()), "k string, md string").repartition(4)
    got = {r.k: r.n for r in rows.select("k", FUNCTIONS[name](F.col("md")).alias("n")).collect()}
    assert len(got) == len(LONG)
    if name == "formulas":
        assert (got["open"], got["closed"], got["escapes"], got["escaped and open"], got["display"]) == (0, 1, 1, 0, 1)


def test_time_is_linear(spark):
    def took(n):
        text = ("price $5 " + "a b " * (n // 4)) + "<!-- " * (n // 50)
        rows = spark.createDataFrame([(text,)], "md string")
        f = [FUNCTIONS[k](F.col("md")).alias(k) for k in FUNCTIONS]
        t = time.time()
        rows.select(*f).collect()
        return time.time() - t

    took(N // 8)
    assert took(2 * N) < 12 * took(N // 4) + 2  # eight times the text


def test_long_page_is_checked(spark):
    words = " ".join(f"alpha{'abcdefghij'[k % 10]}beta" for k in range(60_000))
    rows = spark.createDataFrame([("same", words, f"Price $5 {words}"), ("other", words, f"Price $5 {words[:-20]} zusatzwort anderes")], "k string, native string, md string")
    got = {r.k: r for r in P.check_pages(rows).select("k", "status", "extra").collect()}
    assert got["same"].extra == {"price": 1} and got["other"].status == "flagged"


def test_segments(spark):
    md = "a $x$ <!-- $n$ --> $$\nd $$ `c $y$` ```\n$5\n``` \\$7 $$ open <!-- rest"
    found = [(r.kind, r.text) for r in spark.createDataFrame([(md,)], "md string").select(L.segments(F.col("md")).alias("s")).first().s]
    assert found == [
        ("text", "a "), ("inline", "$x$"), ("text", " "), ("comment", "<!-- $n$ -->"), ("text", " "), ("display", "$$\nd $$"), ("text", " "),
        ("code", "`c $y$`"), ("text", " "), ("code", "```\n$5\n```"), ("text", " \\$7 "), ("inline", "$$"), ("text", " open <!-- rest"),
    ]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["$", "$$", "\\", "`", "```", "<!--", "-->", "\n", "a ", "5"]), max_size=14).map("".join), min_size=1, max_size=40))
def test_segments_lose_nothing(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "md string").select("md", F.array_join(F.transform(L.segments(F.col("md")), lambda x: x["text"]), "").alias("again"))
    assert all(r.md == r.again for r in rows.collect())


def test_notes_of_white_space_are_stubs(spark):
    rows = spark.createDataFrame([("[^1]: \r\n",), ("[^2]: \t\r\nx",), ("[^3]: ",), ("[^4]: words\r\n",)], "md string")
    assert [[n.fault for n in r.f] for r in rows.select(L.note_faults(F.col("md")).alias("f")).collect()] == [["stub"], ["stub"], ["stub"], []]


def test_names_of_columns(spark):
    rows = spark.createDataFrame([("n" * 3, "m", "own", "own", "own")], "native string, md string, status string, _in string, _native string")
    checked = P.check_pages(rows)
    assert sorted(checked.columns) == sorted({*checked.columns})
    got = checked.first()
    assert (got.status, got._in, got._native) == ("no-text-layer", "own", "own")
