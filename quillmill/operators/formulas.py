"""The structure of formulas: groups, delimiters, environments and arguments, by a stack over tokens.

A formula is read once from left to right. What opens (a brace, \\left, \\begin, a command that waits for
an argument) goes on a stack, and what closes must meet its like on top. A command's argument is the next
symbol, command or whole group; a command that has all of its arguments is itself a symbol for what waits
below it. The first fault of a formula is told with its kind and place; each distinct formula is read once
in the whole table, however many pages hold it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import lint as L

#: How many arguments commands take.
ARGUMENTS = {
    "frac": 2, "dfrac": 2, "tfrac": 2, "binom": 2, "overset": 2, "underset": 2, "stackrel": 2,
    "sqrt": 1, "text": 1, "mathrm": 1, "mathbf": 1, "mathbb": 1, "mathcal": 1, "mathit": 1, "operatorname": 1, "boxed": 1, "tag": 1,
    "hat": 1, "bar": 1, "vec": 1, "tilde": 1, "dot": 1, "ddot": 1, "overline": 1, "underline": 1, "widehat": 1, "widetilde": 1, "overbrace": 1, "underbrace": 1,
}
_TOKEN = re.compile(
    r"""\\(?P<part>begin|end)\s*\{(?P<env>[A-Za-z]+\*?)\}|\\(?P<side>left|right)(?![A-Za-z])\s*(?:\\[A-Za-z]+|\\.|[^\s\\])
    |\\sqrt(?![A-Za-z])\s*\[[^\[\]{}\\]*\]|\\(?P<name>[A-Za-z]+)|\\(?P<one>.)|(?P<sign>[{}&^_])|(?P<plain>[^\s\\])""",
    re.X | re.S,
)
GROUP, SIDE, ENVIRONMENT, ARGUMENT = "group", "left", "environment", "argument"


def first_fault(tex: str) -> tuple[str, int] | None:
    """(kind, place) of the first thing that closes what isn't open or lacks an argument; at the end,
    of the innermost thing that is still open."""
    open_: list[tuple[str, int, str | None, bool]] = []  # kind, place, environment, whether an argument is the last

    def symbol() -> None:
        while open_ and open_[-1][0] == ARGUMENT:
            if not open_.pop()[3]:
                return

    def wait(place: int, n: int) -> None:
        open_.extend((ARGUMENT, place, None, k == 0) for k in range(n))

    for m in _TOKEN.finditer(tex):
        at, kind = m.start(), None
        closing = m["part"] == "end" or m["side"] == "right" or m["sign"] in ("}", "&") or m["one"] == "\\"
        if closing and open_ and open_[-1][0] == ARGUMENT:
            return ARGUMENT, open_[-1][1]
        if m["sign"] == "{":
            open_.append((GROUP, at, None, False))
        elif m["side"] == "left":
            open_.append((SIDE, at, None, False))
        elif m["part"] == "begin":
            open_.append((ENVIRONMENT, at, m["env"], False))
        elif m["sign"] == "}" or m["side"] == "right" or m["part"] == "end":
            kind = GROUP if m["sign"] else SIDE if m["side"] else ENVIRONMENT
            if not open_ or open_[-1][0] != kind or open_[-1][2] != m["env"]:
                return kind, at
            open_.pop()
            symbol()
        elif m["sign"] in ("^", "_"):
            wait(at, 1)
        elif m["name"] in ARGUMENTS:
            wait(at, ARGUMENTS[m["name"]])
        elif m[0].startswith("\\sqrt") and m["name"] is None:
            wait(at, 1)
        elif not closing:  # a symbol
            symbol()
    return (open_[-1][0], open_[-1][1]) if open_ else None


_FAULT = ST.StructType([ST.StructField("kind", ST.StringType()), ST.StructField("at", ST.IntegerType())])


@F.arrow_udf(_FAULT)
def structure_fault(tex: pa.Array) -> pa.Array:
    """kind and place (characters from 0) of a formula's first fault; null without one."""
    found = [t if t is None else first_fault(t) for t in tex.to_pylist()]
    return pa.array([f and {"kind": f[0], "at": f[1]} for f in found], pa.struct([("kind", pa.string()), ("at", pa.int32())]))


def formula_faults(pages: DataFrame, keys: list[str], md: str = "md") -> DataFrame:
    """keys, place (the formula's number on its page), tex, is_display, kind and at of every formula with
    a fault. Formulas are told apart by their whole text and read once each; the faulty ones, of whose
    size the planner knows, are joined back."""
    all_ = pages.select(*keys, F.posexplode(L.formulas(F.coalesce(md, F.lit("")))).alias("place", "f")).select(*keys, "place", "f.tex", "f.is_display")
    faulty = all_.select("tex").distinct().withColumn("_fault", structure_fault("tex")).filter(F.col("_fault").isNotNull())
    return all_.join(faulty, "tex").select(*keys, "place", "tex", "is_display", F.col("_fault.kind").alias("kind"), F.col("_fault.at").alias("at"))


def render_notes(faults: DataFrame, keys: list[str], shown: int = 70) -> DataFrame:
    """keys and notes: a sentence for each faulty formula of a page, in their order."""
    one_line = F.trim(F.regexp_replace("tex", r"\s+", " "))
    short = F.when(F.length(one_line) > shown, F.concat(F.left(one_line, F.lit(shown)), F.lit(" ..."))).otherwise(one_line)
    words = F.create_map(*(F.lit(x) for p in {GROUP: "a brace has no partner", SIDE: "\\left and \\right don't match", ENVIRONMENT: "an environment is not closed where it should be", ARGUMENT: "a command lacks an argument"}.items() for x in p))
    note = F.concat(F.lit("Formula: "), words[F.col("kind")], F.lit(" at "), F.col("at").cast("string"), F.lit(" in `"), short, F.lit("`"))
    return faults.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", note.alias("n")))), lambda x: x["n"]).alias("notes"))
