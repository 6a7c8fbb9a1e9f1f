"""Structural faults of Markdown and LaTeX, as Column expressions.

Texts come in lines of any length, and a loop over alternatives, (?:a|b)*, costs the JVM a stack frame
for each turn. So loops here are over single characters, or possessive, which takes no frame: what
stands between delimiters is read as runs of plain characters with escapes between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Patterns that results depend on. `.` stops at \n only, hence (?d).
MATH = r"(?sd)(?<!\\)\$\$.*?(?<!\\)\$\$|(?<!\\)\$[^$\\\n]*+(?:\\.[^$\\\n]*+)*+\$"
DISPLAY = r"(?sd)\$\$(.*?)\$\$"
INLINE = r"(?sd)(?<!\\)\$(?!\$)([^$\\]*+(?:\\.[^$\\]*+)*+)(?<!\\)\$"
DELIMITER = r"(?<!\\)\$\$"
NOTE = r"(?md)^\[\^(\w+)\]:[ \t]*(.*)$"
PLACEHOLDER = (
    r"(?i)foot ?notes?\b.{0,40}\b(?:not (?:present|visible|shown|provided|printed|included|available|given)|missing|omitted)"
    r"|\btext (?:is )?(?:not (?:present|visible|shown|provided|printed|included|available)|missing|omitted)|^\[?illegible\b"
)
MARKER = r"(?<=[.,;:?!)\"”’*])\$\^\{?\d{1,3}\}?\$|(?<=[A-Za-z])\$\^\{?\d{2,3}\}?\$"
FUSED = r"(?md)^(?:\[\^\d+\](?!:)|\[<u>\d+</u>\])\S"
TABLE_COMMAND = r"\\(?:multicolumn|multirow|hline|cline)\b"
OUTSIDE = r"\\begin\{(?:align|aligned|equation|eqnarray|gather|gathered|multline|split|array|cases|[pbvBV]?matrix)\*?\}|\\tag\*?\{[^}]*\}"
SPACED_LINK = r"!?\[[^\]\n]*+\]\((?!<)([^)\n]*+\n[^)\n]*+(?=\))|(?=[^)\n]*+\))[^)\n]*?\s[^)\n]*+)\)"
TITLED = r"""^\S+\s+(["']).*\1$|^\S+\s+\(.*\)$"""
OWN_IMAGE = r"!\[Page \d+(?: scan|, figure \d+)\]\([^)\n]*\)"
OWN_LABEL = r"(?md)^\*\*(?:Figure|Picture) [\d.]+ - transcribed by [^*\n]*:\*\*$"
LINK_TARGET = r"\]\([^)\s]*\)"
REVIEW_MARK = r"\*\[[^\]]*\]\*"
AMOUNT = r"(?:(?<=[\s(“—–-])|^)\$(?=\d[\d,]*(?:\.\d+)?(?:s\b|[\s,.;:)\-–]|$))(?![\d,.]*\$)"
TAG = r"\\tag\*?\{([^{}]*)\}"
QUOTE_LINE = r"(?md)^>.*$"
PAGE_HEADING = r"(?md)^## Page \d+\s*$"
NOTE_LABEL = r"\[\^(\w+)\]:?"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bare(md: Column) -> Column:
    """md with a space for each comment."""
    return T.strip_comments(md, " ")


def unmatched_display(md: Column) -> Column:
    return F.size(_all(bare(md), DELIMITER)) % 2 == 1


def displays(md: Column) -> Column:
    """The bodies of display equations; none where delimiters are not paired."""
    return F.when(unmatched_display(md), F.array().cast("array<string>")).otherwise(_all(bare(md), DISPLAY, 1))


def display_faults(md: Column) -> Column:
    """For blank lines, review notes and several tags: whether any display has them."""
    d = displays(md)
    return F.struct(
        F.exists(d, lambda b: b.rlike(r"\n\s*\n")).alias("blank_line"), F.exists(d, lambda b: b.contains("*[")).alias("review_note"), F.exists(d, lambda b: F.size(_all(b, r"\\tag\b")) > 1).alias("tags")
    )


def unbalanced(md: Column) -> Column:
    """The environments that are opened and closed different numbers of times, sorted."""
    times = lambda m, env, word: (F.length(m) - F.length(F.replace(m, F.concat(F.lit(f"\\{word}{{"), env, F.lit("}")), F.lit("")))) / (F.length(env) + len(word) + 3)
    envs = lambda m: F.array_distinct(_all(m, r"\\begin\{(\w+\*?)\}", 1))
    return F.array_sort(T.let(bare(md), lambda m: F.filter(envs(m), lambda e: times(m, e, "begin") != times(m, e, "end"))))


def note_faults(md: Column) -> Column:
    """label and fault (stub, placeholder, repeat) of each faulty footnote."""
    strip = lambda x, chars: F.regexp_replace(x, rf"^[{chars}]+|[{chars}]+$", "")

    def fault(prose: Column, label: Column, raw: Column) -> Column:
        body = F.regexp_replace(raw, rf"^{T.SPACE}++|{T.SPACE}+$", "")
        kind = (
            F.when((body == "") | (strip(body, r"\[\]*. ") == label), "stub")
            .when(strip(body, r"\[\]* ").rlike(PLACEHOLDER), "placeholder")
            .when((F.length(body) > 40) & F.contains(prose, F.regexp_replace(body, r"\.+$", "")), "repeat")
        )
        return F.struct(label.alias("label"), kind.alias("fault"))

    found = T.let(bare(md), lambda m: T.let(F.regexp_replace(m, NOTE, " "), lambda prose: F.zip_with(_all(m, NOTE, 1), _all(m, NOTE, 2), lambda label, raw: fault(prose, label, raw))))
    return F.filter(found, lambda x: x["fault"].isNotNull())


def math_markers(md: Column) -> Column:
    return _all(bare(md), MARKER)


def fused_labels(md: Column) -> Column:
    return _all(bare(md), FUSED)


def without_math(md: Column) -> Column:
    return F.regexp_replace(bare(md), MATH, " ")


def latex_outside(md: Column) -> Column:
    prose = without_math(md)
    return F.struct(prose.rlike(TABLE_COMMAND).alias("table_command"), _all(prose, OUTSIDE).alias("outside"))


def spaced_links(md: Column) -> Column:
    m = bare(md)
    pairs = F.arrays_zip(_all(m, SPACED_LINK, 0).alias("link"), _all(m, SPACED_LINK, 1).alias("target"))
    return F.transform(F.filter(pairs, lambda p: ~F.trim(p["target"]).rlike(TITLED)), lambda p: p["link"])


# What follows a dollar sign on its line, up to the next one that isn't escaped.
_INSIDE = r"[^$\n]*+(?:(?<=\\)\$[^$\n]*+)*+"
_NO_CLOSE = rf"(?!{_INSIDE}(?<!\\)\$)"
_SPACE_FIRST = rf"(?={_INSIDE}(?<= )\$)"
_NO_WORD = r"(?:\\[A-Za-z]++(?:\{[^}$\n]*\})?+|[A-Za-z](?![A-Za-z])|(?<=\\)\$|[^A-Za-z$\n\\]|\\(?![A-Za-z]))*+"
_FOUR_WORDS = rf"(?=(?:{_NO_WORD}[A-Za-z]{{2,}}+){{4}})"
#: A dollar sign that means money: no formula closes on its line, or what it would enclose ends in a
#: space or holds four words, LaTeX commands aside.
_READ_AS_MATH = rf"{AMOUNT}(?:{_NO_CLOSE}|{_SPACE_FIRST}|{_FOUR_WORDS})"
#: The sign is looked for first, so that no other place of a text is tried further.
MONEY = rf"(?md)(?=\$){_READ_AS_MATH}"
MONEY_SEEN = rf"(?md)(?=(\$(?s:.{{0,11}}))){_READ_AS_MATH}"


def _outside_displays(md: Column) -> Column:
    """The pieces of md that lie outside of displays. Each begins with a letter and ends with a dollar
    sign where a display stood, so that patterns see what they would have seen there."""
    def shown(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        return F.transform(pieces, lambda p, k: F.when((k % 2 == 0) | (k == last), F.concat(F.when(k > 0, "x").otherwise(""), p, F.when(k < last, "$").otherwise(""))))

    return F.filter(T.let(F.split(md, DELIMITER), shown), lambda p: p.isNotNull())


def money(md: Column) -> Column:
    """The amounts, with what follows up to twelve characters, that may be read as formulas."""
    return F.flatten(F.transform(_outside_displays(bare(md)), lambda p: _all(p, MONEY_SEEN, 1)))


def escape_money(md: Column) -> Column:
    return F.regexp_replace(md, MONEY, r"\\\$")


def one_tag(md: Column) -> Column:
    """md with the numbers of each display that has several written out at the ends of their lines."""
    def fixed(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        return F.transform(pieces, lambda p, k: F.when((k % 2 == 1) & (k < last) & (F.size(_all(p, TAG)) > 1), F.regexp_replace(p, TAG, r"\\qquad ($1)")).otherwise(p))

    return F.array_join(T.let(F.split(md, DELIMITER), fixed), "$$")


def _fault(name: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("fault"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


_NONE = "array<struct<fault:string,detail:string>>"
_SEGMENTS = "array<struct<kind:string,text:string>>"


def _listed(found: Column, name: str) -> Column:
    return F.transform(found, lambda x: _fault(name, x))


def _if(on: Column, found: Column) -> Column:
    """found where a text holds what it can't be without; patterns don't run on other texts."""
    return F.when(on, found).otherwise(F.array().cast(_NONE))


def math_faults(md: Column) -> Column:
    """(fault, detail) of what keeps formulas from showing."""
    kinds = F.array(*(F.lit(k) for k in ("blank_line", "review_note", "tags")))

    def of(d: Column) -> Column:
        bad = {"blank_line": d.rlike(r"\n\s*\n"), "review_note": F.contains(d, F.lit("*[")), "tags": F.size(_all(d, r"\\tag\b")) > 1}
        return F.filter(kinds, lambda k: F.coalesce(*(F.when((k == name) & on, True) for name, on in bad.items()), F.lit(False)))

    shown = F.transform(F.flatten(F.transform(displays(md), of)), lambda k: F.struct(k.alias("fault"), F.lit(None).cast("string").alias("detail")))
    odd = F.when(unmatched_display(md), F.array(_fault("unmatched"))).otherwise(F.array().cast(_NONE))
    return F.concat(_if(F.contains(md, F.lit("$$")), F.concat(odd, shown)), _if(F.contains(md, F.lit("\\begin")), _listed(unbalanced(md), "environment")))


def markup_faults(md: Column) -> Column:
    """(fault, detail) of notes, markers, amounts, tables and links in the wrong form."""
    commands = F.contains(md, F.lit("\\"))
    dollars = lambda found: _if(F.contains(md, F.lit("$")), found)
    notes = _if(F.contains(md, F.lit("[^")), F.transform(note_faults(md), lambda n: F.struct(n["fault"].alias("fault"), n["label"].alias("detail"))))
    prose = without_math(md)
    table = F.when(commands & prose.rlike(TABLE_COMMAND), F.array(_fault("table_command"))).otherwise(F.array().cast(_NONE))
    return F.concat(notes, dollars(_listed(math_markers(md), "marker")), _listed(fused_labels(md), "fused"), dollars(_listed(money(md), "money")), table, _if(commands, _listed(_all(prose, OUTSIDE), "outside")), _if(F.contains(md, F.lit("](")), _listed(F.transform(spaced_links(md), lambda x: F.left(x, F.lit(60))), "link")))


def formulas(md: Column) -> Column:
    """tex and is_display of every formula: displays, then inline ones by paragraph."""
    m = bare(md)
    shown = F.transform(_all(m, DISPLAY, 1), lambda t: F.struct(t.alias("tex"), F.lit(True).alias("is_display")))
    rest = F.split(F.regexp_replace(m, DISPLAY, " "), r"\n\s*\n")
    inline = F.flatten(F.transform(rest, lambda p: _all(p, INLINE, 1)))
    return F.concat(shown, F.transform(inline, lambda t: F.struct(t.alias("tex"), F.lit(False).alias("is_display"))))


#: What isn't plain text, in a text without comments: code, displays, inline formulas.
PARTS = rf"(?sd)```.*?```|`[^`\n]++`|{MATH.removeprefix('(?sd)')}"


def segments(md: Column) -> Column:
    """md cut into (kind, text), in order and without loss: comment, code (fenced or a span), display,
    inline and text. A comment ends what is open before it; a fence that isn't closed is text."""
    of = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    kind = lambda x: F.when(x.startswith("`"), "code").when(x.startswith("$$") & (F.length(x) > 2), "display").otherwise("inline")

    def between(plain: Column, others: Column, named) -> Column:
        """The pieces of plain, each with the one of others that follows it."""
        return F.flatten(F.transform(F.arrays_zip(plain.alias("a"), others.alias("b")), lambda z: F.concat(z["a"], F.when(z["b"].isNull(), F.array().cast(_SEGMENTS)).otherwise(F.array(named(z["b"]))))))

    def cut(piece: Column) -> Column:
        plain = F.transform(F.split(piece, PARTS), lambda t: F.array(of("text", t)))
        return between(plain, _all(piece, PARTS), lambda x: F.struct(kind(x).alias("kind"), x.alias("text")))

    head, tail = T.upto_last(md, "-->"), F.substring_index(md, "-->", -1)
    # the last piece goes on after the last end of a comment
    pieces = T.let(F.split(head, T.COMMENT), lambda ps: F.concat(F.slice(ps, 1, F.size(ps) - 1), F.array(F.concat(F.get(ps, F.size(ps) - 1), tail))))
    found = between(F.transform(pieces, cut), T.comments(md), lambda x: of("comment", x))
    return F.filter(found, lambda x: x["text"] != "")


def split_md(md: Column) -> Column:
    """prose, and the other text (math and quoted descriptions) that may account for words."""
    m = bare(md)
    prose = F.regexp_replace(m, MATH, " ")
    for pattern, new in ((OWN_IMAGE, " "), (OWN_LABEL, " "), (LINK_TARGET, "] "), (REVIEW_MARK, " ")):
        prose = F.regexp_replace(prose, pattern, new)
    other = F.concat_ws(" ", F.array_join(_all(m, MATH), " "), F.array_join(_all(prose, QUOTE_LINE), " "))
    for pattern in (QUOTE_LINE, PAGE_HEADING, NOTE_LABEL):
        prose = F.regexp_replace(prose, pattern, " ")
    return F.struct(prose.alias("prose"), other.alias("other"))


def table_text(prose: Column) -> Column:
    return F.array_join(F.filter(F.split(prose, "\n"), lambda x: F.ltrim(x).startswith("|")), " ")
