"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on. Letters and digits are ASCII on purpose.
WORD = "[A-Za-z]+"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
THOUSANDS = r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
LIGATURES = "ffi|ffl|ff|fi|fl"
COMMENT = r"(?s)<!--.*?-->"
#: White space as Unicode has it, spelled out because engines differ on \s.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: SPACE as the SQL of the queries reads it: without the vertical tab, which Java's \s takes in.
SQL_SPACE = SPACE.replace(r"\s", r"\t\n\f\r ")
EQUATION = r"\(([0-9]{1,2}[A-Z]?\.[0-9]{1,3}[a-z]?)\)"
ITEM = r"\b(Example|Table|Figure|Exercise)\s+([A-Z]?[0-9]{0,2}[A-Z]?\.[0-9]{1,3}[a-z]?)\b"
#: A single backslash before two or more letters, behind any pairs of backslashes: a LaTeX command.
LATEX_COMMAND = r"(?<!\\)((?:\\\\)*)\\(?=[A-Za-z]{2,})"
TOKEN = "[A-Za-z0-9][A-Za-z0-9.,'’_%$<>=/+-]*"
RUN = 8
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"{p}{k}" for p in ("com", "lpt") for k in range(1, 10))]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda refers to inside body would else be
    computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(word: Column) -> Column:
    """A word in lower case without ligature pairs."""
    return F.regexp_replace(F.lower(word), LIGATURES, "")


def words(text: Column) -> Column:
    """Lower-case words without ligature pairs, of three letters or more after that. Pairs stand within
    words, so taking them out of the whole text leaves its words apart, and no word is touched alone."""
    small = F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), LIGATURES, "")
    return F.regexp_extract_all(small, F.lit("[a-z]{3,}"), F.lit(0))


def numbers(text: Column) -> Column:
    """Numbers as strings, thousands separators removed; `1,2` is two numbers."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(THOUSANDS), F.array(F.replace(t, F.lit(","), F.lit("")))).otherwise(F.split(t, ","))))


def coverage_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.translate(F.regexp_replace(t, "[.,]+$", ""), "’", "'")), lambda t: t != "")


def solid_chars(text: Column, space: str = SPACE) -> Column:
    """The number of characters that are not white space."""
    return F.length(F.regexp_replace(text, space, ""))


def upto_last(text: Column, end: str) -> Column:
    """text up to its last `end`, and empty without one. A pattern of something that this closes need
    not look at the rest, where each beginning would be followed to the end of the text in vain."""
    return F.left(text, F.length(text) - F.length(F.substring_index(text, end, -1)))


def strip_comments(text: Column, new: str = "") -> Column:
    """text with `new` for each comment."""
    cut = F.concat(F.regexp_replace(upto_last(text, "-->"), COMMENT, new), F.substring_index(text, "-->", -1))
    return F.when(F.contains(text, F.lit("<!--")), cut).otherwise(text)


def comments(text: Column) -> Column:
    return F.regexp_extract_all(upto_last(text, "-->"), F.lit(COMMENT), F.lit(0))


def has_content(text: Column) -> Column:
    return solid_chars(strip_comments(F.coalesce(text, F.lit("")))) > 0


def escape_dollar(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\$", r"\\\$")


def strip_fence(text: Column) -> Column:
    """The text inside a code fence around it, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""), rf"^```(?:markdown)?{SPACE}*", "")
    return F.regexp_replace(F.regexp_replace(t, rf"{SPACE}*```$", ""), rf"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines without the empty one that a final line break would leave."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def quote_block(text: Column, space: str = SPACE) -> Column:
    """Lines behind `> `, those of white space alone as a bare `>`; an empty text has none."""
    return F.array_join(F.transform(lines(text), lambda x: F.when(solid_chars(x, space) > 0, F.concat(F.lit("> "), x)).otherwise(F.lit(">"))), "\n")


def md_link(path: Column) -> Column:
    """Percent-encoding that keeps `/` and the unreserved characters."""
    out = F.url_encode(path)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def numbered_items(text: Column) -> Column:
    """Equation numbers, then example, table, figure and exercise numbers, each once."""
    eq = F.transform(F.regexp_extract_all(text, F.lit(EQUATION), F.lit(1)), lambda n: F.concat(F.lit("("), n, F.lit(")")))
    kind, number = (F.regexp_extract_all(text, F.lit(ITEM), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.concat(eq, F.zip_with(kind, number, lambda k, n: F.concat(k, F.lit(" "), n))))


def missing_items(notes: Column, items: Column) -> Column:
    flat = F.regexp_replace(notes, r"\s+", " ")

    def absent(flat: Column, item: Column) -> Column:
        number = F.element_at(F.split(F.regexp_replace(item, r"[()]", ""), " "), -1)
        found = F.regexp_extract_all(F.concat(F.lit(" "), flat, F.lit(" ")), F.concat(F.lit(r"(?<![0-9.])\Q"), number, F.lit(r"\E(?![0-9])")), F.lit(0))
        return F.size(found) == 0

    return let(flat, lambda f: F.filter(items, lambda item: absent(f, item)))


def grams(text: Column, n: int = RUN) -> Column:
    """The distinct runs of n lower-case ASCII words."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    starts = lambda ws: F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(let(w, lambda ws: F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i, n), " "))))


def shorten(text: Column, limit: int = 240) -> Column:
    t = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    cut = F.substring(t, 1, limit)
    at_word = F.when(cut.contains(" "), F.regexp_replace(cut, "(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(at_word, F.lit("...")))


def as_object(reply: Column) -> Column:
    """What stands between a reply's outermost braces, as JSON text that can be read: first with the
    LaTeX commands in its strings protected, then as it is; null if neither is an object."""
    raw = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    latex = F.regexp_replace(raw, LATEX_COMMAND, "$1\\\\\\\\")
    valid = lambda c: F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)
    return F.coalesce(valid(latex), valid(raw))


def texts_of(reply_object: Column, field: str) -> Column:
    """The texts of a list in such an object; none if it isn't there."""
    listed = F.from_json(reply_object, f"struct<{field}:array<string>>")[field]
    return F.coalesce(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))


def release_section(changelog: Column, version: Column) -> Column:
    """The text under a version's heading, up to the next heading or the list of links; lines that were
    wrapped by hand are one line again."""
    start = F.concat(F.lit(r"(?sm)^## \[\Q"), version, F.lit(r"\E\][^\n]*\n(.*?)(?=^## \[|^\[[^\]]+\]: |\z)"))
    body = F.trim(F.element_at(F.regexp_extract_all(changelog, start, F.lit(1)), 1))
    body = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\n {2,}(?!- )(?=\S)", " ")
    return F.regexp_replace(body, r"(?<=[^\n])\n(?=[^\s#>|-])", " ")


def stamp(at: Column, seconds: bool = False) -> Column:
    """A time as text, to the minute or the second."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss" if seconds else "yyyy-MM-dd HH:mm")


def retry_after(message: Column) -> Column:
    """Seconds to wait that a message asks for, and one more; 0 if it asks for none."""
    one = F.regexp_extract(message, r"""retryDelay['"]?\s*:\s*['"]([0-9]+(?:\.[0-9]+)?)s""", 1)
    two = F.regexp_extract(message, r"retry in ([0-9]+(?:\.[0-9]+)?)s", 1)
    found = F.when(one != "", one).otherwise(two)
    return F.when(found != "", found.cast("double") + 1.0).otherwise(0.0)


def usd(amount: Column) -> Column:
    return F.when(amount < 0.01, F.format_string("$%.4f", F.bround(amount, 4))).otherwise(F.format_string("$%.2f", F.bround(amount, 2)))


def duration(seconds: Column) -> Column:
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    return (
        F.when(seconds < 90, F.concat(whole(seconds), F.lit(" seconds")))
        .when(seconds < 5400, F.concat(whole(seconds / 60), F.lit(" minutes")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(seconds / 3600, 1)), F.lit(" hours")))
    )


def verdict(seconds: Column, gpu_share: Column) -> Column:
    """How fast a page is read, and where: two words for a speed test."""
    feel = F.when(seconds < 20, "quick").when(seconds < 60, "usable").when(seconds < 180, "slow").otherwise("very slow")
    share = F.coalesce(gpu_share, F.lit(0.0))
    where = F.when(share >= 0.9, "card").when(share > 0.1, "partly card").otherwise("processor")
    return F.concat(feel, F.lit(", "), where)


def redact(key: Column) -> Column:
    shown = F.concat(F.substring(key, 1, 6), F.lit("..."), F.right(key, F.lit(4)))
    return F.when(F.coalesce(key, F.lit("")) == "", "(none)").when(F.length(key) > 14, shown).otherwise("(set)")


def safe_name(name: Column) -> Column:
    t = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"))
    for _ in range(1):
        t = F.regexp_replace(F.substring(F.regexp_replace(t, "[. ]+$", ""), 1, 80), "[. ]+$", "")
    taken = F.lower(t).isin(RESERVED_NAMES)
    return F.when(t == "", "document").when(taken, F.concat(F.lit("document_"), t)).otherwise(t)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def stop_reason(reason: Column) -> Column:
    """The common name of a finish reason."""
    known = F.create_map(*(F.lit(x) for p in (("end_turn", "stop"), ("stop_sequence", "stop"), ("max_tokens", "length"), ("refusal", "content_filter")) for x in p))
    return F.coalesce(known[reason], reason)


def cut_off(reason: Column) -> Column:
    r = F.lower(F.coalesce(reason, F.lit("")))
    return r.contains("length") | r.contains("max_tokens")


def refused(body: Column) -> Column:
    return body.contains("RECITATION") | body.contains("content_filter")


def pipe_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def local_name(tag: Column, prefix: str = "local-") -> Column:
    return F.concat(F.lit(prefix), F.translate(tag, ":/", "--"))


def shortlist(items: Column, shown: int = 12) -> Column:
    """The first items, and how many more there are."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.when(F.size(items) > shown, F.concat(head, F.lit(" and "), (F.size(items) - shown).cast("string"), F.lit(" more"))).otherwise(head)


def shrunk(width: Column, height: Column, longest: int = 1568) -> tuple[Column, Column]:
    """Width and height with the long edge at most `longest`, cut to whole numbers, at least 1."""
    edge = F.greatest(width, height)
    side = lambda x: F.when(edge <= longest, x).otherwise(F.greatest(F.lit(1), F.floor(x * (F.lit(float(longest)) / edge)).cast("int")))
    return side(width), side(height)


def padded(x0: Column, y0: Column, x1: Column, y1: Column, pad: float, width: Column, height: Column) -> tuple[Column, ...]:
    zero = F.lit(0.0)
    return F.greatest(zero, x0 - pad), F.greatest(zero, y0 - pad), F.least(width, x1 + pad), F.least(height, y1 + pad)
