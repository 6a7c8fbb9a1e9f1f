"""Secret scans: base patterns, and assignment-aware lexing.

The lexer goes through source and configuration text once and reads bindings of a name to an
expression: `name = ...`, `name: type = ...`, `a = b = ...`, `name: ...`, `"name": ...`, `name => ...`,
`name := ...`. An expression is made of quoted literals (with escapes, prefixes, three quotes or
backticks, over several lines within brackets), bare words and names, put together by `+`, `..` or
by standing side by side; comments between its parts are passed over. Braces open scopes: a name is
bound within them only, and the keys around a binding lend it some of their weight. Bindings inside
comments are read too, but their names hold in the comment alone.

Names make a graph. A name stands for what it was bound to last before, in this scope or around it,
or else for its first binding further on, so a literal that reaches a sensitive target through other
names, in any order, is found where it is written. A literal is scored by its target's name (how
sensitive) and by its own form (length, mixture of letters and digits, spread of characters;
placeholders score nothing).

Offsets are code points, ends exclusive. The scan is linear in the text, and nothing is cut off.
Defined cases: null is the empty text, without spans; repeated rows keep their rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, texts_of

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs of 18 and more; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "flow")

#: What the scan stops at: braces, comments and their ends, and names before a sign of binding. A name
#: begins where no name character stands before, so no run of them is tried twice.
_STOP = re.compile(
    r"""(?P<brace>[{}])|(?P<open>/\*|<!--)|(?P<close>\*/|-->)|(?P<line>(?<![:\w])//|(?<![\w&])\#)|(?P<end>\n)
    |(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)["'\])]{0,2}+[ \t]*+(?P<sign>:=|=>|=(?![=~])|:(?!:))""",
    re.X | re.A,
)
_TYPED = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\]|?<>]*+[ \t]*+=(?![=>~])", re.A)
#: White space between an expression's parts, on one line and over lines.
_BLANK, _BLANKS = re.compile(r"(?:[ \t]++|\\\n)*+"), re.compile(r"(?:\s++|\\\n)*+")
_QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:(?P<three>\"\"\"|\'\'\')(?P<long>(?s:.*?))(?P=three)|"(?P<double>(?:[^"\\\n]++|\\.)*+)"|'(?P<single>(?:[^'\\\n]++|\\.)*+)'|`(?P<back>[^`]*+)`)""", re.S)
_BARE = re.compile(r"[A-Za-z0-9_$+/.-]++={0,2}+")
_CHAINED = re.compile(r"([A-Za-z_$][\w$.-]*+)[ \t]*+=(?![=>~])(?=[ \t]*+[\"'`\w$(\[{])", re.A)
_JOIN = re.compile(r"\+(?!=)|\.\.")
#: Parts of names, and how sensitive a target with that part is.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "apikey": 3, "token": 3, "credential": 3, "credentials": 3, "private": 2, "auth": 2, "key": 1, "access": 1, "signing": 1, "bearer": 2}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|none|null|true|false|your.*|<.*|test|todo|redacted)$")
MIN_SCORE = 5.0
#: Longer than any placeholder of fixed length.
HEAD = 32


def name_score(name: str) -> int:
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower())
    return sum(SENSITIVE.get(p, 0) for p in {*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))})


class Constant:
    """An expression's value: literals (value, start, end) and other constants, in order. What
    scoring needs of the value is put together from the parts, so a constant that others refer to,
    however often and deep, is never written out."""

    __slots__ = ("parts", "known", "size", "head", "counts")

    def __init__(self, parts: list):
        self.parts, self.known = parts, False

    def measure(self) -> None:
        """size, head (the first HEAD characters) and counts of characters, in order of appearance. A
        name that leads back to itself adds nothing there."""
        todo, on_way = [self], set()
        while todo:
            c = todo[-1]
            if c.known:
                todo.pop()
                continue
            if id(c) not in on_way:
                on_way.add(id(c))
                below = [p for p in c.parts if isinstance(p, Constant) and not p.known and id(p) not in on_way]
                if below:
                    todo += below
                    continue
            todo.pop()
            c.size, c.head, c.counts, c.known = 0, "", {}, True
            for p in c.parts:
                if isinstance(p, Constant):
                    if not p.known:
                        continue
                    value, n, counts = p.head, p.size, p.counts
                else:
                    value, n, counts = p[0], len(p[0]), Counter(p[0])
                c.size += n
                if len(c.head) < HEAD:
                    c.head += value[: HEAD - len(c.head)]
                for x, k in counts.items():
                    c.counts[x] = c.counts.get(x, 0) + k


def literal_score(value: Constant) -> float:
    value.measure()
    n, counts = value.size, value.counts
    # beyond the head a placeholder can only go on with characters that are checked as a set
    if n < 8 or PLACEHOLDER.match(value.head if n <= HEAD else value.head + "".join(counts)):
        return -math.inf
    spread = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    digits = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    return min(2.0, min(n, 24) / 12) + (1.0 if digits else 0.0) + (1.0 if spread >= 3 else 0.0) - (2.0 if " " in counts else 0.0)


class Places:
    """Where a string stands in a text, looked up once: the search for the next place from any point
    takes no longer for a place that is far away or missing."""

    def __init__(self, text: str, what: str):
        self.text, self.what, self.found = text, what, None

    def after(self, at: int) -> int:
        """The first place at or after a point, or -1."""
        if self.found is None:
            self.found = [m.start() for m in re.finditer(re.escape(self.what), self.text)]
        k = bisect.bisect_left(self.found, at)
        return self.found[k] if k < len(self.found) else -1


class Lexer:
    """One pass over a text; bound: the bindings so far, (weight of the target, its value). What is
    bound in a comment ends with the comment at the latest, and a comment holds no other comment."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Constant] = {}  # what each name stands for here
        self.first: dict[str, Constant] = {}  # the first binding of a name outside of comments
        self.later: list[tuple[list, int, str]] = []  # parts that were a name without a binding
        #: Of each scope: what to put back at its end, and the weight of the key that it belongs to.
        self.scopes: list[tuple[list[tuple[str, Constant | None]], int]] = [([], 0)]
        self.bound: list[tuple[int, Constant]] = []
        self.chained: dict[int, Constant] = {}  # by the place of a name, what it is about to be bound to
        self.end, self.in_comment = len(text), False  # of the comment that the scan is in, or the text's
        self.closes, self.breaks = Places(text, "*/"), Places(text, "\n")

    def _enter(self, weight: int) -> None:
        self.scopes.append(([], weight))

    def _leave(self) -> None:
        if len(self.scopes) > 1:
            for name, before in reversed(self.scopes.pop()[0]):
                if before is None:
                    self.known.pop(name, None)
                else:
                    self.known[name] = before

    def scan(self) -> list[tuple[int, Constant]]:
        text, key_weight, comment = self.text, 0, ""
        for m in _STOP.finditer(text):
            kind = m.lastgroup
            if kind == "sign":
                weight = max(name_score(m["name"]), self.scopes[-1][1] - 1)
                at = m.end()
                if m["sign"] == ":" and (typed := _TYPED.match(text, at)):
                    at = typed.end()
                value, opens = self._expression(at)
                if (before := self.chained.pop(m.start("name"), None)) is not None:
                    before.parts.append(value)
                if value.parts:
                    self._bind(m["name"], value, weight, bool(comment))
                key_weight = weight if opens else 0
            elif kind == "brace":
                if m[0] == "{":
                    self._enter(max(key_weight, self.scopes[-1][1] - 1))
                    key_weight = 0
                else:
                    self._leave()
            elif kind in ("open", "line"):
                if not comment:
                    comment = "\n" if kind == "line" else "*/" if m[0] == "/*" else "-->"
                    close = text.find(comment, m.end())
                    self.end, self.in_comment = len(text) if close < 0 else close, True
                    self._enter(0)
            elif comment and m[0] == comment:
                comment = ""
                self.end, self.in_comment = len(text), False
                self._leave()
        for parts, k, name in self.later:
            if name in self.first:
                parts[k] = self.first[name]
        return self.bound

    def _bind(self, name: str, value: Constant, weight: int, in_comment: bool) -> None:
        self.scopes[-1][0].append((name, self.known.get(name)))
        self.known[name] = value
        if not in_comment:
            self.first.setdefault(name, value)
        if weight:
            self.bound.append((weight, value))

    def _skipped(self, at: int, lines: bool) -> int:
        """The place after white space and comments; lines: also line breaks and comments up to them."""
        text, blank = self.text, _BLANKS if lines else _BLANK
        while True:
            at = blank.match(text, at, self.end).end()
            if self.in_comment:
                return at
            if text.startswith("/*", at) and (close := self.closes.after(at + 2)) >= 0:
                at = close + 2
            elif lines and (text.startswith("//", at) or text.startswith("#", at)):
                line = self.breaks.after(at)
                at = len(text) if line < 0 else line
            else:
                return at

    def _expression(self, at: int) -> tuple[Constant, bool]:
        """The value of the expression that begins at a place, and whether that is an opening brace."""
        text, end, parts, depth, joined = self.text, self.end, [], 0, True
        at = self._skipped(at, False)
        if text.startswith("{", at):
            return Constant(parts), True
        while at < end:
            c = text[at]
            if c in "([" and joined:
                depth += 1
                at += 1
            elif c in ")]" and depth:
                depth -= 1
                at += 1
            elif c == "," and depth:
                at, joined = at + 1, True
            elif (join := _JOIN.match(text, at, end)) and not joined:
                at, joined = join.end(), True
            elif quoted := _QUOTED.match(text, at, end):  # side by side is joined too
                inside = "long" if quoted["three"] else quoted.lastgroup
                parts.append((quoted[inside], *quoted.span(inside)))
                at, joined = quoted.end(), False
            elif joined and (bare := _BARE.match(text, at, end)):
                if chained := _CHAINED.match(text, at, end):  # a = b = ...: what b is about to be bound to
                    parts.append(self.chained.setdefault(chained.start(), Constant([])))
                    break
                at, joined = bare.end(), False
                if text.startswith("(", at):
                    break  # a call: what it is given is not what is bound
                self._add(parts, bare)
            else:
                break
            at = self._skipped(at, depth > 0)
        return Constant(parts), False

    def _add(self, parts: list, bare: re.Match) -> None:
        raw, start = bare[0], bare.start()
        if raw.strip("+") == "" or raw == "..":
            return
        names = raw.split("+") if "+" in raw else [raw]
        if all(n in self.known for n in names):
            parts += [self.known[n] for n in names]
            return
        if raw[0].isalpha() or raw[0] in "_$":
            self.later.append((parts, len(parts), raw))
        parts.append((raw, start, bare.end()))


def lexed(text: str) -> list[tuple[int, int]]:
    """The spans of literals whose target is sensitive enough."""
    told = [value for weight, value in Lexer(text).scan() if weight + literal_score(value) >= MIN_SCORE]
    found, seen = set(), set()
    while told:
        if id(value := told.pop()) in seen:
            continue
        seen.add(id(value))
        for p in value.parts:
            if isinstance(p, Constant):
                told.append(p)
            elif p[2] > p[1]:
                found.add(p[1:])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in the list, end) of the base matches, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with what the lexer adds: a span within a base one adds nothing."""
    base = base_spans(text)
    more = []
    if ":" in text or "=" in text:
        starts = [a for a, _, _ in base]
        reach = list(itertools.accumulate((b for *_, b in base), max))  # the furthest end so far
        inside = lambda s, e: (k := bisect.bisect_right(starts, s)) and reach[k - 1] >= e
        more = [(s, 3, e) for s, e in lexed(text) if not inside(s, e)]
    return base, sorted(base + more)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the digest of the base spans, and all spans."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base, every = spans(t)
                n = [sum(1 for _, k, _ in base if k == kind) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts_of(docs).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
