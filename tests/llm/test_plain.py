"""The template tree and the pipeline's line_dedup against a plain version on random tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quillmill.llm import decontamination, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tree(rows):
    """(id, lines, dropped, text left) of each (id, text), by dictionaries."""
    order = lambda i: (i is not None, i or 0)
    lines = []  # row, place, leaf, tokens
    for row, (_, text) in enumerate(rows):
        for place, line in enumerate((text or "").split("\n")):
            tokens = WORD.findall(line)
            if not tokens:
                continue
            if len(tokens) > templates.DEPTH:
                tokens = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
            lines.append((row, place, (len(tokens), *tokens[: templates.DEPTH]), tokens))
    holders = defaultdict(set)
    for row, _, leaf, _ in lines:
        holders[leaf].add(row)
    recurring = [x for x in lines if len(holders[x[2]]) >= templates.MIN_DOCS]
    seen = defaultdict(set)
    for row, _, leaf, tokens in recurring:
        for k, t in enumerate(tokens):
            seen[leaf, k, t].add(row)
    named, of = defaultdict(set), {}
    for row, place, leaf, tokens in recurring:
        short = len(tokens) <= templates.DEPTH
        fixed = [len(seen[leaf, k, t]) >= templates.MIN_DOCS and t != "<*>" for k, t in enumerate(tokens)]
        fit = sum(f or t == "<*>" for f, t in list(zip(fixed, tokens, strict=True))[templates.DEPTH :])
        if 100 * sum(fixed) >= (100 if short else templates.CONSTANT_PERCENT) * len(tokens) and 100 * fit >= templates.FIT_PERCENT * (len(tokens) - templates.DEPTH):
            of[row, place] = name = (leaf, *((k, t) for k, (t, f) in enumerate(zip(tokens, fixed, strict=True)) if f))
            named[name].add(row)
    for row, (i, text) in enumerate(rows):
        kept, parts = [], (text or "").split("\n")
        for place, line in enumerate(parts):
            name = of.get((row, place))
            if name is None or len(named[name]) < templates.MIN_DOCS or i == min((rows[r][0] for r in named[name]), key=order):
                kept.append(line)
        yield i, len(parts), len(parts) - len(kept), "\n".join(kept)


def table(seed):
    r = random.Random(seed)
    words = [f"w{c}" for c in "abcdefgh"]
    fixed = ["All rights reserved.", "Les.", "Printed by the office on behalf of all", "a b c d", "1 2"]
    out = []
    for k in range(90):
        lines = []
        for _ in range(r.randint(0, 7)):
            kind = r.random()
            if kind < 0.3:
                lines.append(r.choice(fixed))
            elif kind < 0.5:
                lines.append(f"Page {r.randint(1, 99)} of {r.choice(['99', '100'])} printed {r.choice(['here', 'there', 'on day 7'])} by the office")
            elif kind < 0.7:
                lines.append(" ".join(r.choice(words) for _ in range(r.randint(1, 6))))
            elif kind < 0.85:
                lines.append(" ".join(["The", "of", "and", *(f"x{r.randint(0, 9**6)}y" if r.random() < 0.5 else r.choice(words) for _ in range(3))]))
            else:
                lines.append(r.choice(["", "  ", "\t", " Les. "]))
        text = "\n".join(lines)
        out.append((r.choice([k, k, k, 5, None]), r.choice([text] * 9 + [None])))
    return out + out[:3]


@pytest.mark.parametrize("seed", range(3))
def test_tree(spark, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = list(plain_tree(rows))
    got = templates.drop_templates(df)
    found = [tuple(x) for x in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(map(repr, found)) == sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, n, d, t in want)
    assert sum(d for _, _, d, _ in want) > 30
    left = Counter((x.doc_id, x.text or "") for x in templates.without_templates(df).collect())
    assert left == Counter((i, t) for i, _, d, t in want if not d or WORD.search(t))


def test_texts_beyond_a_slice(spark):
    """Texts of over a slice's bytes, and of over a tokenizer's chunk, give what short ones give."""
    from quillmill.llm import blocks, host_rules, minhash, recompression, suffix, tokens

    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(r.choice(words) for _ in range(150_000))
    assert len(long) > blocks.SLICE_BYTES
    rows = [(1, long[:40_000]), (2, long), (3, long[1000:]), (4, "plain words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sp, _ = tokens.tokenizer(tokens.MODEL)
    assert {x.doc_id: x.n_tokens for x in tokens.token_counts(df).collect()} == {i: len(sp.encode(t)) for i, t in rows}
    assert {x.doc_id: x.n_words for x in host_rules.judged(df.withColumn("source", df.text.substr(1, 1))).collect()} == {i: len(WORD.findall(t)) for i, t in rows}
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    gone = {x.doc_id: x.n_removed for x in recompression.remove_repeats(df).collect()}
    assert gone[1] == gone[4] == 0 and gone[3] == len(WORD.findall(rows[2][1])) - (" " not in long[999:1001]) and abs(gone[2] - len(rows[0][1].split())) <= 1
    gone = {x.doc_id: x.n_removed for x in suffix.remove_repeats(df).collect()}
    assert gone == {1: 0, 2: 40_000, 3: len(rows[2][1]), 4: 0}


def test_proximity_cases(spark):
    d = spark.createDataFrame([(1, "beta x alpha y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha alpha beta gamma"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha beta"), (3, "")], "item_id long, text string")
    vocabulary, terms, _ = decontamination.phrases(items)
    got = decontamination.proximity(decontamination.build_index(d, vocabulary), terms, slack=3)
    assert {r.doc_id for r in got.collect()} == {1, 3}
    vocabulary, terms, _ = decontamination.phrases(items.filter("item_id > 9"))
    assert decontamination.proximity(decontamination.build_index(d, vocabulary), terms, slack=3).count() == 0


def test_proximity_plain(spark):
    """Random short documents against every span of every document, with repeated rows and words."""
    rng = random.Random(8)
    alphabet = [f"t{k}" for k in range(9)]
    rows = [(k, " ".join(rng.choices(alphabet, [9, 7, 5, 3, 2, 2, 1, 1, 1], k=rng.choice((0, 3, 9, 40, 90))))) for k in range(60)]
    rows += [rows[4], (None, rows[7][1]), (None, rows[7][1]), (None, None)]
    items = [(k, " ".join(rng.choices(alphabet, k=n))) for k, n in enumerate((1, 2, 3, 4, 5, 7, 9, 10, 11, 14))] + [(90, "t0 t0 t0"), (91, "t8"), (92, "nowhere t1")]
    want = []
    for i, text in rows:
        ws, near, hit, named = (text or "").split(), set(), set(), set()
        for item, phrase in items:
            p = phrase.split()
            for at in range(max(len(p) - 9, 1)):
                q = p[at : at + 10]
                span = len(q) + decontamination.SLACK
                if any(not Counter(q) - Counter(ws[s : s + span]) for s in range(len(ws))):
                    near.add(item)
                for s in range(len(ws) - len(q) + 1):
                    if ws[s : s + len(q)] == q:
                        hit |= set(range(s, s + len(q)))
                        named.add(item)
        want.append((str(i), len(ws), len(hit), len(named), len(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.n_near) for r in got) == sorted(want)
