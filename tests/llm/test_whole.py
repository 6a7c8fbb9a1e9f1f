"""Whole results where an operator once did less: each test failed before its finding was settled."""

from __future__ import annotations

import hashlib
import random
import time

from quillmill.llm import decontamination, minhash, secrets, templates


def test_near_dedup_of_the_stage(spark, monkeypatch):
    """Copies of similarity 0.80 to 0.85 go in the pipeline and stay in op10."""
    import corpus_pipeline

    r = random.Random(8)
    rows, sets = [], []
    for base in range(12):
        words = [f"b{base}x{k}" for k in range(104)]
        for _ in range(4):
            w = list(words)
            for at in r.sample(range(len(w)), r.randint(0, 4)):
                w[at] = f"e{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
            sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    near = {(a, b): 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert any(80 <= x < 85 for x in near.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def firsts(percent):
        root = list(range(len(sets)))
        for (a, b), x in sorted(near.items()):
            if x >= percent:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if x in (ra, rb) else x for x in root]
        return root

    assert firsts(80) != firsts(85)
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(firsts(80))
    monkeypatch.setattr(minhash, "LONG_LIST", 2)  # by rare shingles
    for percent in (80, 85):
        got = dict(minhash.near_duplicates(df, percent).select("doc_id", "component_id").collect())
        assert [got[k] for k in range(len(rows))] == firsts(percent)


def test_short_lines(spark):
    """A line of one to three words that recurs goes, whatever its words; one that differs stays."""
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(12))
    short = ["Les.", "And ornd.", "All rights reserved.", "v1.2"]
    rows = [(k, "\n".join([prose(), *short, f"Page {k}", prose()])) for k in range(30)]
    got = {x.doc_id: x for x in templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        left = [x for x in t.split("\n") if k == 0 or x not in short]
        assert (got[k].n_lines, got[k].n_dropped) == (7, 0 if k == 0 else 4)
        assert got[k].kept_sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_repeated_rows_hold_a_window(spark):
    window = " ".join(f"q{k}" for k in range(10))
    rows = [(1, f"a {window} b")] * 3 + [(None, window)] * 2 + [(2, "q0 q1 q2"), (3, window), (4, "two words"), (4, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, window), (8, "two words")], "item_id long, text string")
    hits = sorted((x.doc_id or 0, x.n_hit, x.contaminated) for x in decontamination.contamination(df, items).collect())
    assert hits == [(0, 10, True)] * 2 + [(1, 10, True)] * 3 + [(2, 0, False), (3, 10, True)] + [(4, 2, True)] * 2
    assert [x.doc_id for x in decontamination.clean(df, items).collect()] == [2]


def flow(text):
    return [text[s:e] for s, k, e in secrets.spans(text)[1] if secrets.KINDS[k] == "flow"]


def test_long_expressions_and_literals():
    many = [f"q{k}Zx" for k in range(300)]
    assert flow("db_secret = " + " + ".join(f'"{x}"' for x in many)) == many
    assert flow("".join(f'p{k} = "{x}"\n' for k, x in enumerate(many)) + "db_secret = " + " + ".join(f"p{k}" for k in range(300))) == many
    late = ['""'] * 64 + ['"Zk39xQw71LmA"']
    assert flow("db_secret = " + " + ".join(late)) == ["Zk39xQw71LmA"]  # the score counts what comes late
    blob = "aB3/ x" * 2000
    assert flow(f'credential_password = "{blob}"') == [blob]
    assert flow(f"credential_password = '{blob}'") == [blob]
    # 2 ** 400 parts, one span
    start = time.monotonic()
    assert flow('p0 = "Zk39xQ"\n' + "".join(f"p{k + 1} = p{k} + p{k}\n" for k in range(400)) + "db_secret = p400") == ["Zk39xQ"]
    assert time.monotonic() - start < 20
    assert flow('db_secret = "' + "x" * 100 + '"') == []  # a placeholder of any length


def test_lexer_forms():
    lit = "Zk39xQw71LmA8"
    for before, after in (('db_password: str = "', '"'), ('const apiSecret: string = \'', "'"), ('a = db_secret = "', '"'), ('db_secret = b"', '"'), ('auth_token => `', "`"), ('"client_secret" : "', '" ,'), ('private_key = """', '"""'), ("# my_secret = '", "'"), ('secret = {"github": "', '"}'), ("db_secret = (\n  # why\n  '", "'\n)"), ("db_secret = /* why */ '", "'"), ("x = 1; user.password := '", "'"), ("db_secret = ['", "', other]")):
        text = f"{before}{lit}{after}\n"
        assert any(lit in text[a:b] for a, _, b in secrets.spans(text)[1]), before
    assert flow(f'db_secret = later\nlater = "{lit}"') == [lit]  # bound further on
    assert flow(f'f {{ part = "{lit}" }}\ndb_secret = part2 + part2\npart = "no"') == []
    assert flow(f'part = "{lit}"\nf {{ part = "x" }}\ndb_secret = part') == [lit]  # the scope's own name is gone
    assert flow(f'# part = "{lit}"\ndb_secret = part') == []  # a comment's name holds in it alone
    assert flow(f'db_secret = load("{lit}")') == []
    assert flow('db_secret = "a\\"b1Zk39xQw71L" "mA8"') == ['a\\"b1Zk39xQw71L', "mA8"]
    assert flow(f'a = b\nb = a\ndb_secret = a + b + "{lit}"') == [lit]  # names that lead in a circle


def test_lexer_against_programs():
    """Programs put together from statements of which it is known what each name holds."""
    r = random.Random(12)
    for _ in range(300):
        out, holds, want = "", {}, set()
        for k in range(r.randint(1, 12)):
            name = r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 2))
            target = r.random() < 0.4
            out += r.choice(["", "let ", "  ", "// note\n", "see: nothing\n"]) + (f"db_secret_{k}" if target else name) + r.choice([" = ", "=", " := ", ": str = "])
            spans_ = set()
            for j in range(r.randint(1, 4)):
                out += " + " if j else ""
                if holds and r.random() < 0.5:
                    known = r.choice(sorted(holds))
                    out += known
                    spans_ |= holds[known]
                else:
                    quote = r.choice("'\"")
                    value = "".join(r.sample("bcdefghKLMNOPQ023456789", r.randint(12, 16))) + "a1"
                    spans_.add((len(out) + 1, len(out) + 1 + len(value)))
                    out += quote + value + quote
            out += r.choice(["\n", ";\n", "  # end\n"])
            if target:
                want |= spans_
            else:
                holds[name] = spans_
        base = secrets.base_spans(out)
        want = {s for s in want if not any(a <= s[0] and s[1] <= b for a, _, b in base)}
        assert set(secrets.lexed(out)) - want <= {s for s in secrets.lexed(out) if any(a <= s[0] and s[1] <= b for a, _, b in base)}
        assert {(s, e) for s, k, e in secrets.spans(out)[1] if k == 3} == want, out


def test_scan_is_linear():
    for text in ("a" * 1_000_000 + " = ", "a.b-" * 250_000, "x=" * 400_000, "{" * 500_000 + "a = 'b'", "db_secret = '" * 60_000, "k: v\n" * 150_000, '"""' * 200_000, "p = p + p\n" * 100_000):
        start = time.monotonic()
        secrets.spans(text)
        assert time.monotonic() - start < 12, text[:20]
