"""Operators 11 to 13 against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import prefix_trie, toxicity, vector_codes
from quillmill.llm.oracles import ORACLES
from quillmill.llm.queries import QUERIES

from ..oracle import SF, rows, sql_rows

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_prefix_trie"])
def test_against_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == sql_rows(ORACLES[name])


# --- op11 ---------------------------------------------------------------------------------------


def plain_codes(table):
    kept = [(i, [int(math.floor(4096 * x)) if abs(x) < 1e10 else int(x) * 4096 for x in v], y) for i, v, y in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            to = defaultdict(list)
            for _, v, _ in kept:
                to[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(to[k]) for c in zip(*to[k], strict=True)] if k in to else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, y in kept:
        found = [near(part(v, p), books[p]) for p in range(8)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        by_label[y] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    return sorted((str(i), c, e, min(by_label[y], (1 << 63) - 1), digest) for i, c, e, y in out)


def coded(spark, table, schema=VECTORS):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(spark.createDataFrame(table, schema)).collect())


@pytest.mark.parametrize("width,seed", [(8, 1), (24, 2), (64, 3)])
def test_codes(spark, width, seed):
    g = np.random.default_rng(seed)
    vecs = np.round(g.normal(0, 0.2, (70, width)), 2).astype(np.float32).tolist()
    table = [(k, v, int(k % 3) if k % 7 else None) for k, v in enumerate(vecs)]
    table += [(None, vecs[3], 1), (5, vecs[5], 1), (200, None, 1), (201, [float("nan")] * width, 2), (202, [None] * width, 2), (203, [float("inf")] * width, 2)] + [(300 + k, vecs[0], 9) for k in range(9)]
    assert coded(spark, table) == plain_codes(table)


def test_codes_of_any_size(spark):
    g = random.Random(4)
    table = [(k, [g.choice([0.5, -1e4, 3e7, 2e30, -1e38, 0.0]) for _ in range(16)], 1) for k in range(40)]
    table = [(i, np.array(v, np.float32).astype(float).tolist(), y) for i, v, y in table]
    assert coded(spark, table) == plain_codes(table)


def test_few_and_no_vectors(spark):
    table = [(k, [0.1 * k] * 8, None) for k in range(3)]
    assert coded(spark, table) == plain_codes(table)
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, None, 2)], VECTORS)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 8, 2, "x"), (2, [1.0] * 9, 2, "x"), (3, [], 2, "x")], VECTORS + ", code string")
    assert [r.vec_id for r in vector_codes.compressed(odd).collect()] == [1]


def test_bounds_spare_distances():
    g = np.random.default_rng(5)
    for spread in (50, 4000, 1 << 24):
        x, book = g.integers(-spread, spread, (500, 16)), g.integers(-spread, spread, (16, 16))
        x[:400] = book[g.integers(0, 16, 400)] + g.integers(-spread // 50, spread // 50 + 1, (400, 16))
        book[9] = book[3]  # ties go to the lower index
        e, d, n = vector_codes.nearest(x, book, vector_codes.blocks_of(16))
        every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (e == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert n < 500 * 15 / 2


def test_decode(spark):
    vectors = spark.createDataFrame([(k, [float(k % 4)] * 8, 0) for k in range(20)], VECTORS)
    books = vector_codes.train(vectors)
    back = vector_codes.decode(vector_codes.encode(vectors, books), books)
    assert all(r.error == 0 and r.vector == [float(r.vec_id % 4)] * 8 for r in back.collect())


# --- op12 ---------------------------------------------------------------------------------------


def plain_trie(table):
    turns = defaultdict(list)
    for c, t, role, text in table:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            turns[c].append((t is not None, t or 0, key, role or "", text or ""))
    for v in turns.values():
        v.sort()
    seqs = {}
    for c, own in turns.items():
        h, lead = zlib.crc32(str(c).encode()) % 4, int(math.fmod(c, 20))
        seqs[c] = tuple(x[3:] for x in turns.get(c - lead, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(1 for n in members if len(n) == len(node) + 1 and n[:-1] == node), sum(1 for n in below if n not in inner), sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n=120):
    g = random.Random(seed)
    out = []
    for c in g.sample(range(-30, 400), n):
        for t in range(g.choice([1, 2, 3, 5, 9])):
            out.append((c, t if g.random() < 0.9 else None, g.choice(["user", "user", None]), g.choice(["hi", "hi", "hi there you", None, "ß x"])))
    out += [(20, 50 + k, "user", "long talk") for k in range(40)] + [(27, 50 + k, "user", "long talk") for k in range(40)] + [(None, 1, "user", "x")]
    out += [(c, 0, "user", "the same") for c in range(1000, 1060)] + out[:5]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,block,local", [(1, 4, 8), (2, 3, 1), (3, 1024, 1 << 16), (4, 5, 60)])
def test_trie(spark, seed, block, local):
    table = talk(seed)
    df = spark.createDataFrame(table, CONVERSATIONS).withColumn("depth", F.lit("clash")).repartition(3)
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df, block, local).collect()), key=str) == plain_trie(table)


def test_trie_of_little(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)).count() == 0
    table = [(c, 0, "user", "x") for c in (1, 2, 3)]  # few turns: rebuilt without any
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(table, CONVERSATIONS)).collect()), key=str)
    assert got == plain_trie(table)


def test_numbers_over_tasks(spark, monkeypatch):
    """A conversation that several tasks share is numbered through."""
    monkeypatch.setattr(prefix_trie, "MIN_TASKS", 7)
    df = spark.createDataFrame([(7, k, "user", f"t{k % 5}") for k in range(3000)] + [(9, 0, "user", "x")], CONVERSATIONS)
    key = prefix_trie.turn_key(F.col("role"), F.col("text"))
    turns, convs = prefix_trie.numbered(prefix_trie.scratch(df.select("conv_id", "turn", key.alias("key"), F.lit(1).cast("long").alias("words")), "t"))
    assert sorted(r.pos for r in turns.filter("conv_id = 7").collect()) == list(range(3000))
    assert {r.conv_id: r.n for r in convs.collect()} == {7: 3000, 9: 1}


# --- op13 ---------------------------------------------------------------------------------------


def test_toxicity_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.95
    hit = np.array([r.predicted for r in got])
    assert hit[y == 1].mean() > 0.8 and hit[y == 0].mean() < 0.03


def corpus(n=400):
    g = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "ne", "vo") for b in ("ra", "ki", "sum", "pel")]
    out = []
    for d in range(n):
        sentences = [" ".join(g.choices(words, k=8)) for _ in range(g.randint(1, 12))]
        if toxic := d % 6 == 0:
            k = g.randrange(len(sentences))
            sentences[k] += g.choice([" you Blockhead", " what a GRÜMPEL"])
        out.append((d, ". ".join(sentences) + ".", int(toxic)))
    return out


def test_offending_sentences(spark):
    table = corpus()
    docs = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in table], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    told = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).collect()}
    assert told == {d: y for d, _, y in table}
    for r in toxicity.offending_sentences(docs, model).collect():
        assert re.search("blockhead|grümpel", r.sentence.lower()) and r.sentence in table[r.doc_id][1]
    assert toxicity.offending_sentences(docs, model).select("doc_id").distinct().count() == sum(y for *_, y in table)
    # an odd text and a long one
    long = "lora kisum. " * 200_000
    odd = spark.createDataFrame([(None, None, 1), (900, "", 1), (901, long + "you blockhead. " + long, 1), (901, long, 1), (902, " \n.!?", 1)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.predicted, r.n_sentences, len(r.offending)) for r in toxicity.scored(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, 0, 0), (900, 0, 0, 0), (901, 1, 400_001, 1), (901, 0, 200_000, 0), (902, 0, 0, 0)], key=str)


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (3, None)], "doc_id long, text string")
    score = lambda labels: {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert set(score([]).values()) == {0.0}
    assert score([(1, 1), (1, None), (None, 1), (77, 0)]) == {1: 1.0, None: 1.0, 3: 0.0}
    empty = toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert empty.count() == 0


def test_held_out_labels_are_not_read(spark):
    table = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    scores = [
        sorted((r.doc_id, r.score, r.held_out) for r in toxicity.toxicity(docs, spark.createDataFrame([(d, flip(d, y)) for d, _, y in table], "doc_id long, toxic int")).collect())
        for flip in (lambda d, y: y, lambda d, y: 1 - y if out(d) else y)
    ]
    assert scores[0] == scores[1] and all(h == out(d) for d, _, h in scores[0])


def test_grouped_order():
    """Many strings at once are ordered as the suffix array of one text has their starts; a bucket's parts
    take no step for each symbol."""
    import sys

    from quillmill.llm import suffix

    rng = np.random.default_rng(5)
    for width, top in [(1, 3), (2, 2), (3, 2), (3, 40), (5, 2), (6, 3)]:
        text = np.unique(rng.integers(1, top + 1, (300, width)), axis=0)
        rng.shuffle(text)
        order = suffix.grouped_order(text).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i].tolist())
        one = np.ones((len(text), width + 1), np.int64)
        one[:, :width] = text + 1
        starts = [k // (width + 1) for k in suffix.suffix_array(one.reshape(-1).tolist()) if k % (width + 1) == 0]
        assert order == starts
    parts = rng.integers(0, 256, (5000, suffix.RIGHT), dtype=np.uint8)
    lines = 0

    def seen(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return seen

    before = sys.gettrace()
    sys.settrace(seen)
    try:
        suffix.classes(parts)
    finally:
        sys.settrace(before)
    assert lines < len(parts)
