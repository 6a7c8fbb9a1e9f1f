"""Line dedup by a tree of log templates.

A line (between \\n) that has a word falls down a tree of fixed depth: by its number of tokens, then
by its leading DEPTH tokens, where tokens with a digit count as the variable <*>. A line of no more
tokens than that is short: all its tokens are compared as they stand, so it is its own template. In
the leaf that a line reaches, a token that stands at its place in lines of MIN_DOCS documents is fixed,
any other becomes <*>. A template needs CONSTANT_PERCENT fixed tokens, and of the tokens below the
leading ones FIT_PERCENT fixed or with a digit, so that prose which merely begins alike is left
alone. A line whose template recurs in MIN_DOCS documents is dropped, but from the template's first
document (least id).

Leaves, tokens of leaves and templates are counted in the same way, one after the other: each bucket
of documents sends one entry (64-bit key, documents, least id) per distinct key to the key's bucket,
which sends the keys that recur often enough back to the buckets they came from. So a leaf or a line
that a third of all documents hold costs one entry per bucket, and only lines of leaves that recur
send their tokens.

Defined cases: a null or empty text has no lines and stays as it is; null ids count as smaller than
any other; rows that share an id count as documents of their own, and all of them keep what that id
keeps; an empty table gives an empty result; other columns are left as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Words, mix, slices
from .common import NO_ID, ROUTED, bucket_of, buckets_for, deal, ids_out, lean_group, pack, prime_from, routed_batch, unpack

DEPTH = 3
MIN_DOCS = 20
CONSTANT_PERCENT = 50
FIT_PERCENT = 60

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ANY = mix(np.array([0x3C2A3E], np.uint64))[0]
_BUCKET, _ID, _TEXT = "_quillmill_bucket", "_quillmill_id", "_quillmill_text"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


class Lines:
    """The lines with words of one slice: document row, span of words, span of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        h = w.hashes()
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        variable = digits[w.end] > digits[w.start]
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, w.start)  # breaks before the word
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        self.first, self.size = first, size
        self.token = np.where(variable & np.repeat(size > DEPTH, size), _ANY, h)
        self.doc = w.doc[self.first]
        edges = np.append(breaks, len(data))
        stop = np.minimum(edges[line[self.first]], offsets[self.doc + 1])
        begin = np.maximum(np.concatenate([[0], breaks + 1])[line[self.first]], offsets[self.doc])
        self.begin, self.stop = begin, stop
        leaf = self.size.astype(np.uint64)
        for d in range(DEPTH):
            has = self.size > d
            leaf[has] = mix(leaf[has] * np.uint64(31) + self.token[self.first[has] + d])
        self.leaf = leaf

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines `which`: the line's place in `which`, the position and the word of each token."""
        size = self.size[which]
        own = np.repeat(np.arange(len(which)), size)
        pos = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        return own, pos, self.first[which][own] + pos

    def token_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, pos, word = self.tokens(which)
        return own, mix(self.leaf[which][own] + mix(self.token[word] + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), word

    def templates(self, which: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines `which` those with enough fixed tokens, and their templates. fixed: sorted keys."""
        if not len(which):
            return which, np.zeros(0, np.uint64)
        own, key, word = self.token_keys(which)
        variable = self.token[word] == _ANY
        constant = member(key, fixed) & ~variable
        starts = np.cumsum(self.size[which]) - self.size[which]
        below = word - self.first[which][own] >= DEPTH
        n, fit = (np.add.reduceat(x.astype(np.int64), starts) for x in (constant, (constant | variable) & below))
        # a key holds its place and leaf, so a sum of the constant ones names the template
        name = mix(np.add.reduceat(np.where(constant, key, np.uint64(0)), starts) + self.leaf[which])
        ok = (100 * n >= np.where(self.size[which] > DEPTH, CONSTANT_PERCENT, 100) * self.size[which]) & (100 * fit >= FIT_PERCENT * (self.size[which] - DEPTH))
        return which[ok], name[ok]


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _entries(key: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the number of rows that hold them and the least id among those."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key))), np.minimum.reduceat(ids[row], at)


def _replies(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The recurring keys of a round, sorted, with their least ids."""
    got = [unpack(p.as_py()) for p in table.column("payload")]
    got = [(k, i) for t, k, i in got if t[0] == kind]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, ids = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key)
    return key[order], ids[order]


LEAF, TOKEN, TEMPLATE = 0, 1, 2


def _round(kind: int, n: int):
    """The entries of one round from a bucket's documents and the replies so far."""

    def send(bucket: int, docs: pa.Table, replies: pa.Table | None) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_batches([routed_batch([])])
        ids = docs.column(_ID).to_numpy().astype(np.int64)
        leaves = _replies(replies, LEAF)[0] if kind > LEAF else None
        fixed = _replies(replies, TOKEN)[0] if kind > TOKEN else None
        keys, rows = [], []
        for lo, _, data, offsets in slices(docs.column(_TEXT).combine_chunks()):
            x = Lines(data, offsets)
            if kind == LEAF:
                keys.append(x.leaf)
                rows.append(lo + x.doc)
                continue
            which = np.flatnonzero(member(x.leaf, leaves))
            if kind == TOKEN:
                own, key, _ = x.token_keys(which)
                keys.append(key)
                rows.append(lo + x.doc[which][own])
            else:
                which, name = x.templates(which, fixed)
                keys.append(name)
                rows.append(lo + x.doc[which])
        key, count, least = _entries(np.concatenate(keys), np.concatenate(rows), ids)
        out = [(k, bucket, pack(k1, c1.astype(np.uint32), i1)) for k, (k1, c1, i1) in deal(bucket_of(key, n), n, key, count, least)]
        if replies is not None:  # what was learnt before goes along
            out += [(bucket % n, -1 - bucket, p.as_py()) for p in replies.column("payload")]
        return pa.Table.from_batches([routed_batch(out)])

    if kind == LEAF:
        return lambda key, docs: send(key[0].as_py(), docs, None)
    return lambda key, docs, replies: send(key[0].as_py(), docs, replies)


def _tally(kind: int):
    """Sums the entries of each key; those that recur go back to every bucket that sent them."""

    def run(group: pa.Table) -> pa.Table:
        out, parts, sender = [], [], []
        for target, payload in zip(group.column("target").to_pylist(), group.column("payload"), strict=True):
            if target < 0:
                out.append((-1 - target, -1 - target, payload.as_py()))
            else:
                parts.append(unpack(payload.as_py()))
                sender.append(target)
        if parts:
            key, count, least = (np.concatenate(c) for c in zip(*parts, strict=True))
            own = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            order = np.argsort(key, kind="stable")
            key, count, least, own = key[order], count[order].astype(np.int64), least[order], own[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            at, g = np.flatnonzero(first), np.cumsum(first) - 1
            often = (np.add.reduceat(count, at) >= MIN_DOCS)[g]
            low = np.minimum.reduceat(least, at)[g]
            for k, (k1, i1) in deal(own[often], len(parts), key[often], low[often]):
                out.append((sender[k], sender[k], pack(np.array([kind], np.uint8), k1, i1)))
        return pa.Table.from_batches([routed_batch(out)])

    return run


def _rewritten(docs: pa.Table, replies: pa.Table):
    """(row, text left, lines, lines dropped) of each document."""
    ids = docs.column(_ID).to_numpy().astype(np.int64)
    leaves, fixed = _replies(replies, LEAF)[0], _replies(replies, TOKEN)[0]
    drop, first_doc = _replies(replies, TEMPLATE)
    cuts: dict[int, list[tuple[int, int]]] = {}
    for lo, _, data, offsets in slices(docs.column(_TEXT).combine_chunks()):
        x = Lines(data, offsets)
        which, name = x.templates(np.flatnonzero(member(x.leaf, leaves)), fixed)
        row = lo + x.doc[which]
        hit = member(name, drop)
        hit[hit] = first_doc[np.searchsorted(drop, name[hit])] != ids[row[hit]]
        for r, a, b in zip(row[hit].tolist(), (x.begin - offsets[x.doc])[which][hit].tolist(), (x.stop - offsets[x.doc])[which][hit].tolist(), strict=True):
            cuts.setdefault(r, []).append((a, b))
    for row, text in enumerate(docs.column(_TEXT).to_pylist()):
        raw, gone = text.encode(), cuts.get(row, [])
        n = raw.count(b"\n") + 1
        if gone:
            kept, at = [], 0
            for a, b in gone:  # a dropped line goes with its line break
                kept.append(raw[at:a])
                at = b + 1
            kept.append(raw[at:])
            raw = b"".join(kept)
            if gone[-1][1] >= len(text.encode()) and raw.endswith(b"\n"):
                raw = raw[:-1]
        yield row, raw, n, len(gone)


def _report(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
    rows = [(n, d, hashlib.sha256(raw).hexdigest()) for _, raw, n, d in _rewritten(docs, replies)] if docs.num_rows else []
    n, d, s = zip(*rows, strict=True) if rows else ((), (), ())
    ids = docs.column(_ID).to_numpy().astype(np.int64)
    return pa.table([ids_out(ids), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _dealt(docs: DataFrame, n: int, columns: list[str]) -> DataFrame:
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(F.pmod(d, F.lit(n)).cast("int").alias(_BUCKET), d.alias(_ID), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(_TEXT), *(F.col(f"`{c}`") for c in columns))


def _learnt(docs: DataFrame, n: int, n_docs: int, columns: list[str]) -> DataFrame:
    dealt = _dealt(docs, n_docs, columns)
    replies = dealt.groupBy(_BUCKET).applyInArrow(lean_group(_round(LEAF, n)), ROUTED).groupBy("bucket").applyInArrow(lean_group(_tally(LEAF)), ROUTED)
    for kind in (TOKEN, TEMPLATE):
        sent = dealt.groupBy(_BUCKET).cogroup(replies.groupBy("bucket")).applyInArrow(lean_group(_round(kind, n)), ROUTED)
        replies = sent.groupBy("bucket").applyInArrow(lean_group(_tally(kind)), ROUTED)
    return replies


def drop_templates(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text left) of every document."""
    n = buckets_for(docs)
    n_docs = prime_from(n)
    replies = _learnt(docs, n, n_docs, [])
    return _dealt(docs, n_docs, []).groupBy(_BUCKET).cogroup(replies.groupBy("bucket")).applyInArrow(lean_group(_report), RESULT)


def without_templates(docs: DataFrame) -> DataFrame:
    """The rows of docs with the text that is left. A row whose words all went goes too; a column
    n_chars of the text's length is kept true."""
    n = buckets_for(docs)
    n_docs = prime_from(n)
    columns = [c for c in docs.columns if c != "text"]
    replies = _learnt(docs, n, n_docs, columns)
    names = docs.columns
    chars = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def rewrite(key, group: pa.Table, replies: pa.Table) -> pa.Table:
        texts, keep, sizes = [], [], []
        for _, raw, _, dropped in _rewritten(group, replies) if group.num_rows else ():
            keep.append(not dropped or bool(raw.split()))
            texts.append(raw.decode())
            sizes.append(len(texts[-1]) if dropped else -1)
        out = group.append_column("text", pa.array(texts, pa.string()))
        if chars and group.num_rows:
            size = np.array(sizes)
            old = group.column("n_chars")
            new = pa.array(np.where(size >= 0, size, 0), mask=size < 0).cast(old.type)
            out = out.set_column(out.column_names.index("n_chars"), "n_chars", pa.compute.coalesce(new, old.combine_chunks()))
        return out.select(names).filter(pa.array(keep, pa.bool_()))

    return _dealt(docs, n_docs, columns).groupBy(_BUCKET).cogroup(replies.groupBy("bucket")).applyInArrow(lean_group(rewrite), docs.schema)
