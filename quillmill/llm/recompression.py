"""Removal of repeated word windows by recompression.

Each text's words are compressed in two rounds. A round names runs of one symbol, then pairs of
neighbours whose left symbol falls in the one and whose right symbol in the other half of the
alphabet. Names and halves are fixed functions of what a symbol stands for, so the rounds name
globally without exchanging a table of names, and equal word sequences get equal symbols inside,
wherever they stand; only symbols near their edges depend on what surrounds them.

A boundary between two second-level symbols of at most two words each is fixed by the three words
on either side of it. So of two equal windows of 13 words both have the same such boundaries from
their 4th to their 11th word, and the one with the least name (of the two symbols and the words
that fix the boundary) is the window's mark. A window without any (long runs, repeated pairs) is
its own mark. Marks that two documents share reveal candidates; their windows are then compared in
full by an 80-bit name of their 13 words.

How it runs: (1) marks are dealt to buckets by name, one entry per mark and batch; a batch settles
by itself what repeats within it, so a mark that a third of all documents hold costs a bucket one
entry per batch; (2) shared marks go back to the documents' buckets, where windows are selected and
dealt by name in the same way; (3) covered words go back to the documents. Everything crosses as
packed arrays. Nothing is collected to the driver, no pairs of documents are formed.

Defined cases: a null or short text has no window and loses nothing; null ids count as smaller than
any other and rows with equal ids never remove words from each other; repeated rows keep their
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, _powers, grams, mix, slices
from .common import ROUTED, bucket_of, buckets_for, by_bucket, deal, ids_out, in_order, lean, lean_group, narrow, pack, pack_ids, prime_from, routed_batch, texts_of, unpack

WINDOW = 13
REACH = 3  # words on either side that fix a boundary between symbols of at most two words
_NONE = np.uint64((1 << 64) - 1)
_HALF = (np.uint64(1 << 17), np.uint64(1 << 43))  # the bit that tells the halves, by round
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _parts(symbols: np.ndarray, forced: np.ndarray, level: int) -> np.ndarray:
    """Where a round's symbols begin: not inside a run, nor inside a pair of halves."""
    right = (symbols & _HALF[level]) != 0
    out = np.ones(len(symbols), bool)
    out[1:] = (symbols[1:] != symbols[:-1]) & (right[:-1] | ~right[1:])
    return out | forced


def boundary_names(w: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each word, the name of the second-level boundary before it; _NONE where there is none
    that three words on either side fix. opens: whether a word is the first of its document."""
    n = len(w)
    out = np.full(n + 1, _NONE)
    if n < 2 * REACH:
        return out
    start = np.flatnonzero(_parts(w, opens, 0))
    size = np.diff(np.append(start, n))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w * up[:n], out=sums[1:])
    first = mix((sums[start + size] - sums[start]) * down[start])  # names of first-level symbols
    second = _parts(first, opens[start], 1) & ~opens[start] & (size <= 2)
    second[1:] &= size[:-1] <= 2
    second[0] = False
    k = np.flatnonzero(second)
    at = start[k]
    ok = (at >= REACH) & (at + REACH <= n)
    k, at = k[ok], at[ok]
    words = grams(w, 2 * REACH)[at - REACH]
    out[at] = mix(words ^ (first[k - 1] * np.uint64(3)) ^ (first[k] * np.uint64(5)))
    return out


def window_marks(w: np.ndarray, doc: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first words of all windows within a document, their marks, and their names."""
    n = len(w) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    m = boundary_names(w, opens)
    for step in (1, 2, 4):
        m = np.minimum(m[:-step], m[step:])
    name = grams(w, WINDOW)
    mark = m[REACH : REACH + n]
    mark = np.where(mark == _NONE, name, mark)
    return at, mark[at], name[at]


def _check(w: np.ndarray) -> np.ndarray:
    """16 more bits of each window's name, from another polynomial."""
    n = len(w) - WINDOW + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(WINDOW):
        out *= np.uint64(0xD1B54A32D192ED03)
        out += w[j : j + n] ^ (w[j : j + n] >> np.uint64(29))
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def _opens(w: Words) -> np.ndarray:
    out = np.zeros(len(w.start), bool)
    out[w.first[:-1][w.counts > 0]] = True
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in sorted order: the first place of each group, and each entry's group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _send_marks(n_buckets: int, n_docs: int):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            marks, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, _, data, offsets in slices(b.column("text")):
                w = Words(data, offsets)
                at, mark, _ = window_marks(w.hashes(), w.doc, _opens(w))
                doc = w.doc[at]
                change = np.ones(len(at), bool)
                change[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
                marks.append(mark[change])
                owner.append(ids[lo + doc[change]])
            mark, doc = np.concatenate(marks), np.concatenate(owner)
            order = np.lexsort((doc, mark))
            mark, doc = mark[order], doc[order]
            keep, _ = _groups(mark, doc)
            mark, doc = mark[keep], doc[keep]
            first, group = _groups(mark)
            many = np.bincount(group, minlength=len(first)) > 1
            rows = []
            settled = np.flatnonzero(many[group]) if len(group) else np.zeros(0, np.int64)
            for t, (m, d) in deal(np.mod(doc[settled], n_docs), n_docs, mark[settled], doc[settled]):
                rows.append((t % n_buckets, t, pack(m, *pack_ids(d))))
            by_doc = np.argsort(doc[first], kind="stable")
            m, d, s = mark[first][by_doc], doc[first][by_doc], many[by_doc]
            for k, (m1, d1, s1) in deal(bucket_of(m, n_buckets), n_buckets, m, d, s):
                rows.append((k, -1, pack(m1, *pack_ids(d1), s1.astype(np.uint8))))
            if rows:
                yield routed_batch(rows)

    return run


def _shared_marks(n_docs: int):
    """A mark that came from two batches is shared; who sent it alone in a batch is told so."""

    def run(group: pa.Table) -> pa.Table:
        rows, cols = [], []
        for target, payload in zip(group.column("target").to_pylist(), group.column("payload"), strict=True):
            if target >= 0:
                rows.append((target, target, payload.as_py()))
            else:
                m, values, index, settled = unpack(payload.as_py())
                cols.append((m, values[index], settled))
        if cols:
            m, d, s = (np.concatenate(c) for c in zip(*cols, strict=True))
            order = np.argsort(m, kind="stable")
            m, d, s = m[order], d[order], s[order]
            first, group_of = _groups(m)
            tell = (np.bincount(group_of)[group_of] > 1) & (s == 0)
            for t, (m1, d1) in deal(np.mod(d[tell], n_docs), n_docs, m[tell], d[tell]):
                rows.append((t, t, pack(m1, *pack_ids(d1))))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _send_windows(n_buckets: int):
    """The windows with shared marks: one entry per window, for the least document of the bucket;
    the bucket's others are covered by that one and go straight back."""

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if not docs.num_rows or not replies.num_rows:
            return pa.Table.from_batches([routed_batch([])])
        docs = in_order(docs)
        ids = docs.column("doc_id").to_numpy().astype(np.int64)
        parts = [unpack(p.as_py()) for p in replies.column("payload")]
        owner = np.concatenate([v[i] for _, v, i in parts])
        salt = lambda x: mix(x.view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        wanted = np.unique(np.concatenate([m for m, _, _ in parts]) ^ salt(owner))
        found = []
        for lo, _, data, offsets in slices(docs.column("text")):
            w = Words(data, offsets)
            h = w.hashes()
            at, mark, name = window_marks(h, w.doc, _opens(w))
            row = lo + w.doc[at]
            pair = mark ^ salt(ids[row])
            place = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            hit = wanted[place] == pair
            at, row = at[hit], row[hit]
            found.append((name[hit], _check(h)[at], row, at - w.first[row - lo]))
        name, check, row, start = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((row, check, name))
        name, check, row, start = name[order], check[order], row[order], start[order]
        first, group = _groups(name, check)
        least = ids[row[first]][group] if len(first) else np.zeros(0, np.int64)
        covered = ids[row] > least
        rows = []
        if covered.any():
            rows.append((bucket % n_buckets, bucket, pack(narrow(row[covered]), narrow(start[covered]))))
        send = np.flatnonzero(~covered)
        send = send[np.argsort(row[send], kind="stable")]
        n, c, r, s = name[send], check[send], row[send], start[send]
        for k, (n1, c1, r1, s1) in deal(bucket_of(n, n_buckets), n_buckets, n, c, r, s):
            used, index = np.unique(r1, return_inverse=True)
            rows.append((k, -1 - bucket, pack(n1, c1, narrow(index), ids[used], narrow(used), narrow(s1))))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _covered_windows():
    """Of equal windows, those of documents above the least are covered."""

    def run(group: pa.Table) -> pa.Table:
        rows, cols, back = [], [], []
        for target, payload in zip(group.column("target").to_pylist(), group.column("payload"), strict=True):
            if target >= 0:
                rows.append((target, target, payload.as_py()))
                continue
            n, c, index, ids, used, start = unpack(payload.as_py())
            back.append(-1 - target)
            cols.append((n, c, ids[index], used[index].astype(np.int64), start.astype(np.int64), np.full(len(n), len(back) - 1)))
        if cols:
            n, c, d, r, s, b = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.lexsort((d, c, n))
            first, group_of = _groups(n[order], c[order])
            d = d[order]
            covered = order[d > d[first][group_of]]
            for k, (r1, s1) in deal(b[covered], len(back), r[covered], s[covered]):
                rows.append((back[k], back[k], pack(narrow(r1), narrow(s1))))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _remove(key, docs: pa.Table, hits: pa.Table) -> pa.Table:
    docs = in_order(docs)
    ids = docs.column("doc_id").to_numpy().astype(np.int64)
    parts = [unpack(p.as_py()) for p in hits.column("payload")]
    row = np.concatenate([r.astype(np.int64) for r, _ in parts]) if parts else np.zeros(0, np.int64)
    start = np.concatenate([s.astype(np.int64) for _, s in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, start = row[order], start[order]
    edge = np.searchsorted(row, np.arange(len(ids) + 1))
    n_words, n_removed, digest = [], [], []
    for k, text in enumerate(docs.column("text").to_pylist()):
        words = text.encode().split()  # bytes split at \x20 and \x09-\x0D only
        n = len(words)
        n_words.append(n)
        if edge[k] < edge[k + 1]:
            step = np.zeros(n + 1, np.int64)
            s = start[edge[k] : edge[k + 1]]
            np.add.at(step, s, 1)
            np.add.at(step, s + WINDOW, -1)
            left = np.cumsum(step[:-1]) == 0
            words = [w for w, stays in zip(words, left.tolist(), strict=True) if stays]
        n_removed.append(n - len(words))
        digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table([ids_out(ids), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    n = buckets_for(docs)
    n_docs = prime_from(n)
    dealt = by_bucket(docs, n_docs)
    marks = by_bucket(docs, n_docs).drop("bucket").mapInArrow(lean(_send_marks(n, n_docs)), ROUTED)
    shared = marks.groupBy("bucket").applyInArrow(lean_group(_shared_marks(n_docs)), ROUTED)
    windows = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(lean_group(_send_windows(n)), ROUTED)
    covered = windows.groupBy("bucket").applyInArrow(lean_group(_covered_windows()), ROUTED)
    return dealt.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(lean_group(_remove), RESULT)
