"""Removal of repeated byte strings by suffix arrays of linear grouping construction.

Candidates. Each place in a text is named by the GRAM bytes that follow. Of the places inside a window
of WINDOW bytes the one of least name is the window's mark, so equal windows have equal marks at
equal places, in any script and with or without white space. Consecutive windows with one mark form
a segment: about one for every 17 bytes. Marks are dealt to buckets by name. Of equal segments under a mark, those of documents above the least are covered outright:
for the suffix array they are one string with several owners. Only where a mark has different
segments (the ends of repeated passages) are their bytes needed.

Suffix arrays. A bucket's distinct segments are cut at the mark into a left part, read backwards,
and a right part. The distinct parts, in no order, are strings of symbols that stand for SYMBOL
bytes each. They are sorted by grouping: suffixes that share a Lyndon prefix are one group, and a group's
order is that of the suffixes which its members' next-smaller pointers lead to. suffix_array() does this
for one text, group after group; grouped_order() for many short strings at once, where no pointer leaves
its string, so both phases go by columns of symbols and no step is taken for one symbol alone. With the
common prefixes of neighbours, the order gives every part's class at every depth, so two windows are equal
exactly if the classes of their left and right parts are; the least document of each class pair covers the
others.

How it runs: three passes over the documents' buckets with packed exchanges between, as in the
recompression operator; a batch settles what repeats within it, so a string that a third of all
documents hold costs a bucket one entry per batch. Nothing is collected to the driver.

Defined cases: a null text is empty; texts of fewer than WINDOW bytes lose nothing; null ids count as
smaller than any other, and rows with equal ids never remove bytes from each other; repeated rows
keep their rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import _LETTERS, mix, prefix_sums, slices, span_hashes
from .common import ROUTED, bucket_of, buckets_for, by_bucket, deal, ids_out, in_order, lean, lean_group, narrow, pack, pack_ids, prime_from, routed_batch, unpack

WINDOW, GRAM = 50, 16
#: A window begins 1 to REACH bytes before its mark.
REACH = WINDOW - GRAM
LEFT, RIGHT = REACH, WINDOW - 1
#: Bytes of a symbol of a suffix array: a left part is two, a right part three.
SYMBOL = 17
_PLACE = np.uint64((1 << 31) - 1)
_NONE = np.uint64((1 << 64) - 1)
COVERED, COMPARE = 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- the suffix array ---------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order. text: ranks 1 .. k; the end of the
    text is smaller than every symbol."""
    text = [*text, 0]
    n = len(text)
    tally = [0] * (max(text) + 2)
    for c in text:
        tally[c + 1] += 1
    for k in range(1, len(tally)):
        tally[k] += tally[k - 1]
    group = [tally[c] for c in text]  # a group is named by its first place
    size = [0] * n
    order, place = [0] * n, [0] * n
    for i, g in enumerate(group):
        at = g + size[g]
        order[at], place[i] = i, at
        size[g] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        low = group[order[end - 1]]
        members = order[low:end]
        if len(members) > 1:
            members.sort()
        reached: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                reached[j] = reached.get(j, 0) + 1
        if reached:
            if len(reached) == 1 or max(reached.values()) == 1:
                layers = [list(reached)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, c in reached.items():
                    by_count.setdefault(c, []).append(j)
                layers = [by_count[c] for c in sorted(by_count, reverse=True)]
            for layer in layers:  # more repeats of the group's prefix: greater
                moved: dict[int, list[int]] = {}
                for j in layer:
                    g = group[j]
                    size[g] -= 1
                    at, last = place[j], g + size[g]
                    other = order[last]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                    if g in moved:
                        moved[g].append(j)
                    else:
                        moved[g] = [j]
                for g, those in moved.items():
                    new = g + size[g]
                    size[new] = len(those)
                    for j in those:
                        group[j] = new
        end = low
    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # the next place of each group, by its name
    placed = [False] * n
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def grouped_order(text: np.ndarray) -> np.ndarray:
    """The ascending order of the rows of text, strings of ranks from 1 on, whose ends are smaller than
    every symbol: the order that suffix_array() has for their starts."""
    m, width = text.shape
    rows = np.arange(m)
    padded = np.zeros((m, 2 * width), np.int64)
    padded[:, :width] = text
    # first phase: a suffix's group is its Lyndon prefix, which goes on to the next smaller suffix
    smaller = np.full((m, width + 1), width, np.int64)
    words = np.zeros((m, width + 1, width), np.int64)
    step = np.arange(width)
    for c in reversed(range(width)):
        at = np.full(m, c + 1, np.int64)
        for _ in range(width - 1 - c):
            own = np.where(step < at[:, None] - c, padded[:, c : c + width], 0)
            other = words[rows, at]  # of the end: all 0, smaller than any
            first = (own != other).argmax(axis=1)
            at = np.where(own[rows, first] < other[rows, first], smaller[rows, at], at)
        smaller[:, c] = at
        words[:, c] = np.where(step < at[:, None] - c, padded[:, c : c + width], 0)
    flat = words.reshape(-1, width)
    by = np.lexsort(flat.T[::-1])
    group = np.empty(len(flat), np.int64)
    group[by] = np.cumsum(_new(*flat[by].T)) - 1  # the end's group is 0
    group = group.reshape(m, width + 1)
    # second phase: groups along the pointers
    keys, at = [], np.zeros(m, np.int64)
    for _ in range(width):
        keys.append(group[rows, at])
        at = smaller[rows, at]
    return np.lexsort(keys[::-1])


def classes(strings: np.ndarray) -> np.ndarray:
    """classes(s)[d, i] names string i's first d bytes, for rows of bytes of one width."""
    n, width = strings.shape
    if not n:
        return np.zeros((width + 1, 0), np.int64)
    power = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    _, first, index = np.unique(strings.astype(np.uint64) @ power, return_index=True, return_inverse=True)
    whole = strings[first]
    if (whole[index] != strings).any():  # two rows of one hash: equal rows are found by their bytes
        whole, index = np.unique(strings, axis=0, return_inverse=True)
    m, symbols = len(whole), -(-width // SYMBOL)
    padded = np.zeros((m, SYMBOL * symbols), np.uint8)
    padded[:, :width] = whole
    _, rank = np.unique(padded.view(f"V{SYMBOL}").reshape(-1), return_inverse=True)
    order = grouped_order(rank.reshape(m, symbols) + 1)
    differ = whole[order[1:]] != whole[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    out = np.zeros((width + 1, m), np.int64)
    for d in range(1, width + 1):
        out[d, order[1:]] = np.cumsum(common < d)
    return out[:, index]


# --- segments -----------------------------------------------------------------------------------


class Segments:
    """The segments of one slice: row, first and last window, place of the mark, mark and check."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        windows = n - WINDOW + 1
        empty = np.zeros(0, np.int64)
        if windows <= 0:
            self.row = self.first = self.last = self.place = empty
            self.mark = self.check = np.zeros(0, np.uint64)
            return
        sums = prefix_sums(data, _LETTERS)
        start = np.arange(n - GRAM + 1)
        name = span_hashes(sums, start, start + GRAM)
        least = np.full(n + REACH, _NONE)
        least[: len(start)] = (name & ~_PLACE) | start.astype(np.uint64)
        for step in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: -(REACH - 32)], least[REACH - 32 :])
        least = least[1 : windows + 1]  # of the places at 1 .. REACH bytes after the window's
        last_of = offsets[1:] - WINDOW
        size = np.maximum(last_of - offsets[:-1] + 1, 0)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(size) - size), size)
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        edge = np.flatnonzero(new)
        self.row, self.first = row[edge], at[edge]
        self.last = at[np.append(edge[1:], len(at))[: len(edge)] - 1] if len(edge) else empty
        self.place = (least[edge] & _PLACE).astype(np.int64)
        body = span_hashes(sums, self.first, self.last + WINDOW)
        self.mark = name[self.place]
        self.check = mix(body ^ mix((self.place - self.first).astype(np.uint64) * np.uint64(131) + (self.last - self.first).astype(np.uint64))) >> np.uint64(16)

    def key(self) -> np.ndarray:
        return mix(self.mark * np.uint64(3) + self.check)

    def parts(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The LEFT bytes before the marks, backwards, and the RIGHT bytes from them on; 0 beyond
        the segments."""
        place, first, stop = self.place[k], self.first[k], self.last[k] + WINDOW
        at = place[:, None] - 1 - np.arange(LEFT)
        left = np.where(at >= first[:, None], self.data[np.maximum(at, 0)], 0)
        at = place[:, None] + np.arange(RIGHT)
        right = np.where(at < stop[:, None], self.data[np.minimum(at, len(self.data) - 1)], 0)
        return left.astype(np.uint8), right.astype(np.uint8)


def _new(*keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _low(check: np.ndarray) -> list[np.ndarray]:
    return [(check & np.uint64(0xFFFFFFFF)).astype(np.uint32), (check >> np.uint64(32)).astype(np.uint16)]


def _send_marks(n_buckets: int, n_docs: int):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for lo, _, data, offsets in slices(b.column("text")):
                s = Segments(data, offsets)
                found.append((s.mark, s.check, ids[lo + s.row]))
            mark, check, doc = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((doc, check, mark))
            mark, check, doc = mark[order], check[order], doc[order]
            keep = _new(mark, check, doc)
            mark, check, doc = mark[keep], check[keep], doc[keep]
            first = _new(mark, check)
            rows = []
            later = np.flatnonzero(~first)
            for t, (m, c, d) in deal(np.mod(doc[later], n_docs), n_docs, mark[later], check[later], doc[later]):
                rows.append((t % n_buckets, t, pack(mix(m * np.uint64(3) + c), *pack_ids(d), np.full(len(m), COVERED, np.uint8))))
            at = np.flatnonzero(first)
            at = at[np.argsort(doc[at], kind="stable")]
            for k, (m, c, d) in deal(bucket_of(mark[at], n_buckets), n_buckets, mark[at], check[at], doc[at]):
                rows.append((k, -1, pack(m, *_low(c), *pack_ids(d))))
            if rows:
                yield routed_batch(rows)

    return run


def _judge_marks(n_docs: int):
    """Tells the owners of equal segments above the least document that theirs are covered, and the
    least ones of marks with several segments in several documents to send their bytes."""

    def run(group: pa.Table) -> pa.Table:
        rows, cols = [], []
        for target, payload in zip(group.column("target").to_pylist(), group.column("payload"), strict=True):
            if target >= 0:
                rows.append((target, target, payload.as_py()))
            else:
                m, low, high, values, index = unpack(payload.as_py())
                cols.append((m, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), values[index]))
        if cols:
            m, c, d = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.lexsort((d, c, m))
            m, c, d = m[order], c[order], d[order]
            segment, mark = _new(m, c), _new(m)
            g = np.cumsum(mark) - 1
            at = np.flatnonzero(mark)
            kinds = np.add.reduceat(segment.astype(np.int64), at)[g]
            apart = np.maximum.reduceat(d, at)[g] > np.minimum.reduceat(d, at)[g]
            least = d[np.flatnonzero(segment)][np.cumsum(segment) - 1]
            status = np.where(d > least, COVERED, np.where(segment & (kinds > 1) & apart, COMPARE, 0)).astype(np.uint8)
            tell = np.flatnonzero(status)
            for t, (m1, c1, d1, s1) in deal(np.mod(d[tell], n_docs), n_docs, m[tell], c[tell], d[tell], status[tell]):
                rows.append((t, t, pack(mix(m1 * np.uint64(3) + c1), *pack_ids(d1), s1)))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _send_parts(n_buckets: int):
    """Covered segments go straight on as spans; those to be compared go out with their bytes."""

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if not docs.num_rows or not replies.num_rows:
            return pa.Table.from_batches([routed_batch([])])
        docs = in_order(docs)
        ids = docs.column("doc_id").to_numpy().astype(np.int64)
        salt = lambda x: mix(x.view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        got = [unpack(p.as_py()) for p in replies.column("payload")]
        told = np.concatenate([k ^ salt(v[i]) for k, v, i, _ in got])
        status = np.concatenate([s for _, _, _, s in got])
        told, first = np.unique(told, return_index=True)
        status = status[first]
        spans, rows = [], []
        for lo, _, data, offsets in slices(docs.column("text")):
            s = Segments(data, offsets)
            if not len(s.row):
                continue
            row = lo + s.row
            k = s.key() ^ salt(ids[row])
            at = np.minimum(np.searchsorted(told, k), len(told) - 1)
            kind = np.where(told[at] == k, status[at], 0)
            base = offsets[s.row]
            c = kind == COVERED
            spans.append((row[c], (s.first - base)[c], (s.last - base)[c] + WINDOW))
            w = np.flatnonzero(kind == COMPARE)
            left, right = s.parts(w)
            columns = row[w], (s.place - base)[w], (s.place - s.last)[w], (s.place - s.first)[w], np.arange(len(w))
            for b, (r, p, a, z, x) in deal(bucket_of(s.mark[w], n_buckets), n_buckets, *columns):
                rows.append((b, -1 - bucket, pack(ids[r], narrow(r), narrow(p), a.astype(np.uint8), z.astype(np.uint8), left[x].reshape(-1), right[x].reshape(-1))))
        row, a, z = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        if len(row):
            # neighbouring segments overlap: join them before they go on
            order = np.lexsort((a, row))
            row, a, z = row[order], a[order], z[order]
            cut = np.ones(len(row), bool)
            cut[1:] = (row[1:] != row[:-1]) | (a[1:] > z[:-1])  # ends ascend within a row
            at = np.flatnonzero(cut)
            rows.append((bucket % n_buckets, bucket, pack(narrow(row[at]), narrow(a[at]), narrow(np.append(z[at[1:] - 1], z[-1:])))))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _compare():
    """Suffix arrays over a bucket's parts; of equal windows, those above the least document are
    covered."""

    def run(group: pa.Table) -> pa.Table:
        rows, cols, back = [], [], []
        for target, payload in zip(group.column("target").to_pylist(), group.column("payload"), strict=True):
            if target >= 0:
                rows.append((target, target, payload.as_py()))
                continue
            d, r, p, a, z, left, right = unpack(payload.as_py())
            back.append(-1 - target)
            cols.append((d, r.astype(np.int64), p.astype(np.int64), a.astype(np.int64), z.astype(np.int64), left.reshape(-1, LEFT), right.reshape(-1, RIGHT), np.full(len(d), len(back) - 1)))
        if cols:
            columns = [np.concatenate(x) for x in zip(*cols, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            d, r, p, near, far, left, right, b = (x[order] for x in columns)
            lefts, rights = classes(left), classes(right)
            many = len(d) + 1
            spans = []
            for a in range(1, REACH + 1):  # windows that begin a bytes before their mark
                k = np.flatnonzero((near <= a) & (a <= far))
                # at this depth the right part holds the mark's bytes, so equal windows have one mark
                window = lefts[a, k] * many + rights[WINDOW - a, k]
                order = np.argsort(window, kind="stable")  # within a window still by document
                k, new = k[order], _new(window[order])
                hit = k[d[k] > d[k][new][np.cumsum(new) - 1]] if len(k) else k
                spans.append((hit, p[hit] - a))
            k, start = (np.concatenate(x) for x in zip(*spans, strict=True))
            order = np.lexsort((start, r[k], b[k]))
            k, start = k[order], start[order]
            if len(k):
                cut = np.ones(len(k), bool)
                cut[1:] = (r[k][1:] != r[k][:-1]) | (b[k][1:] != b[k][:-1]) | (start[1:] > start[:-1] + WINDOW)
                at = np.flatnonzero(cut)
                stop = np.append(start[at[1:] - 1], start[-1:]) + WINDOW
                for x, (r1, s1, e1) in deal(b[k][at], len(back), r[k][at], start[at], stop):
                    rows.append((back[x], back[x], pack(narrow(r1), narrow(s1), narrow(e1))))
        return pa.Table.from_batches([routed_batch(rows)])

    return run


def _remove(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs = in_order(docs)
    ids = docs.column("doc_id").to_numpy().astype(np.int64)
    got = [[c.astype(np.int64) for c in unpack(p.as_py())] for p in spans.column("payload")]
    row, a, z = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((a, row))
    row, a, z = row[order], a[order], z[order]
    edge = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
    a, z = a.tolist(), z.tolist()
    n_bytes, n_removed, n_spans, digest = [], [], [], []
    for k, text in enumerate(docs.column("text").to_pylist()):
        raw = text.encode()
        kept, at, runs = [], 0, 0
        for i in range(edge[k], edge[k + 1]):
            if a[i] > at or not runs:  # spans that touch are one run
                runs += 1
                kept.append(raw[at : a[i]])
            at = max(at, z[i])
        kept.append(raw[at:])
        left = b"".join(kept)
        n_bytes.append(len(raw))
        n_removed.append(len(raw) - len(left))
        n_spans.append(runs)
        digest.append(hashlib.sha256(left).hexdigest())
    return pa.table([ids_out(ids), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    n = buckets_for(docs)
    n_docs = prime_from(n)
    dealt = by_bucket(docs, n_docs)
    marks = dealt.drop("bucket").mapInArrow(lean(_send_marks(n, n_docs)), ROUTED)
    judged = marks.groupBy("bucket").applyInArrow(lean_group(_judge_marks(n_docs)), ROUTED)
    parts = dealt.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(lean_group(_send_parts(n)), ROUTED)
    spans = parts.groupBy("bucket").applyInArrow(lean_group(_compare()), ROUTED)
    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(lean_group(_remove), RESULT)
