"""Interpolated modified Kneser-Ney language model, counted in Spark.

The model is of order two: p(w | v) discounts the count of v w by modified Kneser-Ney discounts and
interpolates with the continuation probability of w, which in turn interpolates with the uniform
distribution over the vocabulary and one unknown word. A text's context begins with a start mark,
and its end is a token. (Order three needs about twice the disk that the check tool allows: nearly
every word triple of a corpus is distinct, at eight bytes each in one exchange.)

How it runs: the texts become blocks, tables of sorted word hashes and the tokens' places in them,
written once. Each block sends its distinct bigrams (64-bit hash, training count) to hash buckets,
whose reducers sum them into sorted hash arrays, the shards of the model; the shards are stored, and
each block gets the part of the model that it needs, in its own order. Words go the same way in a
second round, with the bigrams' types: each distinct bigram is counted by the one block that a shard
names as its owner. To score, a worker maps its block's part of the model from an unlinked file into
memory and looks n-grams up in the sorted arrays. All counts cover all training texts; a frequent
word or pair costs a shard one entry per block.

Tokens: texts with A-Z lower-cased, words of other than \\x20 and \\x09-\\x0D, and one end. A document
is held out of training if crc32(doc_id as text) mod 10 is 0. Defined cases: null is the empty text,
one token; a null id counts as the empty text for crc32 and is held out; repeated rows count and are
scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, mix, slices
from .common import buckets_for, lean, lean_group, narrow, pack, scratch, scratch_bucketed, unpack

BLOCK_BYTES = 12 << 20
#: Buckets that a code tells apart.
MAX_CODED = 1 << 16
HELD_OUT_OF = 10
SMOOTH = 0.1
END, START = np.uint64(0x6C62272E07BB0142), np.uint64(0xB5297A4D3F84D5A1)
_PAIR = np.uint64(0x9FB21C651E98DF25)
SENT = "bucket long, target long, payload binary, sums array<long>"
_SENT = pa.schema([("bucket", pa.int64()), ("target", pa.int64()), ("payload", pa.binary()), ("sums", pa.list_(pa.int64()))])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Discounts where the counts of counts don't give any (tiny corpora).
FALLBACK = (0.5, 1.0, 1.5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT.types)], schema=_SENT)


def codes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes as codes that sort by bucket, then by 48 bits of the hash. A bucket's size doesn't
    grow with the corpus (the number of buckets does), so 48 bits keep telling its entries apart."""
    return (((h & np.uint64(0xFFFFFF)) % np.uint64(n)) << np.uint64(48)) | (h >> np.uint64(16))


def planes(x: np.ndarray) -> list[np.ndarray]:
    """Non-negative whole numbers as one array for each byte, the lowest first; high bytes that are
    zero throughout are left out, and those that are mostly zero compress well."""
    top = int(x.max()) if len(x) else 0
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(raw[:, k]) for k in range(max(1, (top.bit_length() + 7) // 8))]


def from_planes(p: list[np.ndarray]) -> np.ndarray:
    raw = np.zeros((len(p[0]), 8), np.uint8)
    for k, x in enumerate(p):
        raw[:, k] = x
    return raw.view("<u8").reshape(-1).astype(np.uint64)


def _keyed(key: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted distinct keys, as steps in byte planes, and columns along them."""
    step = np.diff(key, prepend=np.uint64(0))
    p = planes(step)
    return pack(*columns, *p, np.zeros(len(p), np.uint8))


def _unkeyed(payload: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    cols = unpack(payload)
    n = len(cols[-1])
    return np.cumsum(from_planes(cols[-1 - n : -1]), dtype=np.uint64), cols[: -1 - n]


def _by_bucket(code: np.ndarray, n: int):
    """(bucket, slice) of sorted codes for each bucket that has any."""
    edges = np.searchsorted(code, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


def make_blocks(docs: DataFrame) -> DataFrame:
    """block and payload: word hashes, the frequent first, each token's place in them, tokens and
    ids of the documents, and which are held out. The table is bucketed by block, so that no later
    step moves a block."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column("doc_id")
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held = b.column("held").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(b.column("text"), BLOCK_BYTES):
                w = Words(data, offsets, fold=True)
                size = w.counts + 1
                ends = np.cumsum(size) - 1
                token = np.empty(int(size.sum()), np.uint64)
                is_word = np.ones(len(token), bool)
                is_word[ends] = False
                token[ends] = END
                token[is_word] = w.hashes()
                words, place, count = np.unique(token, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                payload = pack(words[order], narrow(size), ids[lo:hi], held[lo:hi].astype(np.uint8), null[lo:hi].astype(np.uint8), *planes(rank[place]))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([payload], pa.binary())], names=["block", "payload"])
                seq += 1

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD_OUT_OF)) == 0
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held"))
    return scratch_bucketed(cut.mapInArrow(lean(run), "block long, payload binary"), "blocks", "block", min(MAX_CODED, buckets_for(docs)))


class Block:
    """A block's tokens, and its distinct bigrams in the order of their codes."""

    def __init__(self, payload: bytes, n: int):
        words, size, self.ids, held, null, *place = unpack(payload)
        place = from_planes(place)
        self.null, self.held = null.astype(bool), held.astype(bool)
        self.size = size.astype(np.int64)
        self.words = np.concatenate([words, np.array([START])])  # the start mark comes last
        self.place = place.astype(np.int64)
        first = np.cumsum(self.size) - self.size
        before = np.empty(len(place), np.int64)
        before[1:] = self.place[:-1]
        before[first] = len(words)
        self.before = before
        self.train = np.repeat(~self.held, self.size)
        pair, index = np.unique(before * len(self.words) + self.place, return_inverse=True)
        context, word = np.divmod(pair, len(self.words))
        key = codes(mix(self.words[context] * _PAIR + self.words[word]), n)
        order = np.argsort(key)
        self.key, self.context, self.word = key[order], context[order], word[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[index]  # each token's bigram
        self.pair_count = np.bincount(self.pair[self.train], minlength=len(key))
        self.word_count = np.bincount(self.place[self.train], minlength=len(self.words))
        self.word_count[-1] = int((~self.held).sum())  # as a context: training texts
        self.word_key = codes(self.words, n)
        self.by_key = np.argsort(self.word_key)


def _answers(table: pa.Table | pa.RecordBatch) -> list[tuple[int, list[np.ndarray]]]:
    return sorted(((b, unpack(p.as_py())) for b, p in zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True)), key=lambda x: x[0])


def _joined(answers: list[tuple[int, list[np.ndarray]]], column: int) -> np.ndarray:
    """A column of the answers, which follow the sorted codes that were asked about."""
    return np.concatenate([a[column] for _, a in answers]).astype(np.int64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    if min(n[:4]) <= 0:
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 < x < k + 1 for k, x in enumerate(d)) else FALLBACK


def _tally(columns: int, what):
    """Sums entries by key into a sorted hash array and answers every sender in its own order.
    what(keys, sums) gives the numbers that are summed up over all shards."""

    def run(key, group):
        bucket = key[0].as_py()
        parts = [_unkeyed(p.as_py()) for p in group.column("payload")]
        target = group.column("target").to_pylist()
        keys = np.concatenate([k for k, _ in parts])
        shard, index = np.unique(keys, return_inverse=True)
        sums = [np.bincount(index, np.concatenate([c[k] for _, c in parts]), len(shard)).astype(np.int64) for k in range(columns)]
        trained = np.flatnonzero(np.concatenate([c[0] for _, c in parts]) > 0)
        owner = np.zeros(len(keys), bool)
        owner[trained[np.unique(index[trained], return_index=True)[1]]] = True
        rows, lo = [], 0
        for t, (k, _) in zip(target, parts, strict=True):
            hi = lo + len(k)
            rows.append((bucket, t, pack(*(narrow(s[index[lo:hi]]) for s in sums), owner[lo:hi].astype(np.uint8)), None))
            lo = hi
        seen = sums[0] > 0
        rows.append((bucket, -1, _keyed(shard[seen], *(narrow(s[seen]) for s in sums)), what(shard, sums, bucket)))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _bigram_numbers(keys, sums, bucket) -> list[int]:
    return [*_of_counts(sums[0]), int((sums[0] > 0).sum())]


def _word_numbers(n: int):
    start = int(codes(np.array([START]), n)[0])

    def numbers(keys, sums, bucket) -> list[int]:
        real = keys != np.uint64(start & ((1 << 48) - 1)) if bucket == start >> 48 else np.ones(len(keys), bool)
        c, cont = sums[0][real], sums[4][real]
        return [int(c.sum()), int((c > 0).sum()), *_of_counts(cont), int((cont >= 3).sum()), int(cont.sum())]

    return numbers


def _totals(answers: DataFrame, n: int) -> list[int]:
    row = answers.filter("target = -1").agg(*(F.sum(F.col("sums")[k]) for k in range(n))).first()
    return [x or 0 for x in row]


def _mapped(*columns: np.ndarray) -> list[np.ndarray]:
    """The arrays as read-only memory maps of a file without a name: the system may drop and reread
    their pages, and nothing is left behind."""
    out = []
    with tempfile.TemporaryFile() as f:
        places = []
        for c in columns:
            f.seek((-f.tell()) % 64, 1)
            places.append(f.tell())
            f.write(np.ascontiguousarray(c).tobytes())
        f.write(b"\0" * 64)
        f.flush()
        for c, at in zip(columns, places, strict=True):
            out.append(np.memmap(f, c.dtype, "r", at, (len(c),)) if len(c) else c)
    return out


_KEY = np.uint64((1 << 48) - 1)


def _send_bigrams(n: int):
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                b = Block(payload.as_py(), n)
                rows = [(k, block, _keyed(b.key[at] & _KEY, narrow(b.pair_count[at])), None) for k, at in _by_bucket(b.key, n)]
                if rows:
                    yield _rows(rows)

    return run


def _send_words(n: int):
    def run(key, blocks, answers):
        rows = []
        for block, payload in zip(blocks.column("block").to_pylist(), blocks.column("payload"), strict=True):
            b = Block(payload.as_py(), n)
            got = _answers(answers)
            total, own = _joined(got, 0), _joined(got, 1) > 0
            size = len(b.words)
            types = [np.bincount(b.context[own & t], minlength=size) for t in (total == 1, total == 2, total >= 3)]
            cont = np.bincount(b.word[own], minlength=size)
            columns = [c[b.by_key] for c in (b.word_count, *types, cont)]
            code = b.word_key[b.by_key]
            for k, at in _by_bucket(code, n):
                rows.append((k, block, _keyed(code[at] & _KEY, *(narrow(c[at]) for c in columns)), None))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _score(n: int, d2: tuple, d1: tuple, numbers: list[int]):
    train_tokens, vocabulary, m1, m2, _, _, m3, types = numbers

    def run(key, blocks, pairs):
        out = []
        kinds = pairs.column("kind").to_numpy(zero_copy_only=False)
        bigrams, words = (_answers(pairs.filter(pa.array(kinds == k))) for k in (0, 1))
        for payload in blocks.column("payload"):
            b = Block(payload.as_py(), n)
            # this block's part of the model: sorted hash arrays, mapped
            pair_hash, pair_total, word_hash, *stats = _mapped(b.key, _joined(bigrams, 0), b.word_key[b.by_key], *(_joined(words, k) for k in range(5)))
            c, n1, n2, n3, cont = (np.asarray(x) for x in stats)
            t = float(max(types, 1))
            lower_gamma = (d1[0] * m1 + d1[1] * m2 + d1[2] * m3) / t if types else 1.0
            lower = np.maximum(cont - np.choose(np.minimum(cont, 3), (0.0, *d1)), 0.0) / t + lower_gamma / (vocabulary + 1)
            gamma = np.where(c > 0, (d2[0] * n1 + d2[1] * n2 + d2[2] * n3) / np.maximum(c, 1), 1.0)
            seen = pair_total[np.searchsorted(pair_hash, b.key)][b.pair]
            entry = np.searchsorted(word_hash, b.word_key)  # where each of the block's words stands
            context, word = entry[b.before], entry[b.place]
            higher = np.maximum(seen - np.choose(np.minimum(seen, 3), (0.0, *d2)), 0.0) / np.maximum(c[context], 1)
            p = higher + gamma[context] * lower[word]
            base = np.log10((c[word] + SMOOTH) / (train_tokens + SMOOTH * (vocabulary + 1)))
            first = np.cumsum(b.size) - b.size
            sums = [np.add.reduceat(x, first) for x in ((c[word] > 0).astype(np.int64), base, np.log10(p))] if len(first) else [np.zeros(0)] * 3
            out.append(
                pa.table(
                    [pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.held), pa.array(b.size), pa.array(sums[0], pa.int64()), pa.array(np.full(len(first), train_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def count_model(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The blocks, and the two rounds' tables: rows with a target are a block's part of the model,
    those with target -1 are the model's shards (sorted hashes, counts)."""
    n = min(MAX_CODED, buckets_for(docs))
    blocks = make_blocks(docs)
    sent = blocks.mapInArrow(lean(_send_bigrams(n)), SENT)
    bigrams = scratch(sent.groupBy("bucket").applyInArrow(lean_group(_tally(1, _bigram_numbers)), SENT), "bigrams")
    mine = lambda df: df.filter("target >= 0").groupBy("target")
    sent = blocks.groupBy("block").cogroup(mine(bigrams)).applyInArrow(lean_group(_send_words(n)), SENT)
    words = scratch(sent.groupBy("bucket").applyInArrow(lean_group(_tally(5, _word_numbers(n))), SENT), "words")
    return blocks, bigrams, words, n


def score(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    blocks, bigrams, words, n = count_model(docs)
    of_bigrams, of_words = _totals(bigrams, 5), _totals(words, 8)
    parts = bigrams.withColumn("kind", F.lit(0)).unionByName(words.withColumn("kind", F.lit(1))).filter("target >= 0").select("target", "bucket", "kind", "payload")
    return blocks.groupBy("block").cogroup(parts.groupBy("target")).applyInArrow(lean_group(_score(n, _discounts(of_bigrams), _discounts(of_words[2:6]), of_words)), RESULT)
