"""Compression of vectors to codes: one codebook for each part of a vector, in whole numbers.

Components become floor(4096 * x); a vector is cut into equal parts, and each part is named by the
nearest entry of its position's codebook (squared Euclidean distance, ties to the lower index). A pass
over all vectors assigns them and sums them by entry; only these sums, some thousand numbers whatever
the table's size, come to the driver, which takes the means and starts the next pass.

The nearest entry is found from coarse to fine. A part is described by the sums of its 1, 2, 4, ...
blocks and by what is left of its norm beside the block means. By the triangle inequality

    |x - y|^2  >=  sum over blocks of (sum(x_b) - sum(y_b))^2 / |b|  +  (rest(x) - rest(y))^2

so an entry whose bound is over the exact distance of one entry already seen can't be the nearest, nor
tie with it. The bound is rounded down by more than floats can err; survivors of the finest level get
exact integer distances. All that is exact is a 64-bit integer where the numbers allow it and a Python
integer where they don't, so components of any finite size give right results.

Defined cases: a null vector, one with a null or non-finite component, and one whose length isn't that
of the kept vector with the smallest id (which must be a multiple of the number of parts) are dropped; a null id counts as smaller than any other, and
rows that share an id are ordered by their vectors; repeated rows each keep their row; equal entries
keep the lower index; nulls of label are one label; a table without kept vectors gives an empty result;
errors beyond 2^63 - 1 are given as that; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components up to this size are worked on in 64 bits.
SMALL = 1 << 24
#: Sums travel in limbs of so many bits, so that numbers of any size add up in a long.
LIMB = 40
MOST = (1 << 63) - 1
#: Vectors compared at once.
ROWS = 4096
_HEX = np.frombuffer("".join(f"{k:02x}" for k in range(256)).encode(), np.uint8).reshape(256, 2)


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """entries[part][entry] is a tuple of the integers of that entry."""

    dim: int
    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats: int64, or Python integers where one is over SMALL."""
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    # a float's value is a fraction of whole numbers, so this is exact also where SCALE * x is no float
    out.ravel()[:] = [n * SCALE // d for n, d in (float(v).as_integer_ratio() for v in x.ravel())]
    return out


def blocks_of(width: int) -> list[np.ndarray]:
    """The starts of the blocks at each level: 1, 2, 4, ... blocks, as equal as they can be."""
    out, n = [], 1
    while n < width:
        out.append(np.array([k * width // n for k in range(n)]))
        n *= 2
    return out


class Bounds:
    """Block sums and residual norms of vectors at one level."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, x.shape[1]))
        sums = np.add.reduceat(x, starts, axis=1)
        squares = np.add.reduceat(x * x, starts, axis=1)
        rest = (size * squares - sums * sums).astype(np.float64)  # whole numbers, none below zero
        self.size, self.sums = size, sums.astype(np.float64)
        self.rest = np.sqrt((rest / size).sum(axis=1))

    def below(self, i: np.ndarray, other: Bounds, j: np.ndarray) -> np.ndarray:
        """For pairs of a row here and a row there, a number that their squared distance is not under."""
        a, b = self.sums[i], other.sums[j]
        gap = np.maximum(0, np.abs(a - b) - (np.abs(a) + np.abs(b)) * 2.0**-48)
        p, q = self.rest[i], other.rest[j]
        apart = np.maximum(0, np.abs(p - q) - (p + q) * 2.0**-40)
        return ((gap * gap / self.size).sum(axis=1) + apart * apart) * (1 - 2.0**-40)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, book: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest entry and their squared distance; and how many exact distances
    were taken beside the first of each row."""
    n, k = len(x), len(book)
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    first = np.zeros(n, np.int64)
    best = None
    for starts in levels:
        here, there = Bounds(x, starts), Bounds(book, starts)
        low = here.below(row, there, entry)
        if best is None:  # every row still has all entries: the least bound's is compared first
            first = low.reshape(n, k).argmin(axis=1)
            best = exact(x, book[first])
        keep = (low <= best[row].astype(np.float64) * (1 + 2.0**-40)) & (entry != first[row])
        row, entry = row[keep], entry[keep]
    if best is None:
        best = exact(x, book[first])
        row, entry = row[entry != 0], entry[entry != 0]
    d = exact(x[row], book[entry]) if len(row) else best[:0]
    at = np.concatenate([np.arange(n), row])
    d, e = np.concatenate([best, d]), np.concatenate([first, entry])
    order = np.lexsort((e, d, at)) if d.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], d[i], e[i])), np.int64)
    lead = order[np.concatenate([[True], np.diff(at[order]) > 0])] if n else order
    return e[lead], d[lead], len(row)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("embedding").flatten()
    return np.asarray(flat).reshape(batch.num_rows, dim)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector has finite components only."""
    bounded_batches(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is over all others
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("embedding")).filter(F.col("embedding").isNotNull() & finite)


def _whole(rows: DataFrame, dim: int) -> DataFrame:
    return rows.filter(F.size("embedding") == dim)


def _assigned(x: np.ndarray, books: Codebooks):
    """(part, entry and distance of each row, for each part) of vectors as floats."""
    n_parts = len(books.entries)
    width = books.dim // n_parts
    v = integers(x)
    for p in range(n_parts):
        book = np.array(books.entries[p], object).reshape(-1, width)
        part = v[:, p * width : (p + 1) * width]
        top = max(map(abs, book.ravel().tolist()))
        if part.dtype == np.int64 and max(top, int(np.abs(part).max(initial=0))) < (1 << 30) // width:
            yield p, part, *nearest(part, book.astype(np.int64), blocks_of(width))[:2]  # no sum of squares leaves 64 bits
        else:
            part = part.astype(object)
            yield p, part, *nearest(part, book, [])[:2]  # beyond what floats can bound: all distances


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> how many parts are nearest to it, and their sums by component."""
    n_parts, width = len(books.entries), books.dim // len(books.entries)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = _vectors(b, books.dim)
            for lo in range(0, len(x), ROWS):
                for p, part, entry, _ in _assigned(x[lo : lo + ROWS], books):
                    order = np.argsort(entry, kind="stable")
                    names, at = np.unique(entry[order], return_index=True)
                    added = np.add.reduceat(np.column_stack([np.ones(len(part), part.dtype), part])[order], at, axis=0)
                    for name, s in zip(names.tolist(), added, strict=True):
                        total[p, name] = total.get((p, name), 0) + s.astype(object)
        out = []
        for (p, name), s in total.items():
            for place, v in enumerate(s.tolist()):
                sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    out.append(((p * ENTRY_SPACE + name) * (width + 1) + place, limb, sign * (v & ((1 << LIMB) - 1))))
                    v, limb = v >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["place", "limb", "value"])

    got = rows.select("embedding").mapInArrow(lean(run), "place long, limb int, value long").groupBy("place", "limb").agg(F.sum("value").alias("value"))
    flat: dict[int, int] = {}
    for r in got.collect():  # entries x (width + 1) numbers, of a limb or two each
        flat[r.place] = flat.get(r.place, 0) + (r.value << (LIMB * r.limb))
    return {(p, e): (c, [flat.get(base + 1 + k, 0) for k in range(width)]) for p in range(n_parts) for e in range(len(books.entries[p])) if (c := flat.get(base := (p * ENTRY_SPACE + e) * (width + 1), 0))}


ENTRY_SPACE = 1 << 16  # entries of a codebook at most; codes of 256 and over aren't two digits


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None if there is none."""
    order = [F.col("vec_id").asc_nulls_first(), F.col("embedding")]
    lead = rows.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).orderBy(*order).select(F.size("embedding").alias("dim")).first()
    if lead is None:
        return None
    dim = lead.dim
    seeds = integers(np.array([r.embedding for r in _whole(rows, dim).orderBy(*order).limit(entries).select("embedding").collect()])).tolist()
    w = dim // parts
    return Codebooks(dim, tuple(tuple(tuple(int(c) for c in s[p * w : (p + 1) * w]) for s in seeds) for p in range(parts)))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all kept vectors; None without any."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = kept(vectors)
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        sums = _sums(_whole(rows, books.dim), books)
        after = tuple(tuple(tuple(s // sums[p, e][0] for s in sums[p, e][1]) if (p, e) in sums else entry for e, entry in enumerate(book)) for p, book in enumerate(books.entries))
        if after == books.entries:  # the rounds left would change nothing either
            break
        books = Codebooks(books.dim, after)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every kept vector."""

    def run(batches):
        for b in batches:
            x = _vectors(b, books.dim)
            codes, errors = [], []
            for lo in range(0, len(x), ROWS):
                found = list(_assigned(x[lo : lo + ROWS], books))
                codes.append(_HEX[np.stack([e for _, _, e, _ in found], axis=1)].reshape(-1, 2 * len(found)))
                wide = any(d.dtype == object or (len(d) and d.max() > MOST // len(found)) for *_, d in found)
                errors += [min(int(v), MOST) for v in sum(d.astype(object) if wide else d for *_, d in found)]
            code = np.concatenate(codes) if codes else np.zeros((0, 2 * len(books.entries)), np.uint8)
            text = pa.StringArray.from_buffers(len(code), pa.py_buffer((np.arange(len(code) + 1) * code.shape[1]).astype(np.int32)), pa.py_buffer(code.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), text, pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    rows = _whole(kept(vectors), books.dim)
    return rows.mapInArrow(lean(run), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: the entries that each code names, at the vectors' own scale."""
    entry = lambda p: F.array(*(F.array(*(F.lit(float(c) / scale) for c in e)) for e in books.entries[p]))
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(entry(p), index(p)) for p in range(len(books.entries)))))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = scratch(encode(vectors, books), "codes")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = scratch(by_label.withColumnRenamed("label", "_label"), "labels")  # one row a label: joined by broadcast only if small
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
