"""Near duplicates by MinHash and a signature-coordinate inverted join.

A document is the set of its distinct five-word shingles (lower case A-Z; with fewer words, the
whole sequence). Documents with equal sets form a class, which is one document from then on. A
class is posted under its signature's coordinate-value pairs. Two sets of the wanted similarity,
percent / 100, agree in at least matches(percent) of the COORDINATES coordinates (the chance to fall
short, at exactly that similarity, is no more than MISSED), and two signatures that agree in m
share one of any COORDINATES - m + 1 coordinates. So only that prefix is posted: for each class its pairs
with the shortest posting lists, which skips the lists that a common passage makes long.

Lists are merged without forming all pairs in a group: first every list's members are compared
with a few leaders, drawn per list by a hash, and what is linked is united; a list within one
component is done. Of the other lists only pairs across components remain to be formed.
Where a list is still long, as texts mostly of one common passage make it, its members are posted
under shingles instead, by the prefix that the wanted similarity leaves: the n - ceil(percent n / 100) + 1
shingles that fewest of these members hold, which for such texts lie outside of the passage. A link
that is never compared lies within a component that other links hold together already.

What such a list's members differ in is bounded before any pair is formed, by two bounds that no
link fails: the first common shingle's places in both orders (what comes before it is not shared),
and the parities of a set's shingles in BITS bins (as many shingles differ as parities do). So of
texts that stand just below the wanted similarity to many others, few become pairs.

Every comparison counts the collisions of the two signatures first, and is then confirmed on the
full sets: 100 * intersection >= percent * union.

Defined cases: a document without words has an empty set, no links and itself as component; null
ids count as smaller than any other; repeated rows and ids keep their rows; an empty table gives an
empty result; other columns are not read, and near_unique() leaves them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Words, grams, mix, slices
from .common import BUCKET_BYTES, MAX_BUCKETS, MIN_BUCKETS, NO_ID, PACKED, bucket_of, deal, forget, forget_since, lean, lean_group, made, narrow, pack, packed_batch, scratch, size_hint, unpack
from .components import components

SHINGLE = 5
#: Percent of the union that two sets share at least, unless a caller says otherwise.
PERCENT = 85
COORDINATES = 64
#: Highest chance that a pair of exactly the wanted similarity agrees in too few coordinates.
MISSED = 1e-9
#: Lists of more members are not paired off by coordinates, but by their rarest shingles.
LONG_LIST = 64
#: Leaders that all members of a list are compared with before the rest is paired off.
LEADERS = 2
#: Lists are of so many kinds; those of one kind draw by the same hash, so that lists of nearly the
#: same members mostly have the same leaders and their pairs coincide.
KINDS = 4
#: Bytes of sets that a pair of blocks of classes holds on average while pairs are compared.
GROUP_BYTES = 8 << 20
#: Bins whose parities follow a signature, and the 32-bit words that they take.
BITS = 1024
WORDS = COORDINATES + BITS // 32

_draw = np.random.Generator(np.random.PCG64(7))
_A = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def matches(percent: int) -> int:
    """The most coordinates to ask for at that similarity, by the binomial tail."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISSED:
            return k
    return COORDINATES


def shingle_sets(text: pa.Array):
    """(row, sorted distinct shingle hashes) of each text with words."""
    for lo, hi, data, offsets in slices(text):
        w = Words(data, offsets, fold=True)
        h = w.hashes()
        g = grams(h, SHINGLE)
        for k in np.flatnonzero(w.counts).tolist():
            a, b = w.first[k], w.first[k + 1]
            if b - a >= SHINGLE:
                yield lo + k, np.unique(g[a : b - SHINGLE + 1])
            else:
                yield lo + k, mix(grams(h[a:b], int(b - a)) + np.uint64(b - a))


def names(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed numbers."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64).view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima; a long set is worked on in pieces."""
    out = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for lo in range(0, len(s), 4096):
        part = (s[None, lo : lo + 4096] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        np.minimum(out, part.min(axis=1), out=out)
    return out.astype(np.uint32)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each of BITS bins, by the hashes' top bits, holds an odd number of the set."""
    odd = np.bincount((s >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit name of the set) and signature, followed by the
    parities, of every document."""

    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            f = np.zeros((2, b.num_rows), np.int64)
            sig: list[bytes | None] = [None] * b.num_rows
            for row, s in shingle_sets(b.column("text")):
                n[row] = len(s)
                f[:, row] = names(s)
                sig[row] = signature(s).tobytes() + parities(s).tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(f[0]), pa.array(f[1]), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "signature"])

    cut = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut.mapInArrow(lean(run), "doc_id long, n_shingles long, f1 long, f2 long, signature binary")


def _postings(classes: DataFrame) -> DataFrame:
    """c, v and cls of all coordinates of each class."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, WORDS)[:, :COORDINATES].ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(COORDINATES, dtype=np.int64) << 32, b.num_rows) | sig.astype(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(), COORDINATES))], names=["post", "cls"]
            )

    return classes.select("cls", "signature").mapInArrow(lean(run), "post long, cls long")


def _sets(b: pa.RecordBatch):
    """(class, its set) of a batch of texts. Where ids repeat, a representative's id has other texts
    too; they are told by the names of their sets."""
    cls, g1, g2 = (b.column(k).to_numpy() for k in ("cls", "f1", "f2"))
    for row, s in shingle_sets(b.column("text")):
        if names(s) == (g1[row], g2[row]):
            yield int(cls[row]), s


def _whole_sets(batches):
    for b in batches:
        found = list(_sets(b))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["own", "shingles"])


def _confirmed(pairs: DataFrame, posted: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a - b those whose sets are similar enough, as a scratch table."""
    sig, least = posted.select("cls", "signature", "n_shingles"), matches(percent)

    def collide(batches):
        for b in batches:
            n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, WORDS) for k in ("sa", "sb"))
            apart = np.bitwise_count(x[:, COORDINATES:] ^ y[:, COORDINATES:]).sum(axis=1, dtype=np.int64)
            ok = ((x[:, :COORDINATES] == y[:, :COORDINATES]).sum(axis=1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            ok &= 100 * (n + m - apart) >= percent * (n + m + apart)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(n + m)], names=["a", "b", "held"]).filter(pa.array(ok))

    ends = lambda end: sig.select(F.col("cls").alias(end), F.col("signature").alias(f"s{end}"), F.col("n_shingles").alias(f"n{end}"))
    both = pairs.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    near = scratch(both.mapInArrow(lean(collide), "a long, b long, held long"), "near")
    full = texts.join(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi").mapInArrow(lean(_whole_sets), "own long, shingles binary")
    # Pairs are compared by pairs of blocks of classes, so many that one holds GROUP_BYTES of sets on
    # average. A class goes to a pair of blocks once, however many of its pairs fall there.
    held = near.agg(F.sum("held")).first()[0] or 0
    blocks = max(1, math.ceil(math.sqrt(8 * held / GROUP_BYTES)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = near.select("a", "b", block("a").alias("x"), block("b").alias("y"))
    needed = near.select(F.explode(F.array("a", "b")).alias("cls"), block("a").alias("u"), block("b").alias("v")).distinct()
    needed = needed.join(full, F.col("cls") == F.col("own")).select("u", "v", "cls", "shingles")

    def compare(key, pairs, sets):
        held = {c: np.frombuffer(v.as_buffer(), np.uint64) for c, v in zip(sets.column("cls").to_pylist(), sets.column("shingles"), strict=True)}
        ok = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = held.get(a), held.get(b)
            if x is None or y is None:
                ok.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            ok.append(100 * same >= percent * (len(both) - same))
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = scratch(placed.groupBy("x", "y").cogroup(needed.groupBy("u", "v")).applyInArrow(lean_group(compare), "a long, b long"), "links")
    forget(near)
    return out


def _led(members: DataFrame) -> DataFrame:
    """Pairs of each list's members with its leaders: linear in the members."""
    kind = F.pmod(F.xxhash64("post"), F.lit(KINDS))
    part = F.pmod(F.xxhash64("cls", kind), F.lit(LEADERS))
    drawn = F.struct(F.xxhash64(kind, "cls"), "cls")
    leads = members.groupBy("post").agg(F.array(*(F.min(F.when(part == k, drawn))["cls"] for k in range(LEADERS))).alias("_l"))
    led = members.join(leads, "post").select("cls", F.explode("_l").alias("lead")).filter("lead != cls")
    return led.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()


def _open_lists(members: DataFrame, united: DataFrame | None, key: str) -> DataFrame:
    """The members, with comp (their component), of lists that lie in more than one component, and of
    each list its size and main (the component of most members), as a scratch table."""
    own = F.col("cls")
    if united is not None:
        members = members.join(united.select(F.col("node").alias("cls"), "component"), "cls", "left")
        own = F.coalesce("component", "cls")
    m = members.withColumn("comp", own).drop("component")
    lists = m.groupBy(key, "comp").agg(F.count("*").alias("_n")).groupBy(key).agg(F.sum("_n").alias("size"), F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.count("*").alias("_comps"))
    return scratch(m.join(lists.filter("_comps > 1").drop("_comps"), key), "open")


def _paired(opened: DataFrame) -> DataFrame:
    """Pairs of members of different components that share a list."""
    x, y = (opened.select("post", F.col("cls").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
    return x.join(y, "post").filter("a < b and ca != cb").select("a", "b")


def _parities(classes: DataFrame) -> DataFrame:
    """cls and the parities, as numbers p0, p1 ..., of each class."""
    n = BITS // 64

    def run(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, WORDS)[:, COORDINATES:]
            p = np.ascontiguousarray(p).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cls"), *(pa.array(p[:, k]) for k in range(n))], names=["cls", *(f"p{k}" for k in range(n))])

    return classes.select("cls", "signature").mapInArrow(lean(run), "cls long, " + ", ".join(f"p{k} long" for k in range(n)))


def _bounded_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """Pairs of members, with their parities, of different components that share a rare shingle and that neither bound
    rules out: a link passes both at the first shingle that its two ends share. One end of a pair
    lies outside of the list's largest component, so only such members are held against the list."""
    columns = ["cls", "comp", "at", "held", *(f"p{k}" for k in range(BITS // 64))]
    x = opened.filter("comp != main").select("shingle", *(F.col(c).alias(f"a_{c}") for c in columns))
    y = opened.select("shingle", "main", *(F.col(c).alias(f"b_{c}") for c in columns))
    total = F.col("a_held") + F.col("b_held")
    most = F.least(F.col("a_held") - F.col("a_at"), F.col("b_held") - F.col("b_at"))
    apart = sum((F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(BITS // 64)), F.lit(0))
    near = (100 * most >= percent * (total - most)) & (100 * (total - apart) >= percent * (total + apart))
    once = (F.col("b_comp") == F.col("main")) | (F.col("a_cls") < F.col("b_cls"))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("a_comp") != F.col("b_comp")) & once & near)
    return pairs.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b"))


def _rare_shingles(texts: DataFrame, percent: int, n: int) -> DataFrame:
    """shingle and cls of the prefix of each class's set, in order of rarity among these classes, with
    the shingle's place (at, from 0) in that order and the size of the set (held). Shingles are
    counted in packed form, and only those of several classes go back to their classes: the others
    come first in the order, and no list of one is made."""

    def send(batches):
        for b in batches:
            found = list(_sets(b))
            if not found:
                continue
            s = np.concatenate([x for _, x in found])
            size = np.array([len(x) for _, x in found], np.uint32)
            owner = np.repeat(np.arange(len(found)), size)
            cls = np.array([c for c, _ in found], np.int64)
            rows = []
            for k, (s1, o1) in deal(bucket_of(s, n), n, s, owner):
                used, index = np.unique(o1, return_inverse=True)
                rows.append((k, pack(s1, cls[used], size[used], narrow(index))))
            yield packed_batch(rows)

    def count(group: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py()) for p in group.column("payload")]
        s, c, held = (np.concatenate(x) for x in zip(*((s, c[i], z[i]) for s, c, z, i in parts), strict=True))
        order = np.lexsort((c, s))
        s, c, held = s[order], c[order], held[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])  # a class may come twice where ids repeat
        s, c, held = s[new], c[new], held[new]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        g = np.cumsum(first) - 1
        many = np.bincount(g)[g]
        several = many > 1
        rows = [(k, pack(c1, s1, narrow(m1), narrow(h1))) for k, (c1, s1, m1, h1) in deal(np.mod(c[several], n), n, c[several], s[several], many[several], held[several])]
        return pa.Table.from_batches([packed_batch(rows)])

    def rank(group: pa.Table) -> pa.Table:
        parts = [[x.astype(np.int64) if x.dtype != np.uint64 else x for x in (c, s, m.astype(np.int64), h.astype(np.int64))] for c, s, m, h in (unpack(p.as_py()) for p in group.column("payload"))]
        c, s, many, held = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, many, c))
        c, s, held = c[order], s[order], held[order]
        first = np.ones(len(c), bool)
        first[1:] = c[1:] != c[:-1]
        start, g = np.flatnonzero(first), np.cumsum(first) - 1
        at = held - np.bincount(g)[g] + np.arange(len(c)) - start[g]  # after those that no other class holds
        ok = at <= held - -(-held * percent // 100)
        return pa.table([pa.array(s[ok].view(np.int64)), pa.array(c[ok]), pa.array(at[ok]), pa.array(held[ok])], names=["shingle", "cls", "at", "held"])

    counted = texts.mapInArrow(lean(send), PACKED).groupBy("bucket").applyInArrow(lean_group(count), PACKED)
    return counted.groupBy("bucket").applyInArrow(lean_group(rank), "shingle long, cls long, at long, held long")


def _posted(classes: DataFrame, docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes that have a prefix, and the texts of their representatives, as scratch tables:
    only they are read and dealt from here on."""
    posted = scratch(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "posted")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return posted, scratch(own.join(posted.select("rep", "cls", "f1", "f2"), "rep").select("cls", "f1", "f2", "text"), "texts")


def links(classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """node and component of the classes that links unite; None if there are no links."""
    posts = _postings(classes)
    lists = posts.groupBy("post").agg(F.count("*").alias("n")).filter("n > 1")
    # coordinates that no other class shares are a class's shortest lists: they fill its prefix first
    per = Window.partitionBy("cls")  # at most COORDINATES rows each
    ranked = posts.join(lists, "post").withColumn("_rank", F.row_number().over(per.orderBy("n", "post"))).withColumn("_shared", F.count("*").over(per))
    members = scratch(ranked.filter(F.col("_rank") <= F.col("_shared") - matches(percent) + 1).select("post", "cls"), "members")
    posted, texts = _posted(classes, docs, members)
    united = _unite(None, _confirmed(_led(members), posted, texts, percent))
    opened = _open_lists(members, united, "post")
    pairs = _paired(opened.filter(F.col("size") <= LONG_LIST))
    in_long = opened.filter(F.col("size") > LONG_LIST)
    if not in_long.isEmpty():
        wanted = in_long.select("cls").distinct()
        # a shingle takes 12 bytes where it is counted, a word of text on average 6, half that compressed
        n = int(min(MAX_BUCKETS, max(MIN_BUCKETS, 4 * size_hint(texts) // BUCKET_BYTES)))
        rare = _rare_shingles(texts.join(wanted, "cls", "left_semi"), percent, n).join(_parities(posted), "cls")
        pairs = pairs.unionByName(_bounded_pairs(_open_lists(rare, united, "shingle"), percent))
    return _unite(united, _confirmed(pairs.distinct(), posted, texts, percent))


def _unite(united: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """The components with the new links a - b."""
    if new.isEmpty():
        return united
    if united is not None:
        new = new.unionByName(united.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(new)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every document."""
    mark = made()
    s = scratch(signed(docs), "signatures")
    key = ["f1", "f2", "n_shingles"]
    classes = scratch(s.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")).withColumn("cls", F.xxhash64(*key)), "classes")
    united = links(classes, docs, percent)
    named = classes.select(*key, "cls", "rep")
    kept = [s, classes]
    if united is not None:
        of = scratch(named.select("cls", "rep").join(united.withColumnRenamed("node", "cls"), "cls"), "of")
        kept.append(of)
        first = of.groupBy("component").agg(F.min("rep").alias("first"))
        named = named.join(of.join(first, "component").select("cls", "first"), "cls", "left").withColumn("rep", F.coalesce("first", "rep"))
    forget_since(mark, *kept)
    named = named.select(*key, "rep")
    own = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    out = s.select("doc_id", *key).join(named, key, "left").select(F.col("doc_id"), "n_shingles", own.alias("component_id"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_unique(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, as they are, of one document of each component: the one of the least id.
    Rows that share an id are one document here: they stay or go together."""
    mark = made()
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_quillmill_gone")).distinct()
    gone = scratch(gone, "gone")  # a table: broadcast only if small
    forget_since(mark, gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_quillmill_gone"]), "left_anti")
