"""The trie of conversation prefixes, by MSD radix partitioning over dictionary-encoded turns.

Every distinct (role, text) gets a number; a conversation is the sequence of its turns' numbers, kept
in rows of up to BLOCK turns. Equal conversations are one class. The classes of a bucket share a prefix;
a round of Spark joins its classes with their next turn's number and groups by it, so that each group
is a trie node and the next bucket. A bucket of at most LOCAL turns is dealt to a task with others of
its kind, where multikey quicksort orders what is left of its sequences and emits a node at each step
down the middle partition. A bucket of one class alone, however long, is a chain whose nodes come from
its rows of turns directly. What a node sums over its subtree comes with it from the task; for the nodes
of the rounds it is summed from the last round up.

A conversation's turns are numbered without bringing them together: they are sorted over all tasks,
numbered within each task, and moved by what earlier tasks hold of the same conversation. A digest over
a class's ids reads them as sorted texts of ranges of ids, in one pass that holds no list.

Defined cases: turns are ordered by turn (null first), ties and repeated rows by the first 16 bytes of
the SHA-256 of their role and text; null role or text counts as empty; rows without conv_id belong to
no conversation and are left out; h of a negative conv_id is that of its decimal text, and c - c % 20
goes towards zero; an empty table has no root and gives an empty result; other columns are not read.
Turns are told apart by 128 bits of SHA-256, whole conversations by length and 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, lean, lean_group, scratch, size_hint

FAMILY, HEAD = 20, 4
#: Turns of a row of turns; turns (in classes) of a bucket that a task finishes; bits of a range of ids.
BLOCK, LOCAL, ID_BITS = 1 << 10, 1 << 16, 12
#: Bytes of input for each task of a sort.
TASK_BYTES, MIN_TASKS = 16 << 20, 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [f.split()[0] for f in NODE.split(", ")]


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of role and text, with the role's length before them."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def _tasks(df: DataFrame) -> int:
    return max(MIN_TASKS, min(1 << 16, size_hint(df) // TASK_BYTES))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid, words) of every turn, pos from 0; (conv_id, n) of every conversation. turns:
    conv_id, turn, key, words."""
    # the dictionary: each distinct turn's number, and its words
    dictionary = scratch(turns.groupBy("key").agg(F.first("words").alias("words")).withColumn("tid", F.monotonically_increasing_id()), "turns")
    coded = turns.select("conv_id", "turn", "key").join(dictionary, "key")

    def run(batches):
        task, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = np.asarray(b.column("conv_id"))
            if not len(conv):
                continue
            new = np.flatnonzero(np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv))
            base = np.full(len(conv), -at)  # the first run goes on where the last batch ended
            if len(new):
                base[new[0] :] = np.repeat(new, np.diff(np.append(new, len(conv))))
            local = place - base
            last, at = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), task, np.int32)), pa.array(local), b.column("tid"), b.column("words")], names=["conv_id", "task", "local", "tid", "words"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = coded.repartitionByRange(_tasks(turns), *order).sortWithinPartitions(*order).select("conv_id", "tid", "words")
    placed = scratch(placed.mapInArrow(lean(run), "conv_id long, task int, local long, tid long, words long"), "placed")
    spans = scratch(placed.groupBy("conv_id", "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "spans")
    # a task's edge parts one conversation at most, so no more rows than tasks are moved; the table's
    # size decides how it is joined
    moved = scratch(spans.filter("before > 0").select("conv_id", "task", "before"), "moved")
    out = placed.join(moved, ["conv_id", "task"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "words")
    return out, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, tid, words) of the rebuilt conversations, depth from 1; (conv_id, m) with their
    lengths. The first h turns of conversation c - c % family come before c's own after its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head))
    info = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("lead"))
    leads = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("lead"), F.col("n").alias("lead_n"))
    info = info.join(leads, "lead", "left")  # a lead has 2 * family - 1 conversations at most
    info = scratch(info.select("conv_id", "n", "h", "lead", F.least("h", F.coalesce("lead_n", F.lit(0))).alias("taken")), "convs")
    own = turns.join(info, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "tid", "words")
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < head - 1)).select(F.col("conv_id").alias("lead"), "pos", "tid", "words")
    copied = info.filter("taken > 0").select("conv_id", "lead", "taken").join(heads, "lead").filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "tid", "words")
    return own.unionByName(copied), info.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m"))


def rows_of_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, tids and words (arrays in order of depth), of up to `block` turns each."""
    cell = F.struct("depth", "tid", "words")
    grouped = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    return grouped.select("conv_id", "block", F.col("c.tid").alias("tids"), F.col("c.words").alias("words"))


def classes_of(lengths: DataFrame, seqs: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """rep (the smallest conv_id), m, k (how many) and sha (of the ids) of each class of equal sequences."""
    marks = seqs.groupBy("conv_id").agg(*(F.bit_xor(F.xxhash64(F.lit(s), "block", "tids")).alias(f"x{s}") for s in (1, 2)))
    named = lengths.join(marks, "conv_id", "left").select("conv_id", "m", F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"))
    name = ["m", "x1", "x2"]
    # ids are distinct, so a range gives a text of 2^bits ids at most; ranges are in order
    texts = named.groupBy(*name, F.shiftright("conv_id", bits).alias("range")).agg(F.min("conv_id").alias("first"), F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        now, digest, rep, k = None, None, None, 0
        for b in batches:
            out = []
            for key, first, n, ids in zip(zip(*(b.column(c).to_pylist() for c in name), strict=True), b.column("first").to_pylist(), b.column("k").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if key == now:
                    digest.update(b"," + ids.encode())
                    k += n
                else:
                    if now is not None:
                        out.append((rep, now[0], k, digest.hexdigest()))
                    now, digest, rep, k = key, hashlib.sha256(ids.encode()), first, n
            yield _batch(out, "rep m k sha")
        if now is not None:
            yield _batch([(rep, now[0], k, digest.hexdigest())], "rep m k sha")

    texts = texts.repartition(_tasks(lengths), *name).sortWithinPartitions(*name, "range").select(*name, "first", "k", "ids")
    return texts.mapInArrow(lean(run), "rep long, m long, k long, sha string")


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if "sha" in n else pa.int64()) for i, n in enumerate(names)], names=names)


# --- what a task finishes ---------------------------------------------------------------------


def quicksort_nodes(seqs: list[np.ndarray], words: list[np.ndarray], reps: list[int], counts: list[int], shas: list[str], depth: int, parent: int) -> list[tuple]:
    """The nodes at and below `depth` of sequences that begin at that depth, as rows of NODE in
    preorder. Three-way quicksort by the symbol at a depth; its middle partition is a node, and is
    ordered by the next symbol in turn. Sequences are distinct; where one is alone its nodes follow
    without any sorting."""
    nodes: list[list] = []
    above: list[int] = []  # a node's parent's place in nodes, or -1
    # (sequences, symbols done, place of the parent's node)
    todo = [(list(range(len(seqs))), 0, -1)]
    while todo:
        some, d, top = todo.pop()
        if not some:
            continue
        pivot = seqs[some[len(some) // 2]][d]
        less, same, more = [], [], []
        for i in some:
            x = seqs[i][d]
            (same if x == pivot else less if x < pivot else more).append(i)
        if more:
            todo.append((more, d, top))
        if less:
            todo.append((less, d, top))
        up = nodes[top][0] if top >= 0 else parent
        rep, n = min(reps[i] for i in same), sum(counts[i] for i in same)
        ends = next((i for i in same if len(seqs[i]) == d + 1), None)
        if len(same) == 1:  # a chain
            i = same[0]
            for e in range(d, len(seqs[i])):
                above.append(top)
                top = len(nodes)
                nodes.append([rep, depth + e, up, n, 0, 0, (n - 1) * int(words[i][e]), EMPTY_SHA])
                up = rep
            nodes[top][7] = shas[i]
            continue
        above.append(top)
        top = len(nodes)
        nodes.append([rep, depth + d, up, n, 0, 0, (n - 1) * int(words[same[0]][d]), EMPTY_SHA if ends is None else shas[ends]])
        todo.append(([i for i in same if i != ends], d + 1, top))
    for i in range(len(nodes) - 1, -1, -1):  # children stand behind their parents
        node = nodes[i]
        if not node[4]:
            node[5] = 1
        if (p := above[i]) >= 0:
            nodes[p][4] += 1
            nodes[p][5] += node[5]
            nodes[p][6] += node[6]
    return [tuple(n) for n in nodes]


def _finished(buckets: DataFrame, seqs: DataFrame, block: int, groups: int) -> DataFrame:
    """The nodes of local buckets. buckets: bucket, start (symbols done), parent, rep, m, k, sha."""
    # a bucket's rows of turns from the one with its first symbol on
    joined = buckets.join(seqs.withColumnRenamed("conv_id", "rep"), "rep").filter(F.col("block") >= F.floor(F.col("start") / block))
    joined = joined.withColumn("deal", F.pmod(F.xxhash64("bucket", "start"), F.lit(groups)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("start", "ascending"), ("bucket", "ascending"), ("rep", "ascending"), ("block", "ascending")]).combine_chunks()
        cols = {c: group.column(c).to_pylist() for c in ("bucket", "start", "parent", "rep", "block", "k", "sha")}
        tids, words = (group.column(c).combine_chunks() for c in ("tids", "words"))
        out, lo, n = [], 0, group.num_rows
        flat = [(np.asarray(a.values), np.asarray(a.offsets)) for a in (tids, words)]
        while lo < n:
            hi = lo
            seqs_, words_, reps, counts, shas = [], [], [], [], []
            while hi < n and (cols["start"][hi], cols["bucket"][hi]) == (cols["start"][lo], cols["bucket"][lo]):
                end = hi
                while end < n and cols["rep"][end] == cols["rep"][hi] and cols["start"][end] == cols["start"][hi] and cols["bucket"][end] == cols["bucket"][hi]:
                    end += 1
                skip = cols["start"][hi] - cols["block"][hi] * block
                for (values, at), into in zip(flat, (seqs_, words_), strict=True):
                    into.append(values[at[hi] + skip : at[end]].tolist())
                reps.append(cols["rep"][hi]), counts.append(cols["k"][hi]), shas.append(cols["sha"][hi])
                hi = end
            out += quicksort_nodes(seqs_, words_, reps, counts, shas, cols["start"][lo] + 1, cols["parent"][lo])
            lo = hi
        return pa.Table.from_batches([_batch(out, " ".join(_NODE))])

    cols = joined.select("deal", "bucket", "start", "parent", "rep", "block", "k", "sha", "tids", "words")
    return cols.groupBy("deal").applyInArrow(lean_group(run), NODE)


def _chains(alone: DataFrame, seqs: DataFrame, block: int) -> DataFrame:
    """The nodes of buckets of one class: start, parent, rep, m, k, sha. Rows of turns are worked on one
    by one; only their sums are brought in order."""
    rows = alone.join(seqs.withColumnRenamed("conv_id", "rep"), "rep").filter(F.col("block") >= F.floor(F.col("start") / block))
    skip = F.greatest(F.lit(0), F.col("start") - F.col("block") * block).cast("int")
    kept = lambda c: F.slice(c, skip + 1, F.size(c) - skip)
    rows = rows.select("rep", "m", "k", "sha", "start", "parent", "block", skip.alias("skip"), kept("words").alias("words"))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    after = F.sum(total).over(Window.partitionBy("rep", "start").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("after", F.coalesce(after, F.lit(0)))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                rest = r["after"] + np.cumsum(np.array(r["words"], np.int64)[::-1])[::-1]
                first = r["block"] * block + r["skip"] + 1
                for j, w in enumerate(rest.tolist()):
                    d, end = first + j, first + j == r["m"]
                    out.append((r["rep"], d, r["parent"] if d == r["start"] + 1 else r["rep"], r["k"], 0 if end else 1, 1, (r["k"] - 1) * w, r["sha"] if end else EMPTY_SHA))
            yield _batch(out, " ".join(_NODE))

    return rows.mapInArrow(lean(run), NODE)


# --- the rounds -------------------------------------------------------------------------------


def trie(classes: DataFrame, seqs: DataFrame, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """All nodes, as rows of NODE, of the classes (rep, m, k, sha) with their rows of turns."""
    classes = scratch(classes, "classes")
    sums = classes.agg(F.min("rep").alias("rep"), F.sum("k").alias("k"), F.max("m").alias("m"), F.sum("m").alias("turns")).first()
    if sums.rep is None:
        return classes.sparkSession.createDataFrame([], NODE)
    groups = max(8, -(-sums.turns // local))
    heads = "conv_id long, depth long, parent_conv_id long, n_convs long, words long, sha string"
    # the nodes of the rounds by depth, without what their subtrees sum up; the root is the first
    ended = classes.filter("m = 0").agg(F.max("sha").alias("sha"))
    rounds = [scratch(ended.select(F.lit(sums.rep).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(sums.k).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"), "sha"), "root")]
    finished: list[DataFrame] = []
    active = classes.filter("m > 0").select(F.lit(sums.rep).alias("bucket"), "rep", "m", "k", "sha")
    start = 0
    while start < sums.m:
        digit = seqs.filter(F.col("block") == start // block).select(F.col("conv_id").alias("rep"), F.get("tids", F.lit(start % block)).alias("tid"), F.get("words", F.lit(start % block)).alias("words"))
        stepped = scratch(active.join(digit, "rep"), "stepped")
        parts = stepped.groupBy("bucket", "tid").agg(F.min("rep").alias("name"), F.sum("k").alias("n_convs"), F.sum(F.col("m") - start).alias("turns"), F.count("*").alias("n_classes"), F.max("words").alias("words"), F.max(F.when(F.col("m") == start + 1, F.col("sha"))).alias("sha"))
        parts = scratch(parts, "parts")
        named = stepped.select("bucket", "tid", "rep", "m", "k", "sha").join(parts.select("bucket", "tid", "name", "n_classes", "turns"), ["bucket", "tid"])
        named = scratch(named.withColumn("kind", F.when(F.col("turns") <= local, "local").when(F.col("n_classes") == 1, "alone").otherwise("wide")), "named")
        kinds = {r.kind: r["count"] for r in named.groupBy("kind").count().collect()}
        if kinds.get("local"):
            one = named.filter("kind = 'local'").select(F.col("name").alias("bucket"), F.lit(start).cast("long").alias("start"), F.col("bucket").alias("parent"), "rep", "m", "k", "sha")
            finished.append(scratch(_finished(one, seqs, block, groups), "finished"))
        if kinds.get("alone"):
            one = named.filter("kind = 'alone'").select(F.lit(start).cast("long").alias("start"), F.col("bucket").alias("parent"), "rep", "m", "k", "sha")
            finished.append(scratch(_chains(one, seqs, block), "chains"))
        start += 1
        if not kinds.get("wide"):
            break
        wide = parts.filter((F.col("turns") > local) & (F.col("n_classes") > 1))
        rounds.append(scratch(wide.select(F.col("name").alias("conv_id"), F.lit(start).cast("long").alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", "words", "sha"), "round"))
        active = scratch(named.filter("kind = 'wide'").filter(F.col("m") > start).select(F.col("name").alias("bucket"), "rep", "m", "k", "sha"), "active")
    # from the last round up: what the children of a round's nodes sum up
    below: DataFrame | None = None
    done: list[DataFrame] = []
    for level in range(len(rounds) - 1, -1, -1):
        tops = [f.filter(F.col("depth") == level + 1).select("parent_conv_id", "n_leaves", "saved_tokens") for f in finished]
        if below is not None:
            tops.append(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        nodes = rounds[level]
        if tops:
            under = tops[0]
            for t in tops[1:]:
                under = under.unionByName(t)
            under = under.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(under, "conv_id", "left")
        else:
            nodes = nodes.withColumns({"n_children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        n = F.coalesce("n_children", F.lit(0))
        below = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", n.alias("n_children"), F.when(n == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
        below = scratch(below, "nodes")
        done.append(below)
    out = done[0]
    for d in done[1:] + finished:
        out = out.unionByName(d)
    return out


def prefix_trie(conversations: DataFrame, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    bounded_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    turns = scratch(turns.filter(F.col("conv_id").isNotNull()), "coded")
    placed, convs = numbered(turns)
    again, lengths = rebuilt(placed, convs)
    seqs = scratch(rows_of_turns(again, block), "sequences")
    return trie(classes_of(lengths, seqs), seqs, block, local)
