"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, scratch

#: Up to so many edges (16 bytes each) are worked on in one task; more, in rounds of all tasks.
FEW_EDGES = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or not larger (small) neighbours to its least one."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _within(batches):
    """The star of each component of the edges of one task."""
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    leaf = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["a", "b"])


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (the least node it reaches), for each node of the edges a - b.

    Each round is written to a scratch table, so a lost executor costs one round at most; the
    number of rounds grows with the logarithm of the longest path. A few edges need no rounds."""
    if edges.count() <= FEW_EDGES:
        return _named(scratch(edges.select("a", "b").coalesce(1).mapInArrow(lean(_within), "a long, b long"), name))
    now = scratch(edges.filter("a != b").select("a", "b").distinct(), name)
    seen = None
    while True:
        before, now = now, scratch(_star(_star(now, True), False), name)
        forget(before)
        # a fixed point: every edge leads from a node straight to its component's least
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return _named(now)
        seen = state
