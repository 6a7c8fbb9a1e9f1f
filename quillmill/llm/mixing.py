"""Mixing sources to target weights by temperature.

Source i holds the share p_i of all tokens. Its weight is q_i ~ p_i ** a. A lower exponent evens the
sources out: entropy rises, and small sources are repeated more often. The exponent is bisected on a
grid of 1/GRID: the least at which no source is repeated more than max_repeats times over the budget
(budget_ratio * all tokens), or the greatest at which the entropy is at least a target share of
ln(number of sources).

The weights are realised as budgeted block permutations: a source's documents are dealt to blocks by
a hash, blocks and the documents in each are permuted by a hash of the pass, and documents are taken
in that order, pass after pass, while the tokens taken so far are below the source's budget. So every
source overshoots its budget by less than one document, and no sort is ever larger than a block.

DataFrame functions only; of the sources, each step of the bisection brings three sums to the driver.

Defined cases: tokens are runs of other than \\x20 and \\x09-\\x0D; null has none; a null source counts
as the empty string; documents without tokens are drawn when the order reaches them; a source without
tokens has no weight; repeated rows count each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

GRID = 1024
MAX_REPEATS = 1.25
BUDGET_RATIO = 1.0
#: Documents of a block, on average.
BLOCK_DOCS = 4096
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def drawn_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(p.cast("string") for p in parts)))


def _sums(sources: DataFrame, k: int) -> tuple[float, float, float]:
    """At exponent k / GRID: the sum of the weights, the entropy, and the most repeats per budget."""
    w = F.exp(F.lit(k / GRID) * F.log("share"))
    row = sources.agg(F.sum(w).alias("z"), F.sum(w * F.log("share")).alias("s"), F.max(w / F.col("share")).alias("m"), F.count("*").alias("n")).first()
    z = row["z"]
    return z, float(math.log(z) - (k / GRID) * row["s"] / z), row["m"] / z


def _bisect(ok: Callable[[int], bool], low: int, high: int) -> int:
    """The least k in low..high at which the monotone condition holds; high if it never does."""
    while low < high:
        mid = (low + high) // 2
        if ok(mid):
            high = mid
        else:
            low = mid + 1
    return low


def exponent(sources: DataFrame, max_repeats: float | None, entropy: float | None, budget_ratio: float) -> int:
    """The exponent, as a multiple of 1/GRID."""
    if entropy is not None:
        most = math.log(max(1, sources.count()))
        too_low = _bisect(lambda k: _sums(sources, k)[1] < entropy * most, 0, GRID + 1)
        return max(0, too_low - 1)
    return _bisect(lambda k: budget_ratio * _sums(sources, k)[2] <= max_repeats, 0, GRID)


def weights(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget_ratio: float = BUDGET_RATIO) -> DataFrame:
    """source, n_docs, tokens, weight, budget and exponent of every source that has tokens."""
    sized = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    sums = scratch(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = sums.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    if not total:
        k, z = GRID, 1.0
    else:
        k = exponent(sources, max_repeats, entropy, budget_ratio)
        z = _sums(sources, k)[0]
    weight = F.exp(F.lit(k / GRID) * F.log("share")) / F.lit(z)
    return sources.select("source", "n_docs", "tokens", weight.alias("weight"), F.floor(weight * F.lit(budget_ratio * total)).cast("long").alias("budget"), F.lit(k / GRID).alias("exponent"))


def mixture(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget_ratio: float = BUDGET_RATIO) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, n_tokens, pass, block and place
    (the tokens that its source's pass has taken before it)."""
    plan = scratch(weights(docs, max_repeats, entropy, budget_ratio), "weights")  # a table: broadcast only if small
    plan = plan.select("source", "n_docs", "tokens", "budget", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long").alias("blocks"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("version"))
    number = F.conv(F.substring(drawn_hash(F.lit("block"), F.col("doc_id")), 1, 8), 16, 10).cast("long")
    d = scratch(d.join(plan, "source").withColumn("block", number % F.col("blocks")), "dealt")
    # passes 0 .. whole - 1 take everything, the last takes what the budget leaves
    passes = F.sequence(F.lit(0).cast("long"), F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    left = F.col("budget") - F.col("pass") * F.col("tokens")
    block = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("held"), F.first("budget").alias("budget"), F.first("tokens").alias("tokens"))
    block = block.withColumn("pass", F.explode(passes))
    order = Window.partitionBy("source", "pass").orderBy(drawn_hash(F.col("source"), F.col("pass"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0).cast("long"))).withColumn("left", left)
    block = scratch(block.filter(F.col("before") < F.col("left")).select("source", "block", "pass", "before", "left"), "blocks")
    within = Window.partitionBy("source", "block", "pass").orderBy(drawn_hash(F.col("pass"), F.col("doc_id")), "doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    rows = d.select("doc_id", "source", "n_tokens", "version", "block").join(block, ["source", "block"])
    place = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("long"))
    return rows.withColumn("place", place).filter(F.col("place") < F.col("left")).select("doc_id", "source", "n_tokens", F.col("pass"), "block", "place")
