"""The copied-wording guard: lines that share a run of words with a source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A source side of up to so many planned bytes is broadcast; a larger one is dealt by hash.
MAX_BROADCAST = 8 << 20


def _run_hashes(text: Column, n: int) -> Column:
    """The hashes of the runs of n words, without writing the runs out."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    starts = lambda ws: F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return T.let(w, lambda ws: F.transform(starts(ws), lambda k: F.xxhash64(F.slice(ws, k, n))))


def _bounded(df: DataFrame, source: DataFrame) -> DataFrame:
    planned = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if planned <= MAX_BROADCAST else df


def copied_lines(lines: DataFrame, sources: DataFrame, n: int = T.RUN) -> DataFrame:
    """The distinct lines (keys, line_no, line) that share n words in a row with any source (text).
    Only 64-bit hashes of runs meet the sources' (a source side of a checked size is broadcast, so
    no line is shuffled); the few lines with a hit are compared as text."""
    hashes = sources.select(F.explode(_run_hashes(F.col("text"), n)).alias("_h")).distinct()
    hit = lines.select("*", F.explode(_run_hashes(F.col("line"), n)).alias("_h")).join(_bounded(hashes, sources), "_h", "left_semi").drop("_h").distinct()
    runs = sources.select(F.explode(T.grams(F.col("text"), n)).alias("_run")).distinct()
    same = hit.select("*", F.explode(T.grams(F.col("line"), n)).alias("_run")).join(_bounded(runs, sources), "_run", "left_semi")
    return same.drop("_run").distinct()


def without_copied(lines: DataFrame, sources: DataFrame, keys: list[str], n: int = T.RUN) -> DataFrame:
    """The other lines."""
    return lines.join(copied_lines(lines, sources, n).select(*keys, "line_no"), [*keys, "line_no"], "left_anti")
