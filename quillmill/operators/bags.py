"""Multiset algebra in long form: rows of keys, a token and its count n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bag(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, token and n; the count is combined before the shuffle."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def ordered_bag(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """bag() with first_pos, the place of the token's first occurrence: the tie-break of top_k."""
    e = df.select(*keys, F.posexplode(tokens).alias("pos", "token"))
    return e.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, and the counts na and nb on either side, 0 where absent."""
    k = [*keys, "token"]
    j = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), k, "full")
    return j.select(*k, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("na", "nb")))


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return both(a, b, keys).select(*keys, "token", (F.col("na") - F.col("nb")).alias("n")).filter("n > 0")


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    k = [*keys, "token"]
    return a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), k).select(*k, F.least("na", "nb").alias("n"))


def plus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that differ, with how many are missing from b and extra in it."""
    zero = F.lit(0).cast("long")
    d = both(a, b, keys)
    return d.filter("na != nb").select(*keys, "token", F.greatest(F.col("na") - F.col("nb"), zero).alias("missing"), F.greatest(F.col("nb") - F.col("na"), zero).alias("extra"))


def top_k(counted: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent tokens of each key; ties go to the one seen first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
