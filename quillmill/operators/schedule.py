"""When requests are made: a rate that all tasks keep together, and when failed ones are tried again.

The rate is split into lanes, one for each task that asks, whose beats are spread evenly over the interval;
so any stretch of a minute holds the rate at most, and no clock is shared. In a lane requests go by the
times at which they are ready: the n-th is due at the later of its own time and one beat after the one
before it, which is n beats plus the largest (time - beats) so far: one window, no loop over requests.

A failed attempt is ready again after what the server asked for, or after a delay that doubles. Second
attempts follow all first ones of their lane, and so on, so that they keep the rate too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_DELAY, ATTEMPTS = 4.0, 5


def lane_of(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def slots(requests: DataFrame, ready: Column, per_minute: float, lanes: int, order: list) -> DataFrame:
    """requests (lane, ...) with due, in seconds: no earlier than ready, and a beat after the one before."""
    beat = 60.0 * lanes / per_minute
    r = requests.withColumn("_ready", F.greatest(ready.cast("double"), F.col("lane") * F.lit(60.0 / per_minute)))
    w = Window.partitionBy("lane").orderBy("_ready", *order)
    n = F.row_number().over(w)
    r = r.withColumn("_n", n)
    slack = F.max(F.col("_ready") - F.col("_n") * F.lit(beat)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("due", F.col("_n") * F.lit(beat) + slack).drop("_ready", "_n")


def attempts_due(attempts: DataFrame, key: str, per_minute: float, lanes: int = 8, most: int = ATTEMPTS, first_delay: float = FIRST_DELAY, lane: Column | None = None) -> DataFrame:
    """attempts (key, attempt from 1, retry_after in seconds or null: how the attempt before it failed) with
    lane and due. An attempt without the one before it is left out; a key is in one lane throughout, by its hash or as `lane` says."""
    beat = 60.0 * lanes / per_minute
    # each round is read by two later steps, so the plan grows with the rounds, of which there are `most`
    a = attempts.filter(F.col("attempt") <= most).withColumn("lane", lane_of(F.col(key), lanes) if lane is None else lane)
    done = slots(a.filter("attempt = 1"), F.lit(0.0), per_minute, lanes, [key])
    out = done
    for k in range(2, most + 1):
        last = F.broadcast(done.groupBy("lane").agg((F.max("due") + F.lit(beat)).alias("_free")))  # one row a lane
        before = done.select(key, F.col("due").alias("_due"))
        again = a.filter(F.col("attempt") == k).join(before, key).join(last, "lane")
        delay = F.coalesce(F.when(F.col("retry_after") > 0, F.col("retry_after").cast("double")), F.lit(first_delay * 2 ** (k - 2)))
        done = slots(again, F.greatest(F.col("_due") + delay, F.col("_free")), per_minute, lanes, [key]).drop("_due", "_free")
        out = out.unionByName(done)
    return out
