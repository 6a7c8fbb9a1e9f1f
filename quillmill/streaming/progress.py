"""The event feed as a stream: progress of each run, folded in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema
from ..operators import runs
from ..sources.readers import stream_json
from ..sources.sinks import part_of
STATE = "done int, failed int, todo int, cost double, first double, last double"
PROGRESS = "run long, done int, failed int, left_over int, cost double, per_page double, eta long"


def events(spark: SparkSession, path: str) -> DataFrame:
    return stream_json(spark, path, schema.EVENTS)


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, failed, todo, cost, first, last = state.get if state.exists else (0, 0, 0, 0.0, float("nan"), float("nan"))
    ended_run = False
    for part in parts:
        for e in part.sort_values("at").itertuples():
            if e.event == "start":
                todo = int(e.todo)
            elif e.event in ("page_done", "image_done"):
                done += 1
                cost = float(e.cost) if e.cost == e.cost else cost
            elif e.event == "page_failed":
                failed += 1
            elif e.event == "finished":
                ended_run = True
            first = e.at if first != first else min(first, e.at)
            last = e.at if last != last else max(last, e.at)
    if ended_run:  # nothing comes after it
        state.remove()
    else:
        state.update((done, failed, todo, cost, first, last))
    ended, rest = done + failed, max(0, todo - done - failed)
    per_page = (last - first) / ended if ended else None
    yield pd.DataFrame([(key[0], done, failed, rest, cost, per_page, None if per_page is None else round(rest * per_page))], columns=[c.split()[0] for c in PROGRESS.split(", ")])


def progress(feed: DataFrame) -> DataFrame:
    """The newest progress of each run, updated with every batch; a run's state goes when it has finished."""
    return feed.groupBy("run").applyInPandasWithState(_fold, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def write_partial(pages: DataFrame, path: str, header, checkpoint: str):
    """Assembles what has arrived with every batch of a stream of pages (doc_id, page_no, md). Only the
    documents that a batch has pages of are read, from the folders they are dealt to, and written anew,
    as a later version; read_partial() gives the latest of each."""

    def assemble(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", part_of(F.col("doc_id"))).withColumn("batch", F.lit(number))
        batch.write.mode("append").partitionBy("part").parquet(f"{path}/pages")
        parts = [r.part for r in batch.select("part").distinct().collect()]  # PARTS at most
        every = spark.read.schema(batch.schema).parquet(f"{path}/pages").filter(F.col("part").isin(parts))
        every = every.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        latest = every.groupBy("doc_id", "page_no").agg(F.max_by("md", "batch").alias("md"))
        runs.assemble(latest, "doc_id", header).withColumn("version", F.lit(number)).write.mode("append").parquet(f"{path}/documents")

    return pages.writeStream.foreachBatch(assemble).option("checkpointLocation", checkpoint).start()


def read_partial(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents").groupBy("doc_id").agg(F.max_by("document", "version").alias("document"))
