"""Writers of pages, documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import runs


#: Folders that pages are dealt to by document.
PARTS = 64


def part_of(doc_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def write_pages(pages: DataFrame, path: str, parts: int = PARTS) -> None:
    """Pages in a fixed number of folders by document, sorted within: a later run reads the folders, and
    of them the row groups, of the documents it needs, however many documents there are."""
    p = pages.withColumn("part", part_of(F.col("doc_id"), parts))
    p.repartition("part").sortWithinPartitions("part", "doc_id", "page_no").write.mode("append").partitionBy("part").parquet(path)


def write_documents(pages: DataFrame, path: str, header: Column) -> None:
    """One row per assembled document; the commit protocol shows it whole or not at all."""
    runs.assemble(pages, "doc_id", header).write.mode("overwrite").parquet(path)


def event_lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per line; fields that are null are left out."""
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


def write_events(events: DataFrame, path: str, columns: list[str]) -> None:
    event_lines(events, columns).write.mode("append").text(path)


def write_cache(replies: DataFrame, path: str) -> None:
    """Whole replies by key, appended; the newest of a key wins when it is read."""
    replies.filter(runs.cacheable(F.col("text"), F.col("finish_reason"))).select("key", "text", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def read_cache(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("text", "at").alias("text"))
