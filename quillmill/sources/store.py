"""A table in parts that are replaced one by one: the store of checks, notes and cached replies.

Rows are dealt to a fixed number of parts by their first key. A version holds new files for the parts that
it touches and for no others; a manifest, one small file a version, says which parts those are. A part's
rows are those of its latest version, so an upsert reads and writes the parts of its own keys only, and
readers that want some keys read their parts only. What a failed writer leaves behind is in no manifest
and is not read; two writers can't both make one version, since the second finds its folder taken. Versions
that no part is read from any more are dropped by compact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from .sinks import PARTS, part_of

MANIFEST = "version long, part int, rows long"


class PartStore:
    """path: the folder; schema: its rows; keys: what names a row, the first of them its part."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts

    def part(self) -> Column:
        return part_of(F.col(self.keys[0]), self.parts)

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> DataFrame:
        fs, path = self._folder("manifest")
        return self.spark.read.schema(MANIFEST).parquet(str(path)) if fs.exists(path) else self.spark.createDataFrame([], MANIFEST)

    def live(self) -> dict[int, tuple[int, int]]:
        """Part -> (its latest version, rows): as many entries as there are parts."""
        latest = self.manifest().groupBy("part").agg(F.max(F.struct("version", "rows")).alias("v"))
        return {r.part: (r.v.version, r.v.rows) for r in latest.collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of the store, or of some parts."""
        files = [f"{self.path}/data/version={v}/part={p}" for p, (v, n) in self.live().items() if n and (parts is None or p in parts)]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*files) if files else empty

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts of rows' keys; there are `parts` at most."""
        return sorted(r.p for r in rows.select(self.part().alias("p")).distinct().collect())

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows whose first key stands in wanted, read from its parts."""
        return self.read(self.parts_of(wanted)).join(wanted.select(self.keys[0]).distinct(), self.keys[0], "left_semi")

    def upsert(self, new: DataFrame, order: list | None = None, gone: Column | None = None) -> list[int]:
        """Puts new rows in place of those of their keys, as a new version; of several new rows of one key
        the first in `order` counts (without it, the greatest). Rows for which `gone` holds only delete.
        Returns the parts that were written."""
        columns = self.spark.createDataFrame([], self.schema).columns
        new = new.withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        new = runs.newest(new, self.keys, order or [F.struct(*columns).desc()]).select(*columns, "_gone")
        touched = self.parts_of(new)
        if not touched:
            return []
        old = self.read(touched).withColumn("_gone", F.lit(False))
        merged = runs.upsert(old, new, self.keys, F.col("_gone")).select(*columns)
        version = max((v for v, _ in self.live().values()), default=0) + 1
        where = f"{self.path}/data/version={version}"
        merged.withColumn("part", self.part()).repartition("part").sortWithinPartitions("part", *self.keys).write.mode("errorifexists").partitionBy("part").parquet(where)
        counts = self._counted(where)
        rows = [(version, p, counts.get(p, 0)) for p in touched]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched

    def _counted(self, where: str) -> dict[int, int]:
        """Rows by part, from the files' footers."""
        fs, path = self._folder(where.removeprefix(f"{self.path}/"))
        if not any(s.isDirectory() for s in fs.listStatus(path)):
            return {}
        return {r.part: r["count"] for r in self.spark.read.parquet(where).groupBy("part").count().collect()}

    def compact(self) -> list[int]:
        """Drops the versions that no part is read from, and returns them; readers that began before
        may still need them, so it is for times without any."""
        keep = {v for v, _ in self.live().values()}
        fs, path = self._folder("data")
        dropped = []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            version = int(s.getPath().getName().removeprefix("version="))
            if version not in keep:
                fs.delete(s.getPath(), True)
                dropped.append(version)
        return sorted(dropped)
