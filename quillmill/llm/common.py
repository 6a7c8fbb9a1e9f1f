"""What the operators share: table access, scratch tables, packed exchanges."""

from __future__ import annotations

import atexit
import ctypes
import functools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one bucket of a packed exchange should stand for.
BUCKET_BYTES = 4 << 20
MIN_BUCKETS, MAX_BUCKETS = 48, 1 << 20
#: Bytes of a group after which a worker's free memory is given back.
LARGE_GROUP = 4 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: The planner's figure for what it knows nothing of is beyond this.
UNKNOWN = 1 << 56


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder for scratch tables: spark.checkpoint.dir of the session, which all machines
    share. Only where that is unset on one machine, as in tests, a folder of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file:///tmp/quillmill-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, where the session has Spark's default of eight times that: what a
    worker holds besides its own arrays stays small whatever a row's size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).strip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_scratch(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, True)


def _drop_at_exit(spark: SparkSession, where: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_scratch(spark, where)


#: Scratch tables made so far and not dropped: (session, path).
_made: list[tuple[SparkSession, str]] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it again: cuts the lineage, gives
    the planner a true size, and survives the loss of executors. Dropped when the program ends."""
    spark = df.sparkSession
    bounded_batches(spark)
    where = f"{scratch_dir(spark)}/quillmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    atexit.register(_drop_at_exit, spark, where)
    _made.append((spark, where))
    out = spark.read.schema(df.schema).parquet(where)
    out._quillmill_scratch = where
    return out


def forget(*tables: DataFrame) -> None:
    """Drops scratch tables, as scratch() returned them, that nothing reads any more."""
    gone = {t._quillmill_scratch for t in tables}
    for spark, where in [m for m in _made if m[1] in gone]:
        drop_scratch(spark, where)
        _made.remove((spark, where))


def made() -> int:
    """A mark for forget_since()."""
    return len(_made)


def forget_since(mark: int, *kept: DataFrame) -> None:
    """Drops the scratch tables made since the mark, except those named. The mark holds as long as
    no table from before it is dropped."""
    names = {t._quillmill_scratch for t in kept}
    for spark, where in [m for m in _made[mark:] if m[1] not in names]:
        drop_scratch(spark, where)
        _made.remove((spark, where))


def _drop_table_at_exit(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def scratch_bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """A scratch table in the warehouse, bucketed by key: steps that group by key read it in place,
    without an exchange. On a cluster the session must name a warehouse that all machines share: the
    folder that Spark falls back to is one machine's own."""
    spark = df.sparkSession
    if not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().get("spark.sql.warehouse.dir", ""):
        raise RuntimeError("spark.sql.warehouse.dir must name a folder that the driver and all executors share")
    table = f"quillmill_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("compression", "zstd").saveAsTable(table)
    atexit.register(_drop_table_at_exit, spark, table)
    return spark.table(table)


def size_hint(df: DataFrame) -> int:
    """The planner's estimate of df's bytes, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """Buckets of a packed exchange: in proportion to the input, so that a bucket's arrays stay
    at a few MB whatever the input's size."""
    bounded_batches(df.sparkSession)
    size = size_hint(df)
    if size >= UNKNOWN:  # rows that come from no table: their texts are measured
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // bytes_each
    return int(min(MAX_BUCKETS, max(MIN_BUCKETS, n)))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text without nulls and the columns named in more; other columns go."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )


# --- memory of Python workers -----------------------------------------------------------------
# A worker lives as long as its executor and runs one task after the other. What a task has freed is
# given back to the system when it ends, so that a worker isn't as large as its largest task for good.


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(batches_to_batches):
    """For mapInArrow: memory is given back when the task's last batch is done."""

    @functools.wraps(batches_to_batches)
    def run(batches):
        yield from batches_to_batches(batches)
        _give_back()

    return run


def lean_group(of_group):
    """For applyInArrow: memory is given back after a group of any size to speak of."""
    places = of_group.__code__.co_argcount

    def run(*tables: pa.Table) -> pa.Table:
        out = of_group(*tables)
        if sum(t.nbytes for t in tables if isinstance(t, pa.Table)) > LARGE_GROUP:
            _give_back()
        return out

    # Spark tells functions with a key by the number of their arguments
    if places == 1:
        return lambda a: run(a)
    return (lambda a, b: run(a, b)) if places == 2 else lambda a, b, c: run(a, b, c)


# --- packed exchange -------------------------------------------------------------------------
# A payload holds columns of equal length as raw little-endian arrays behind a short header, so
# that millions of small records cross a shuffle as a few binary rows per batch and bucket.


def pack(*columns: np.ndarray) -> bytes:
    head = struct.pack("<B", len(columns))
    body = []
    for c in columns:
        c = np.ascontiguousarray(c)
        head += struct.pack("<cBI", c.dtype.kind.encode(), c.dtype.itemsize, len(c))
        body.append(c.tobytes())
    return head + b"".join(body)


def unpack(payload) -> list[np.ndarray]:
    data = bytes(payload) if not isinstance(payload, bytes) else payload
    (n,) = struct.unpack_from("<B", data, 0)
    at, out = 1 + 6 * n, []
    for k in range(n):
        kind, width, length = struct.unpack_from("<cBI", data, 1 + 6 * k)
        out.append(np.frombuffer(data, np.dtype(f"<{kind.decode()}{width}"), length, at))
        at += width * length
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same non-negative whole numbers in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_ids(ids: np.ndarray) -> list[np.ndarray]:
    """A column of document ids as a dictionary and narrow indices."""
    values, index = np.unique(ids, return_inverse=True)
    return [values, narrow(index)]


def deal(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, columns of its records) for every bucket that has any; order within is kept."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    columns = [c[order] for c in columns]
    lo = 0
    for b, hi in enumerate(ends.tolist()):
        if hi > lo:
            yield b, [c[lo:hi] for c in columns]
        lo = hi


PACKED = "bucket int, payload binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


# --- documents dealt to buckets by id ---------------------------------------------------------

NO_ID = -(1 << 63)  # stands for a null id, which counts as smaller than any other


def prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def by_bucket(docs: DataFrame, n: int) -> DataFrame:
    """bucket, doc_id (NO_ID for null) and text (empty for null), to be grouped by bucket."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(F.pmod(d, F.lit(n)).cast("int").alias("bucket"), d.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_order(group: pa.Table) -> pa.Table:
    """A bucket's documents in the one order that every step sees: by id, then by text. A row's
    place in it names the row, also where ids repeat."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


ROUTED = "bucket int, target int, payload binary"
_ROUTED = pa.schema([("bucket", pa.int32()), ("target", pa.int32()), ("payload", pa.binary())])


def routed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_ROUTED.types)], schema=_ROUTED)
