"""Readers, by suffix, and adapters for binary files."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

TABLES = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".txt": "text", ".md": "text"}
OFFICE = (".docx", ".pptx")
BINARY = (".pdf", *OFFICE)


class UnsupportedFormat(ValueError):
    """A suffix that no reader is for."""


def suffix(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return f".{name.rpartition('.')[2].lower()}" if "." in name else ""


def read(spark: SparkSession, path: str, columns: str | None = None, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """The table at path. Documents (PDF, DOCX, PPTX) need `extract`, which turns a file's bytes into
    the text of its pages."""
    kind = suffix(path)
    if kind in TABLES:
        reader = spark.read.format(TABLES[kind])
        return (reader.schema(columns) if columns else reader).load(path)
    if kind in BINARY and extract is not None:
        return extracted(spark.read.format("binaryFile").load(path), extract)
    raise UnsupportedFormat(f"no reader for {kind or 'files without a suffix'}; there are {', '.join([*TABLES, *BINARY])}")


class PasswordNeeded(ValueError):
    """A document that can't be opened without its password; extract callables raise it."""


class Damaged(ValueError):
    """A document that is no document of its kind."""


_STARTS = {".pdf": b"%PDF", ".docx": b"PK", ".pptx": b"PK"}


def fault_of(path: str, content: bytes) -> Exception | None:
    """What is wrong with a file by its first bytes, before any parser sees it."""
    start = _STARTS.get(suffix(path))
    return Damaged(f"{path} is no {suffix(path)} file") if start and not content[:1024].lstrip().startswith(start) else None


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_no, native and error from binaryFile rows; a file that can't be read gives one row
    with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    if wrong := fault_of(path, content):
                        raise wrong
                    rows += [(path, k, text, None) for k, text in enumerate(extract(content), 1)]
                except Exception as e:  # of any parser; kept as data
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "native", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, native string, error string")


def office_pictures(files: DataFrame) -> DataFrame:
    """path, place, name, width, height (of PNG files, else null) and content of the pictures inside DOCX
    and PPTX files; a file that is no zip has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    box = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for place, name in enumerate(n for n in box.namelist() if n.startswith(("word/media/", "ppt/media/")) and not n.endswith("/")):
                    data = box.read(name)
                    size = struct.unpack(">II", data[16:24]) if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24 else (None, None)
                    rows.append((path, place, name, *size, data))
            yield pd.DataFrame(rows, columns=["path", "place", "name", "width", "height", "content"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, place int, name string, width int, height int, content binary")


@F.pandas_udf(T.IntegerType())
def picture_count(content: pd.Series) -> pd.Series:
    """Pictures inside a DOCX or PPTX; null where the file is no zip."""

    def count(data: bytes) -> int | None:
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, TypeError):
            return None
        return sum(n.startswith(("word/media/", "ppt/media/")) and not n.endswith("/") for n in names)

    return content.map(count).astype("Int32")


def stale(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources (name, modificationTime) without a derived file, or with an older one."""
    d = derived.select("name", F.col("modificationTime").alias("_made"))
    return sources.join(d, "name", "left").filter(F.col("_made").isNull() | (F.col("_made") < F.col("modificationTime"))).drop("_made")


def read_json(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """JSON sidecars by schema: unknown keys are dropped, what can't be read is null."""
    return spark.read.schema(columns).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_systems(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schema.SYSTEM)


def stream_json(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A stream of line-delimited JSON; lines that can't be read are nulls."""
    return spark.readStream.schema(columns).json(path)


def extraction_failed(native: Column) -> Column:
    return native.startswith("*[extraction failed")
