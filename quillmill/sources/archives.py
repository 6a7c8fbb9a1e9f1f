"""Archives as a data sink: one ZIP file a document, whole or not there at all.

    write_archives(files, path)    # doc_id, name, content

A task writes the archives of its documents to a folder of the attempt's own; the commit renames those of
the attempts that count, so that an archive shows when it is whole, and takes the staging folder away. What
a killed task or job leaves is in the staging folder only. The bytes depend on names and contents alone, so
a rerun gives the same file.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as filesystems
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: The time that ZIP entries bear, the earliest there is.
EPOCH = (1980, 1, 1, 0, 0, 0)
RENAMES = 16


@dataclass
class Written(D.WriterCommitMessage):
    staged: list[tuple[str, str]]


class ArchiveWriter(D.DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _at(self):
        found, root = filesystems.FileSystem.from_uri(self.path)
        return found, root.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        found, root = self._at()
        attempt = f"{root}/_staging-{self.job}/{uuid.uuid4().hex}"
        found.create_dir(attempt, recursive=True)
        staged, doc, box, out = [], None, None, None
        try:
            for row in iterator:  # in order of document and name
                if box is None or row.doc_id != doc:
                    if box is not None:
                        box.close()
                        out.close()
                    doc, name = row.doc_id, f"{row.doc_id}.zip"
                    staged.append((f"{attempt}/{name}", f"{root}/{name}"))
                    out = found.open_output_stream(staged[-1][0])
                    box = zipfile.ZipFile(out, "w")
                entry = zipfile.ZipInfo(row.name, EPOCH)
                entry.compress_type, entry.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
                box.writestr(entry, bytes(row.content or b""), compresslevel=6)
        finally:
            if box is not None:
                box.close()
                out.close()
        return Written(staged)

    def commit(self, messages: list[Written | None]) -> None:
        found, root = self._at()
        moves = [m for w in messages if w is not None for m in w.staged]

        def move(m: tuple[str, str]) -> None:
            if self.overwrite and found.get_file_info(m[1]).type != filesystems.FileType.NotFound:
                found.delete_file(m[1])
            found.move(*m)

        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(move, moves))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        found, root = self._at()
        staging = f"{root}/_staging-{self.job}"
        if found.get_file_info(staging).type != filesystems.FileType.NotFound:
            found.delete_dir(staging)


class ArchiveSink(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmill_archives"

    def schema(self) -> str:
        return "doc_id string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(files: DataFrame, path: str) -> None:
    """An archive for each doc_id from rows of (doc_id, name, content); of rows with one name in a
    document the greatest content counts; rows without document or name are left out."""
    f = files.filter(F.col("doc_id").isNotNull() & F.col("name").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "name", F.col("content").cast("binary").alias("content"))
    f = f.groupBy("doc_id", "name").agg(F.max("content").alias("content"))
    f.repartition("doc_id").sortWithinPartitions("doc_id", "name").write.format("quillmill_archives").option("path", path).mode("overwrite").save()
