"""The page source, archives and the part store."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.sources.archives import write_archives
from quillmill.sources.documents import register
from quillmill.sources.store import PartStore


class Pages:
    """Pages that are parted by form feeds; each extraction leaves a file."""

    def __init__(self, content: bytes):
        if b"LOCKED" in content:
            from quillmill.sources.readers import PasswordNeeded

            raise PasswordNeeded("give its password")
        self.mark, *self.pages = content.decode().removeprefix("%PDF ").split("\f")

    def __len__(self) -> int:
        return len(self.pages)

    def __getitem__(self, k: int) -> str:
        Path(f"{self.mark}-{k + 1}").touch()
        if self.pages[k] == "bad":
            raise ValueError("no text")
        return self.pages[k]


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    files, marks = tmp_path / "files", tmp_path / "marks"
    files.mkdir()
    marks.mkdir()
    (files / "a.pdf").write_text(f"%PDF {marks}/a\f" + "\f".join(f"a{k}" for k in range(1, 101)))
    (files / "b.pdf").write_text(f"%PDF {marks}/b\fone\fbad\fthree")
    (files / "c.pdf").write_text("no such thing")
    (files / "d.pdf").write_text("%PDF LOCKED")
    (files / "e.txt").write_text("not a document")
    return files


def read(spark, folder):
    return spark.read.format("quillmill_pages").option("path", str(folder)).option("extract", "tests.test_sources:Pages").option("taskBytes", "100").load()


def test_pages(spark, folder):
    rows = [(r.path.rsplit("/", 1)[1], r.page_no, r.native, r.error) for r in read(spark, folder).collect()]
    assert sorted(r[1] for r in rows if r[0] == "a.pdf") == list(range(1, 101)) and all(n == f"a{p}" for f, p, n, _ in rows if f == "a.pdf")
    assert sorted(r[1:] for r in rows if r[0] == "b.pdf") == [(1, "one", None), (2, None, "ValueError: no text"), (3, "three", None)]
    assert [r[1] for r in rows if r[0] in ("c.pdf", "d.pdf")] == [0, 0] and {r[3].split(":")[0] for r in rows if r[1] == 0} == {"Damaged", "PasswordNeeded"}
    assert not [r for r in rows if r[0] == "e.txt"]


def marks_of(folder) -> set[str]:
    return {p.name for p in (folder.parent / "marks").iterdir()}


@pytest.mark.parametrize(
    "condition,pages",
    [("page_no = 40", {40}), ("page_no IN (3, 99, 500)", {3, 99}), ("page_no > 97 AND page_no <= 99", {98, 99}), ("page_no < 3", {1, 2}), ("page_no = 4 AND page_no = 5", set()), ("page_no >= 100", {100})],
)
def test_pages_are_pruned_before_extraction(spark, folder, condition, pages):
    df = read(spark, folder).filter(f"path = '{folder}/a.pdf'").filter(condition)
    assert {r.page_no for r in df.collect()} == pages
    assert marks_of(folder) == {f"a-{p}" for p in pages}


def test_archives(spark, tmp_path):
    register(spark)
    rows = [("x", f"p{k}.md", f"text {k}".encode()) for k in range(30)] + [("y", "p.md", None), ("x", "p1.md", b"a"), (None, "p", b""), ("z", None, b"")]
    files = spark.createDataFrame(rows, "doc_id string, name string, content binary").repartition(5)
    out = tmp_path / "out"
    write_archives(files, str(out))
    assert sorted(p.name for p in out.iterdir()) == ["x.zip", "y.zip"]
    box = zipfile.ZipFile(out / "x.zip")
    assert box.testzip() is None and box.namelist() == sorted(f"p{k}.md" for k in range(30)) and box.read("p1.md") == b"text 1"
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    write_archives(files.repartition(2), str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    register(spark)

    @F.udf("binary")
    def content(k):
        if k == 199:
            raise RuntimeError("lost")
        return b"x" * 1000

    files = spark.range(200).select((F.col("id") % 3).cast("string").alias("doc_id"), F.col("id").cast("string").alias("name"), content("id").alias("content"))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        write_archives(files, str(out))
    assert not out.exists() or not [p for p in out.rglob("*.zip")]


def test_part_store(spark, tmp_path):
    s = PartStore(spark, str(tmp_path / "store"), "doc_id long, page_no int, note string", ["doc_id", "page_no"], parts=16)
    assert s.read().count() == 0 and s.compact() == []
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("old").alias("note"))
    assert s.upsert(rows) == list(range(16))
    few = spark.createDataFrame([(5, 1, "new"), (5, 2, "more"), (5, 2, "last"), (6, 1, "gone")], "doc_id long, page_no int, note string")
    touched = s.upsert(few, gone=F.col("note") == "gone")
    assert len(touched) <= 2
    assert {n for n in os.listdir(tmp_path / "store/data/version=2") if n.startswith("part=")} == {f"part={p}" for p in touched}
    want = {(k, 1): "old" for k in range(400) if k != 6} | {(5, 1): "new", (5, 2): "more"}
    assert {(r.doc_id, r.page_no): r.note for r in s.read().collect()} == want
    wanted = spark.createDataFrame([(5,), (9999,)], "doc_id long")
    one = s.read_keys(wanted)
    assert sorted(r.note for r in one.collect()) == ["more", "new"]
    assert len(one.inputFiles()) <= 2  # of 16
    # what isn't in a manifest isn't read
    spark.createDataFrame([(7, 1, "stray")], "doc_id long, page_no int, note string").write.parquet(str(tmp_path / "store/data/version=9/part=3"))
    assert "stray" not in {r.note for r in s.read().collect()}
    assert s.compact() == [9]
    every = spark.createDataFrame([(k, 1, "x") for k in range(400)] + [(5, 2, "x")], "doc_id long, page_no int, note string")
    s.upsert(every, gone=F.lit(True))
    assert s.read().count() == 0 and s.compact() == [1, 2]
