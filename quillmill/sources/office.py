"""DOCX and PPTX files as blocks: paragraphs, headings, tables and pictures, in their order.

The parts of a file are read with the standard library inside tasks; what is made of the blocks (numbers of
pictures, descriptions, the document) is done on DataFrames."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lint as L
from ..functions import text as T

BLOCKS = "path string, place int, kind string, level int, text string, name string, alt string, error string"
_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
# Names of the formats' parts.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"


def _targets(box: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> name in the file, of a part."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in box.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))) if not r.get("Target", "").startswith("/") else r.get("Target")[1:] for r in ElementTree.fromstring(box.read(rels))}


def _cells(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])]) if width else ""


def _picture(drawing, targets: dict[str, str]) -> tuple | None:
    blip = next(drawing.iter(f"{_A}blip"), None)
    name = targets.get(blip.get(f"{_R}embed")) if blip is not None else None
    told = next((e for tag in (f"{_WP}docPr", f"{_P}cNvPr") for e in drawing.iter(tag)), None)
    return ("picture", None, None, name, (told.get("descr") or "").strip() if told is not None else "") if name else None


def _paragraph(p, targets: dict[str, str]) -> Iterator[tuple]:
    """A paragraph's text, parted where pictures stand in it."""
    style = next((s.get(f"{_W}val") or "" for s in p.iter(f"{_W}pStyle")), "")
    level = re.fullmatch(r"Heading ?([1-6])", style)
    words: list[str] = []

    def flush() -> Iterator[tuple]:
        if text := "".join(words).strip():
            yield ("heading", int(level[1]), text, None, None) if level else ("text", None, text, None, None)
        words.clear()

    inside = set()  # what a drawing holds is the drawing's
    for e in p.iter():
        if id(e) in inside:
            continue
        if e.tag == f"{_W}drawing":
            inside.update(id(x) for x in e.iter())
            if picture := _picture(e, targets):
                yield from flush()
                yield picture
        elif e.tag == f"{_W}t":
            words.append(e.text or "")
        elif e.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            words.append("\t" if e.tag == f"{_W}tab" else "\n")
    yield from flush()


def _word_blocks(parent, targets: dict[str, str]) -> Iterator[tuple]:
    for e in parent:
        if e.tag == f"{_W}p":
            yield from _paragraph(e, targets)
        elif e.tag == f"{_W}tbl":
            cell = lambda c: "\n".join(b[2] for p in c.iter(f"{_W}p") for b in _paragraph(p, {}) if b[2])
            yield "table", None, _cells([[cell(c) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]), None, None
            yield from (b for p in e.iter(f"{_W}p") for b in _paragraph(p, targets) if b[0] == "picture")
        elif e.tag == f"{_W}sdt":
            for inner in e.findall(f"{_W}sdtContent"):
                yield from _word_blocks(inner, targets)


def _slide_blocks(box: zipfile.ZipFile) -> Iterator[tuple]:
    slides = _targets(box, "ppt/presentation.xml")
    for n, s in enumerate(ElementTree.fromstring(box.read("ppt/presentation.xml")).iter(f"{_P}sldId"), 1):
        part = slides[s.get(f"{_R}id")]
        targets, tree = _targets(box, part), ElementTree.fromstring(box.read(part))
        yield "heading", 2, f"Slide {n}", None, None
        for e in tree.iter():
            if e.tag == f"{_P}pic":
                if picture := _picture(e, targets):
                    yield picture
            elif e.tag == f"{_P}sp":
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in e.iter(f"{_A}p")).strip()
                if text:
                    yield "text", None, text, None, None
            elif e.tag == f"{_A}tbl":
                yield "table", None, _cells([["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in e.findall(f"{_A}tr")]), None, None


def blocks_of(content: bytes) -> list[tuple]:
    """(kind, level, text, name, alt) of a file's blocks."""
    box = zipfile.ZipFile(io.BytesIO(content))
    names = box.namelist()
    if "word/document.xml" in names:
        body = next(ElementTree.fromstring(box.read("word/document.xml")).iter(f"{_W}body"))
        return list(_word_blocks(body, _targets(box, "word/document.xml")))
    if "ppt/presentation.xml" in names:
        return list(_slide_blocks(box))
    raise ValueError("neither a DOCX nor a PPTX file")


def office_blocks(files: DataFrame) -> DataFrame:
    """The blocks (kind: text, heading, table, picture) of each DOCX and PPTX file (path, content), in their
    order; a file that can't be read gives one row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(path, k, *b, None) for k, b in enumerate(blocks_of(content))]
                except Exception as e:  # of any damaged file; kept as data
                    rows = [(path, 0, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=_NAMES).astype({"level": "Int32"})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def office_documents(blocks: DataFrame, assets: Column, descriptions: DataFrame | None = None, model: str = "model") -> DataFrame:
    """path, md and n_pictures of each file: its blocks in order, money escaped, pictures as links into the
    folder `assets` with their alt text or their number, and under a picture what was said of it, if
    descriptions (path, picture, text) has it."""
    b = blocks.filter(F.col("error").isNull())
    number = F.sum((F.col("kind") == "picture").cast("int")).over(Window.partitionBy("path").orderBy("place"))
    b = b.withColumn("picture", F.when(F.col("kind") == "picture", number))
    told = descriptions if descriptions is not None else b.sparkSession.createDataFrame([], "path string, picture int, text string")
    b = b.join(told.select("path", "picture", F.col("text").alias("_said")), ["path", "picture"], "left")
    link = F.concat(F.lit("!["), F.when(F.col("alt") != "", F.col("alt")).otherwise(F.concat(F.lit("Picture "), F.col("picture").cast("string"))), F.lit("]("), T.md_link(F.concat(assets, F.lit("/"), F.element_at(F.split("name", "/"), -1))), F.lit(")"))
    said = F.when(F.col("_said").isNotNull(), F.concat(F.lit("\n\n**Picture "), F.col("picture").cast("string"), F.lit(f" - transcribed by {model}:**\n\n"), T.quote_block(F.col("_said")))).otherwise("")
    text = L.escape_money(F.coalesce("text", F.lit("")))
    shown = F.when(F.col("kind") == "picture", F.concat(link, said)).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text)).otherwise(text)
    ordered = F.array_sort(F.collect_list(F.struct("place", shown.alias("t"))))
    return b.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("md"), F.count("picture").alias("n_pictures"))
