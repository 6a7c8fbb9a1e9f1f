"""Office files of known content."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quillmill.sources import office

W, A, P, R = (office._W[1:-1], office._A[1:-1], office._P[1:-1], office._R[1:-1])
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in parts.items():
            box.writestr(name, text)
    return out.getvalue()


def word() -> bytes:
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    drawing = f'<w:r><w:drawing><wp:docPr xmlns:wp="{office._WP[1:-1]}" descr="{{}}"/><a:blip r:embed="{{}}"/></w:drawing></w:r>'
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Title")}</w:p><w:p>{run("cost $5, ")}{run("later")}{drawing.format("a cat", "r1")}{run("after")}</w:p>'
        f'<w:tbl><w:tr><w:tc><w:p>{run("a|b")}</w:p></w:tc><w:tc><w:p>{run("c")}</w:p><w:p>{run("d")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run("e")}</w:p></w:tc></w:tr></w:tbl><w:p>{drawing.format("", "r2")}</w:p><w:p/>'
    )
    document = f'<w:document xmlns:w="{W}" xmlns:a="{A}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>'
    return packed({"word/document.xml": document, "word/_rels/document.xml.rels": REL.format('<Relationship Id="r1" Target="media/i 1.png"/><Relationship Id="r2" Target="media/i2.png"/>')})


def slides() -> bytes:
    slide = lambda t, more="": f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p></p:sp>{more}</p:sld>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr descr="a chart"/></p:nvPicPr><a:blip r:embed="r9"/></p:pic>'
    return packed(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldId r:id="b"/><p:sldId r:id="a"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="/ppt/slides/slide2.xml"/>'),
            "ppt/slides/slide1.xml": slide("second", pic),
            "ppt/slides/slide2.xml": slide("first"),
            "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="r9" Target="../media/c.png"/>'),
        }
    )


def test_office(spark):
    files = spark.createDataFrame([("d.docx", word()), ("s.pptx", slides()), ("x.docx", b"PK no"), ("y.docx", packed({"z": ""}))], "path string, content binary")
    blocks = office.office_blocks(files).cache()
    assert [(b.kind, b.name, b.alt) for b in blocks.filter("kind = 'picture'").orderBy("path", "place").collect()] == [("picture", "word/media/i 1.png", "a cat"), ("picture", "word/media/i2.png", ""), ("picture", "ppt/media/c.png", "a chart")]
    assert {b.path: b.error.split(":")[0] for b in blocks.filter("error IS NOT NULL").collect()} == {"x.docx": "BadZipFile", "y.docx": "ValueError"}
    said = spark.createDataFrame([("d.docx", 2, "A dog.\n\nIt runs.")], "path string, picture int, text string")
    got = {r.path: (r.md, r.n_pictures) for r in office.office_documents(blocks, F.lit("assets"), said, "m").collect()}
    assert got["d.docx"] == (
        "## Title\n\ncost \\$5, later\n\n![a cat](assets/i%201.png)\n\nafter\n\n| a\\|b | c<br>d |\n|---|---|\n| e |  |\n\n![Picture 2](assets/i2.png)\n\n**Picture 2 - transcribed by m:**\n\n> A dog.\n>\n> It runs.", 2)
    assert got["s.pptx"] == ("## Slide 1\n\nfirst\nmore\n\n## Slide 2\n\nsecond\nmore\n\n![a chart](assets/c.png)", 1)
