"""Slide decks and word documents made from the element table, as test input.

A deck holds 48 elements, so one package is put together per group.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

SPACES = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" '
    'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
)
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
NEEDED = ["uid", "deck", "slide_idx", "shape_idx", "shape_id", "parent_id", "shape_type", "shape_name", "existing_alt", "text", "slide_text",
          "slide_notes", "width", "height", "left", "top", "fill_kind", "has_line"]
FILLS = {"none": "<a:noFill/>", "solid": "<a:solidFill/>", "gradient": "<a:gradFill/>"}


def relation(name: str, target: str) -> str:
    return f'<Relationship Id="{name}" Type="x" Target="{target}"/>'


def shape_xml(row, inner: str) -> str:
    kind, rel = row.shape_type, f"rId{row.shape_id}"
    head = f"<p:cNvPr id=\"{row.shape_id}\" name={quoteattr(row.shape_name)} descr={quoteattr(row.existing_alt)}/>"
    frame = (
        f'<a:off x="{row.left * 9525}" y="{row.top * 9525}"/><a:ext cx="{row.width * 9525}" cy="{row.height * 9525}"/>'
    )
    fill = FILLS.get(row.fill_kind, f'<a:blipFill><a:blip r:embed="{rel}"/></a:blipFill>')
    look = f"<p:spPr><a:xfrm>{frame}</a:xfrm>{fill}{'<a:ln/>' if row.has_line else ''}</p:spPr>"
    if kind == "GROUP":
        return f"<p:grpSp><p:nvGrpSpPr>{head}</p:nvGrpSpPr><p:grpSpPr><a:xfrm>{frame}</a:xfrm></p:grpSpPr>{inner}</p:grpSp>"
    if kind == "PICTURE":
        return f'<p:pic><p:nvPicPr>{head}</p:nvPicPr><p:blipFill><a:blip r:embed="{rel}"/></p:blipFill>{look}</p:pic>'
    if kind in ("LINE", "CONNECTOR"):
        ends = '<a:stCxn id="1" idx="0"/>' if kind == "CONNECTOR" else ""
        return f"<p:cxnSp><p:nvCxnSpPr>{head}<p:cNvCxnSpPr>{ends}</p:cNvCxnSpPr></p:nvCxnSpPr>{look}</p:cxnSp>"
    if kind in ("TABLE", "CHART"):
        uri = f"http://schemas.openxmlformats.org/drawingml/2006/{kind.lower()}"
        return (
            f'<p:graphicFrame><p:nvGraphicFramePr>{head}</p:nvGraphicFramePr><p:xfrm>{frame}</p:xfrm>'
            f'<a:graphic><a:graphicData uri="{uri}"/></a:graphic></p:graphicFrame>'
        )
    box = ' txBox="1"' if kind == "TEXT_BOX" else ""
    place = '<p:nvPr><p:ph type="body"/></p:nvPr>' if kind == "PLACEHOLDER" else ""
    lines = "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in row.text.split("\n"))
    return f"<p:sp><p:nvSpPr>{head}<p:cNvSpPr{box}/>{place}</p:nvSpPr>{look}<p:txBody>{lines}</p:txBody></p:sp>"


def deck_bytes(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        slides = sorted(rows["slide_idx"].unique())
        ids = "".join(f'<p:sldId id="{256 + n}" r:id="rId{n}"/>' for n in slides)
        package.writestr("ppt/presentation.xml", f"<p:presentation {SPACES}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        package.writestr("ppt/_rels/presentation.xml.rels", RELS.format("".join(relation(f"rId{n}", f"slides/s{9 - n}.xml") for n in slides)))
        for number, slide in rows.groupby("slide_idx"):
            children: dict = {}
            for row in slide.sort_values("shape_idx").itertuples():
                children.setdefault(None if pd.isna(row.parent_id) else int(row.parent_id), []).append(row)

            def draw(parent):
                return "".join(shape_xml(row, draw(row.shape_id)) for row in children.get(parent, []))

            part = f"s{9 - number}.xml"
            package.writestr(f"ppt/slides/{part}", f"<p:sld {SPACES}><p:cSld><p:spTree>{draw(None)}</p:spTree></p:cSld></p:sld>")
            links = [relation("notes", f"../notesSlides/{part}")]
            for row in slide.itertuples():
                if row.shape_type == "PICTURE" or row.fill_kind == "picture":
                    package.writestr(f"ppt/media/image{row.uid}.png", row.slide_text.encode())
                    links.append(relation(f"rId{row.shape_id}", f"../media/image{row.uid}.png"))
            package.writestr(f"ppt/slides/_rels/{part}.rels", RELS.format("".join(links)))
            note = slide.sort_values("shape_idx").iloc[0]["slide_notes"]
            package.writestr(
                f"ppt/notesSlides/{part}",
                f"<p:notes {SPACES}><p:sp><p:txBody><a:p><a:r><a:t>{escape(note)}</a:t></a:r></a:p></p:txBody></p:sp></p:notes>",
            )
    return out.getvalue()


def document_bytes(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for part, some in (("header1", rows[rows["slide_idx"] == 0]), ("document", rows[rows["slide_idx"] > 0])):
            body, links = [], []
            for row in some.sort_values("uid").itertuples():
                pic = f'<a:blip r:embed="rId{row.uid}"/>' if row.shape_type == "PICTURE" else ""
                body.append(
                    f'<w:drawing><wp:extent cx="{row.width * 9525}" cy="{row.height * 9525}"/>'
                    f"<wp:docPr id=\"{row.uid}\" name={quoteattr(row.shape_name)} descr={quoteattr(row.existing_alt)}/>{pic}</w:drawing>"
                )
                if pic:
                    package.writestr(f"word/media/image{row.uid}.png", row.slide_text.encode())
                    links.append(relation(f"rId{row.uid}", f"media/image{row.uid}.png"))
            package.writestr(f"word/{part}.xml", f"<w:document {SPACES}>{''.join(body)}</w:document>")
            package.writestr(f"word/_rels/{part}.xml.rels", RELS.format("".join(links)))
    return out.getvalue()


def packages(elements: DataFrame, kind: str) -> DataFrame:
    """(path, content) of one package per deck, as a file scan gives them."""
    make, ending = {"pptx": (deck_bytes, "pptx"), "docx": (document_bytes, "docx")}[kind]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"{rows['deck'].iloc[0]}.{ending}", make(rows))], columns=["path", "content"])

    return elements.select(*NEEDED).groupBy("deck").applyInPandas(build, "path string, content binary")
