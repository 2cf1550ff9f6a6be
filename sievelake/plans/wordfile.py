"""A Word report as Office Open XML: a zip of a few fixed parts and one document, written as a stream."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.sax.saxutils import escape

from sievelake.functions.severity import SEVERITIES

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/word/document.xml" ContentType="{WORD}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{WORD}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
}
#: Half points of each heading, and the colours of severities.
SIZES = {"Title": 40, "Heading1": 30, "Heading2": 24}
COLOURS = dict(zip(reversed(SEVERITIES), ("9C0006", "C00000", "B07000", "2F5597", "606060")))
#: What XML can't hold.
ODD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def styles() -> str:
    normal = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial"/><w:sz w:val="21"/></w:rPr></w:rPrDefault></w:docDefaults>'
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{k}"/><w:pPr><w:keepNext/><w:spacing w:before="240" w:after="120"/></w:pPr><w:rPr><w:b/><w:sz w:val="{n}"/></w:rPr></w:style>' for k, n in SIZES.items())
    return f'<w:styles xmlns:w="{W}">{normal}{heads}</w:styles>'


def run(text: object, bold: bool = False, italic: bool = False, colour: str | None = None) -> str:
    marks = "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:color w:val="{colour}"/>' if colour else "")
    return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{escape(ODD.sub("\ufffd", str("" if text is None else text)))}</w:t></w:r>'


def paragraph(runs: str, style: str | None = None, centred: bool = False) -> str:
    marks = (f'<w:pStyle w:val="{style}"/>' if style else "") + '<w:jc w:val="center"/>' * centred
    return f"<w:p><w:pPr>{marks}</w:pPr>{runs}</w:p>"


def table(rows: Iterable[list[str]]) -> Iterator[str]:
    sides = "".join(f'<w:{x} w:val="single" w:sz="4" w:color="A0A0A0"/>' for x in ("top", "left", "bottom", "right", "insideH", "insideV"))
    yield f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/><w:tblBorders>{sides}</w:tblBorders></w:tblPr>'
    for row in rows:
        yield "<w:tr>" + "".join(f"<w:tc>{paragraph(cell)}</w:tc>" for cell in row) + "</w:tr>"
    yield "</w:tbl>" + paragraph("")


def body(generated: str, summary: list[tuple[str, str]], files: Iterable[tuple[str, list[tuple]]], skipped: list[str]) -> Iterator[str]:
    yield f'<w:document xmlns:w="{W}"><w:body>'
    yield paragraph(run("Review Report"), "Title", True) + paragraph(run(generated, italic=True), None, True)
    yield paragraph(run("Summary"), "Heading1")
    yield from table([run(label, bold=True), run(value)] for label, value in summary)
    yield paragraph(run("Findings"), "Heading1")
    none = True
    for name, rows in files:
        none = False
        yield paragraph(run(name), "Heading2")
        cells = [[run(line), run(level.upper(), bold=True, colour=COLOURS.get(level)), run(check), run(title)] for line, level, check, title in rows]
        yield from table([[run(x, bold=True) for x in ("Line", "Severity", "Check", "Title")], *cells])
    if none:
        yield paragraph(run("No findings."))
    if skipped:
        yield paragraph(run("Skipped"), "Heading1")
        yield from (paragraph(run(f"• {entry}")) for entry in skipped)
    yield "<w:sectPr/></w:body></w:document>"


def write(out: BinaryIO, generated: str, summary: list[tuple[str, str]], files: Iterable[tuple[str, list[tuple]]], skipped: list[str]) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**PARTS, "word/styles.xml": styles()}.items():
            z.writestr(name, DECLARATION + text)
        with z.open("word/document.xml", "w") as f:
            f.write(DECLARATION.encode())
            for part in body(generated, summary, files, skipped):
                f.write(part.encode())
