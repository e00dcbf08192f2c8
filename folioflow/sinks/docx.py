"""A DOCX file from paragraphs and tables: the four parts that the published format asks for, in a zip."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: Characters that XML has no way to hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _text(value: str | None) -> str:
    return escape(_UNFIT.sub("", value or ""))


def paragraph(text: str | None, bold: bool = False) -> str:
    runs = "<w:br/>".join(f'<w:t xml:space="preserve">{_text(x)}</w:t>' for x in (text or "").split("\n"))
    return f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{runs}</w:r></w:p>"


def table(rows: list[list[str]]) -> str:
    """A table with a border, and the empty paragraph that follows each."""
    edge = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "<w:gridCol/>" * max((len(r) for r in rows), default=0)
    body = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    return f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{body}</w:tbl>{paragraph('')}"


def docx(title: str, lines: list[str], choices: list[str], questions: list[dict], links: list[str]) -> bytes:
    """``questions``: (title, blocks), where a block is a paragraph (``text``) or a table (``cells``)."""
    parts = [paragraph(title, bold=True), *map(paragraph, lines), *map(paragraph, choices)]
    for question in questions or []:
        parts.append(paragraph(question["title"], bold=True))
        parts += [table(b["cells"]) if b["kind"] == "table" else paragraph(b["text"]) for b in question["blocks"] or []]
    parts += map(paragraph, links)
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_MAIN}"><w:body>{"".join(parts)}<w:sectPr/></w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", document)):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)  # the same input gives the same bytes
    return held.getvalue()
