"""Slides of PPTX files as blocks, from the XML inside the archive."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Namespaces of the file format.
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CHART = "http://schemas.openxmlformats.org/drawingml/2006/chart"
SHAPE = ("block_no int, slide_no int, block_type string, section string, text string, table_rows int, table_columns int, "
         "spans array<string>, merged_skipped int, review_reason string")
NAMES = [part.split()[0] for part in SHAPE.split(", ")]


def _text(frame) -> str:
    """Paragraphs by line; a line break inside one is a vertical tab."""
    lines = []
    for paragraph in frame.iter(f"{_A}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{_A}t":
                parts.append(node.text or "")
            elif node.tag == f"{_A}br":
                parts.append("\v")
        lines.append("".join(parts))
    return "\n".join(lines).strip()


def _place(shape) -> tuple[int, int]:
    off = shape.find(f".//{_A}off") if shape.tag != f"{_P}graphicFrame" else shape.find(f"{_P}xfrm/{_A}off")
    return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (type, path) of a part."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in archive.namelist():
        return {}
    out = {}
    for node in ElementTree.fromstring(archive.read(name)):
        target = node.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))
        out[node.get("Id")] = (node.get("Type", "").rsplit("/", 1)[-1], path)
    return out


def table_cells(table) -> tuple[list[list[str]], list[str], int]:
    """(texts by row, spans of merged cells as row,column:rows x columns, covered cells)."""
    rows, spans, covered = [], [], 0
    for r, row in enumerate(table.findall(f"{_A}tr")):
        texts = []
        for c, cell in enumerate(row.findall(f"{_A}tc")):
            if cell.get("hMerge") in ("1", "true") or cell.get("vMerge") in ("1", "true"):
                covered += 1
                continue
            high, wide = int(cell.get("rowSpan", 1)), int(cell.get("gridSpan", 1))
            if high > 1 or wide > 1:
                spans.append(f"{r},{c}:{high}x{wide}")
            texts.append(_text(cell))
        rows.append(texts)
    return rows, spans, covered


def parse(data: bytes) -> list[tuple]:
    """Rows of NAMES. Shapes go from top to bottom, then left to right; the title, tables, images,
    charts and paragraphs are blocks, then the speaker's notes; what cannot be read is a block that
    asks for review, and a slide without anything is one too."""
    out: list[tuple] = []
    archive = zipfile.ZipFile(io.BytesIO(data))
    deck = "ppt/presentation.xml"
    related = _related(archive, deck)
    order = [related[n.get(f"{_R}id")][1] for n in ElementTree.fromstring(archive.read(deck)).iter(f"{_P}sldId")]
    for number, part in enumerate(order, 1):
        tree = ElementTree.fromstring(archive.read(part)).find(f"{_P}cSld/{_P}spTree")
        shapes = [s for s in (tree if tree is not None else []) if s.tag in {f"{_P}{k}" for k in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")}]
        title = ""
        for s in shapes:
            holder = s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            if holder is not None and holder.get("type") in ("title", "ctrTitle") and s.find(f"{_P}txBody") is not None:
                title = title or _text(s.find(f"{_P}txBody"))
        section = title[:200] or f"Slide {number}"
        begun = len(out)

        def emit(kind, text="", rows=None, columns=None, spans=(), covered=None, reason=None, number=number, section=section):
            out.append((len(out) + 1, number, kind, section, text, rows, columns, list(spans), covered, reason))

        for s in sorted(shapes, key=_place):
            table, chart, body = s.find(f".//{_A}tbl"), s.find(f".//{_A}graphicData[@uri='{_CHART}']"), s.find(f"{_P}txBody")
            if table is not None:
                rows, spans, covered = table_cells(table)
                if any(any(r) for r in rows):
                    emit("table", "\n".join(" | ".join(r) for r in rows if r).strip(), len(rows), len(table.findall(f"{_A}tblGrid/{_A}gridCol")), spans, covered)
            elif s.tag == f"{_P}pic":
                emit("image")
            elif chart is not None or body is None:
                emit("other", reason="unexplained_graphic")
            else:
                text = _text(body)
                if title and text == title:
                    emit("heading", title)
                elif text:
                    emit("paragraph", text)
        for kind, path in _related(archive, part).values():
            if kind == "notesSlide" and path in archive.namelist():
                for s in ElementTree.fromstring(archive.read(path)).iter(f"{_P}sp"):
                    holder, body = s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph"), s.find(f"{_P}txBody")
                    if holder is not None and holder.get("type") == "body" and body is not None and _text(body):
                        emit("note", _text(body))
        if len(out) == begun:
            emit("other", reason="empty_slide")
    return out


def slide_blocks(files: DataFrame) -> DataFrame:
    """(key, block_no, slide_no, ...) of files (key long, content binary). A null or damaged file is one
    block with the reason unreadable_file."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, data in zip(pdf["key"], pdf["content"]):
                try:
                    found = parse(data)
                except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    found = [(1, None, "other", "", "", None, None, [], None, "unreadable_file")]
                rows += [(key, *f) for f in found]
            out = pd.DataFrame(rows, columns=["key", *NAMES])
            yield out.astype({c: "Int32" for c in ("block_no", "slide_no", "table_rows", "table_columns", "merged_skipped")})

    return files.select("key", "content").mapInPandas(run, f"key long, {SHAPE}")


def deck(slides: list[tuple[str, list[str]]]) -> bytes:
    """A small file of (title, paragraphs) for each slide, the last paragraph as the speaker's notes if it begins with "Notes: "."""
    import html

    def frame(text: str, kind: str, y: int) -> str:
        lines = "".join(f"<a:p><a:r><a:t>{html.escape(line)}</a:t></a:r></a:p>" for line in text.split("\n"))
        return (f'<p:sp><p:nvSpPr><p:cNvPr id="{y}" name="x"/><p:cNvSpPr/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr>'
                f"<p:txBody>{lines}</p:txBody></p:sp>")

    spaces = f'xmlns:a="{_A[1:-1]}" xmlns:p="{_P[1:-1]}" xmlns:r="{_R[1:-1]}"'
    link = '<Relationship Id="rId{0}" Type="http://x/{1}" Target="{2}"/>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
        archive.writestr("ppt/presentation.xml", f"<p:presentation {spaces}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        archive.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(link.format(k, "slide", f"slides/slide{k}.xml") for k in range(1, len(slides) + 1)) + "</Relationships>")
        for k, (title, paragraphs) in enumerate(slides, 1):
            said = [p for p in paragraphs if not p.startswith("Notes: ")]
            body = (frame(title, '<p:ph type="title"/>', 1) if title else "") + "".join(frame(p, "", 10 + n) for n, p in enumerate(said))
            archive.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {spaces}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
            for p in paragraphs:
                if p.startswith("Notes: "):
                    archive.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", "<Relationships>" + link.format(1, "notesSlide", f"../notesSlides/n{k}.xml") + "</Relationships>")
                    archive.writestr(f"ppt/notesSlides/n{k}.xml", f"<p:notes {spaces}><p:cSld><p:spTree>{frame(p[7:], '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>', 1)}</p:spTree></p:cSld></p:notes>")
    return held.getvalue()
