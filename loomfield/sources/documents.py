"""Office documents without office libraries: DOCX and XLSX are zip files of XML.

PDF needs a parser that isn't part of the standard library; pdf_rows() uses one where it is installed."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_docx(data: bytes) -> list[tuple[int, str, str, int]]:
    """(seq, kind, text, level) of headings, paragraphs and tables in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda n: "".join(t.text or "" for t in n.iter(f"{_W}t"))
    out = []
    for n in body if body is not None else ():
        if n.tag == f"{_W}p":
            style = n.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading\s*(\d+)", style.get(f"{_W}val", "") if style is not None else "")
            if t := text(n).strip():
                out.append((len(out), "heading" if m else "paragraph", t, int(m[1]) if m else 0))
        elif n.tag == f"{_W}tbl":
            rows = ["\t".join(text(c).strip() for c in r.iter(f"{_W}tc")) for r in n.iter(f"{_W}tr")]
            out.append((len(out), "table", "\n".join(rows), 0))
    return out


def parse_xlsx(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of all sheets; cells as text, gaps empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            path = targets[s.get(f"{_R}id")]
            for i, row in enumerate(ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{_S}row")):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    value = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "") if v is not None else ""
                    cells += [""] * max(0, at - 1 - len(cells)) + [value]
                out.append((s.get("name"), i, cells))
    return out


def _rows(files: DataFrame, parse, schema: str, kinds: Sequence[pa.DataType], names: Sequence[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse(d)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), *kinds))], ["path", *names])

    return files.select("path", "content").mapInArrow(run, schema)


def docx_rows(files: DataFrame) -> DataFrame:
    """files: path, content.  (path, seq, kind, text, level)."""
    return _rows(files, parse_docx, "path string, seq int, kind string, text string, level int", (pa.int32(), pa.string(), pa.string(), pa.int32()), ("seq", "kind", "text", "level"))


def xlsx_rows(files: DataFrame) -> DataFrame:
    """files: path, content.  (path, sheet, row, cells)."""
    return _rows(files, parse_xlsx, "path string, sheet string, row int, cells array<string>", (pa.string(), pa.int32(), pa.list_(pa.string())), ("sheet", "row", "cells"))


_CORE = ("title", "creator", "subject", "keywords", "description", "created", "modified")


def docx_properties(files: DataFrame) -> DataFrame:
    """(path, name, value) of the core properties of DOCX files, those of _CORE that are there."""

    def parse(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if "docProps/core.xml" not in z.namelist():
                return []
            held = {n.tag.rsplit("}", 1)[-1]: (n.text or "").strip() for n in ET.fromstring(z.read("docProps/core.xml"))}
        return [(k, held[k]) for k in _CORE if held.get(k)]

    return _rows(files, parse, "path string, name string, value string", (pa.string(), pa.string()), ("name", "value"))


def pdf_tables(files: DataFrame) -> DataFrame:
    """(path, page, table, row, cells) where the pdfplumber library is installed on the executors."""

    def parse(data: bytes):
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("tables of PDF files need pdfplumber on every executor") from e
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [(i, j, k, [c or "" for c in row]) for i, page in enumerate(pdf.pages, 1) for j, t in enumerate(page.extract_tables() or []) for k, row in enumerate(t)]

    return _rows(files, parse, "path string, page int, table int, row int, cells array<string>", (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())), ("page", "table", "row", "cells"))


def document_texts(files: DataFrame, pdf: bool = True) -> DataFrame:
    """(path, kind, text, error) of files by their extension: DOCX paragraphs and XLSX cells by line, PDF pages if
    ``pdf``; other kinds, and files that can't be read, have an error instead of a text."""

    def text(path: str, data: bytes) -> tuple[str, str | None, str | None]:
        kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        try:
            if kind == "docx":
                return kind, "\n".join(t for _, _, t, _ in parse_docx(data)), None
            if kind == "xlsx":
                return kind, "\n".join("\t".join(cells) for _, _, cells in parse_xlsx(data)), None
            if kind == "pdf" and pdf:
                return kind, "\n".join(t for _, t in _pdf_pages(data)), None
        except Exception as e:  # one bad file is a row, not the end of the job
            return kind, None, f"{type(e).__name__}: {e}"
        return kind, None, "unsupported format"

    def run(batches):
        for b in batches:
            rows = [(p, *text(p, d)) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["path", "kind", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, text string, error string")


def sqlite_rows(files: DataFrame, query: str, schema: str) -> DataFrame:
    """path and the rows of a query over each SQLite file; schema: the query's columns.  Files are read as they
    are in the store, in memory, a task a file or more."""
    from pyspark.sql import functions as F

    def parse(data: bytes):
        con = sqlite3.connect(":memory:")
        con.deserialize(data)
        con.row_factory = sqlite3.Row
        try:
            return [(json.dumps(dict(r), default=str),) for r in con.execute(query)]
        finally:
            con.close()

    rows = _rows(files, parse, "path string, json string", (pa.string(),), ("json",))
    return rows.select("path", F.from_json("json", schema).alias("r")).select("path", "r.*")


def _pdf_pages(data: bytes) -> list[tuple[int, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf on every executor") from e
    return [(i + 1, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages)]


def pdf_rows(files: DataFrame) -> DataFrame:
    """(path, page, text) where the pypdf library is installed on the executors."""
    return _rows(files, _pdf_pages, "path string, page int, text string", (pa.int32(), pa.string()), ("page", "text"))


_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(parts: Mapping[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def make_docx(paragraphs: Sequence[tuple[str | None, str]], tables: Sequence[Sequence[Sequence[str]]] = (), properties: Mapping[str, str] | None = None) -> bytes:
    p = lambda t, s=None: "<w:p>" + (f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else "") + f"<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    body = "".join(p(t, s) for s, t in paragraphs) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    core = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in (properties or {}).items())
    return _zip(({"docProps/core.xml": f'<?xml version="1.0"?><coreProperties>{core}</coreProperties>'} if core else {}) | {
        "[Content_Types].xml": _TYPES.format('<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'),
        "_rels/.rels": _RELS.format(f'<Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/>'),
        "word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>',
    })


def make_xlsx(sheets: Mapping[str, Sequence[Sequence[object]]]) -> bytes:
    """A workbook of a bounded result; numbers stay numbers, all else is text."""

    def cell(i: int, j: int, v: object) -> str:
        col, n = "", j + 1
        while n:
            n, r = divmod(n - 1, 26)
            col = chr(65 + r) + col
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{col}{i + 1}"><v>{v}</v></c>'
        return f'<c r="{col}{i + 1}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    parts = {
        "[Content_Types].xml": _TYPES.format(
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        ),
        "_rels/.rels": _RELS.format(f'<Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'),
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _RELS.format("".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))),
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<?xml version="1.0"?><worksheet xmlns="{_S[1:-1]}"><sheetData>{body}</sheetData></worksheet>'
    return _zip(parts)
