"""Sheets of spreadsheet files as rows of cells."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import decoded, listing

SCHEMA = "path string, sheet string, row long, cells map<string, string>"
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _texts(z: zipfile.ZipFile) -> list[str]:
    """The strings that cells share; one in several runs is their text in a row."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _MAIN + "si":
                out.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                e.clear()
    return out


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Members of sheets by name."""
    to = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return {s.get("name"): "xl/" + to[s.get(_REL)].removeprefix("/xl/") for s in book.iter(_MAIN + "sheet")}


def cells(path: str, f: pa.NativeFile, sheet: str | None = None) -> Iterator[pa.RecordBatch]:
    with zipfile.ZipFile(f) as z:
        shared = _texts(z)
        for name, member in _sheets(z).items():
            if sheet is not None and name != sheet:
                continue
            rows = []
            with z.open(member) as m:
                for _, e in ElementTree.iterparse(m):
                    if e.tag != _MAIN + "row":
                        continue
                    own = {}
                    for c in e.iter(_MAIN + "c"):
                        v, kind = c.find(_MAIN + "v"), c.get("t")
                        value = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                        if value not in (None, ""):
                            own[re.match("[A-Z]+", c.get("r"))[0]] = value
                    rows.append((path, name, int(e.get("r")), list(own.items())))
                    e.clear()
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read(spark: SparkSession, path: str, sheet: str | None = None, first: int = 1, last: int | None = None, glob: str = "*.xlsx") -> DataFrame:
    """Rows of SCHEMA from first to last, of one sheet or all: cells that hold something, by column."""
    out = decoded(listing(spark, path, glob), lambda p, f: cells(p, f, sheet), SCHEMA).where(F.col("row") >= first)
    return out if last is None else out.where(F.col("row") <= last)


def filled(of: str, first: str, last: str) -> Column:
    """How many cells from one column to another (of one letter each) hold something."""
    return F.size(F.filter(F.map_keys(of), lambda c: (F.length(c) == 1) & c.between(first, last))).cast("long")


def book(sheet: str, rows: list[list[str | None]]) -> bytes:
    """A file's bytes with one sheet, strings shared; for tests and exports."""
    import io
    from xml.sax.saxutils import escape

    names: dict[str, int] = {}
    body = []
    for i, r in enumerate(rows, 1):
        own = "".join(f'<c r="{chr(65 + k)}{i}" t="s"><v>{names.setdefault(v, len(names))}</v></c>' for k, v in enumerate(r) if v is not None)
        body.append(f'<row r="{i}">{own}</row>')
    main, rel, doc = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{doc}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t xml:space="preserve">{escape(v)}</t></si>' for v in names)}</sst>")
    return out.getvalue()
