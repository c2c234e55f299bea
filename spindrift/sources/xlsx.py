"""Worksheets of Office Open XML workbooks (.xlsx) by the standard library alone."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: Numbers of the built-in formats that show days or times.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = datetime.datetime(1899, 12, 30)


def _root(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _text(element: ElementTree.Element) -> str:
    """Text of a string item: its own or its runs', without phonetic hints."""
    plain = element.find(f"{_MAIN}t")
    runs = [plain] if plain is not None else [t for r in element.iter(f"{_MAIN}r") for t in r.iter(f"{_MAIN}t")]
    return "".join(t.text or "" for t in runs)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows days or times."""
    root = _root(archive, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}


def _number(text: str, dated: bool) -> str:
    value = float(text)
    if dated:
        return (_EPOCH + datetime.timedelta(seconds=round(value * 86400))).isoformat(" ")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _column(reference: str) -> int:
    out = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        out = 26 * out + ord(letter) - 64
    return out - 1


def _rows(archive: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> Iterator[list[str | None]]:
    with archive.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                kind, value, inline = cell.get("t", "n"), cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                text = _text(inline) if inline is not None else value.text if value is not None else None
                if text is None or kind == "e":
                    cells[at] = None
                elif kind == "s":
                    cells[at] = strings[int(text)]
                elif kind == "b":
                    cells[at] = "True" if text == "1" else "False"
                elif kind == "n":
                    cells[at] = _number(text, int(cell.get("s", 0)) in dates)
                else:
                    cells[at] = text
            yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
            row.clear()


def sheets(data: bytes) -> Iterator[tuple[str, Iterator[dict[str, str | None]]]]:
    """(sheet name, records) of a workbook; the first row that is not empty names the columns, empty rows are left
    out, and a column without a name is called by its place.  Cells are read one row at a time."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    book, links = _root(archive, "xl/workbook.xml"), _root(archive, "xl/_rels/workbook.xml.rels")
    shared = _root(archive, "xl/sharedStrings.xml")
    strings = [_text(item) for item in shared.iter(f"{_MAIN}si")] if shared is not None else []
    dates = _date_styles(archive)
    target = {link.get("Id"): link.get("Target") for link in links}
    for sheet in book.iter(f"{_MAIN}sheet"):
        part = target[sheet.get(_REL)]
        yield sheet.get("name"), _records(_rows(archive, part.lstrip("/") if part.startswith("/") else f"xl/{part}", strings, dates))


def _records(rows: Iterator[list[str | None]]) -> Iterator[dict[str, str | None]]:
    names: list[str] | None = None
    for row in rows:
        if not any(x not in (None, "") for x in row):
            continue
        if names is None:
            names = [x.strip() if x and x.strip() else f"Unnamed: {k}" for k, x in enumerate(row)]
            continue
        yield {name: row[k] if k < len(row) and row[k] != "" else None for k, name in enumerate(names)}
