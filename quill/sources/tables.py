"""Spreadsheets: the first sheet of a workbook as lines of "name: value", read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_cell = re.compile(r"([A-Z]+)\d+\Z")


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element) -> str:
    """The text of an element's runs, without phonetic guides."""
    return "".join(t.text or "" for run in element if _tag(run) in ("t", "r") for t in ([run] if _tag(run) == "t" else run) if _tag(t) == "t")


def _column(reference: str | None, default: int) -> int:
    """Number of the column, from 0, of a reference such as BC12."""
    m = _cell.match(reference or "")
    if not m:
        return default
    n = 0
    for c in m.group(1):
        n = 26 * n + ord(c) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    link = next(v for k, v in sheets[0].attrib.items() if k.endswith("}id"))
    target = next(r.attrib["Target"] for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.attrib["Id"] == link)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))


def rows_of(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as texts; missing cells are empty. Rows come one at a time, however long the sheet is."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if _tag(row) != "row":
                    continue
                out: list[str] = []
                for cell in row:
                    at = _column(cell.get("r"), len(out))
                    value = next((x.text or "" for x in cell if _tag(x) == "v"), "")
                    kind = cell.get("t")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(_texts(x) for x in cell if _tag(x) == "is")
                    elif kind == "b":
                        value = str(value == "1")
                    out += [""] * (at - len(out)) + [value]
                yield out
                row.clear()


def records(head: list[str], rows) -> str:
    """A line "name: value | name: value" for each row, without blank and nan cells; rows longer than the head are malformed."""
    lines = (" | ".join(f"{h}: {v.strip()}" for h, v in zip(head, r) if v.strip() and v.strip().lower() != "nan") for r in rows if len(r) <= len(head))
    return "\n".join(line for line in lines if line)


def workbook_text(content: bytes) -> str:
    rows = rows_of(content)
    head = next(rows, None)
    return records(head, rows) if head else ""
