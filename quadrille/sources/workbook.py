"""Any workbook: the format is found by content, not by name. Parts of .xlsx files besides cells.

    register(spark)
    spark.read.format("workbook").load("/books/*")                            # cells of .xlsx, .xls, .ods and .fods
    spark.read.format("workbook").option("part", "merges").load("/books/*")   # parts of .xlsx: see PARTS
"""

from __future__ import annotations

import glob
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrille.sources import ods, xls, xlsx

PARTS = {
    "cells": xlsx.CELLS,
    "sheets": "file string, position int, sheet string, state string",
    "names": "file string, name string, sheet string, ref string",
    "properties": "file string, name string, value string",
    "merges": "file string, sheet string, ref string",
    "hidden": "file string, sheet string, axis string, first int, last int",
    "widths": "file string, sheet string, first int, last int, width double",
    "links": "file string, sheet string, ref string, target string, tooltip string",
    "validations": "file string, sheet string, ref string, type string, operator string, formula1 string, formula2 string, allow_blank boolean",
    "comments": "file string, sheet string, ref string, author string, text string",
}
_FLAT = re.compile(rb"<(?:\w+:)?document\b[^>]*opendocument", re.S)


def sniff(path: str) -> str:
    """xls, ods or xlsx."""
    with open(path, "rb") as f:
        head = f.read(16384)
    if head[:8] == xls.SIGNATURE:
        return "xls"
    if _FLAT.search(head):
        return "ods"
    with zipfile.ZipFile(path) as z:
        if "mimetype" in z.namelist():
            return "ods"
    return "xlsx"


def _yes(text: str | None) -> bool:
    return text in ("1", "true")


def _folder_rels(book: xlsx.Workbook, part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    return {i: (kind, target) for i, kind, target in book._rels(f"{folder}/_rels/{name}.rels".lstrip("/"), folder)}


def _catalog(book: xlsx.Workbook, part: str) -> Iterator[tuple]:
    root = book._tree(book.main)
    sheets = [e for e in root.iter() if xlsx._local(e.tag) == "sheet"]
    if part == "sheets":
        for k, e in enumerate(sheets):
            yield k, e.get("name"), e.get("state") or "visible"
    elif part == "names":
        for e in root.iter():
            if xlsx._local(e.tag) == "definedName":
                k = e.get("localSheetId")
                yield e.get("name"), sheets[int(k)].get("name") if k and int(k) < len(sheets) else None, e.text
    else:
        for _, kind, target in book._rels("_rels/.rels", ""):
            if kind in ("core-properties", "extended-properties") and target.lower() in book.names:
                for e in book._tree(target):
                    if not len(e) and e.text:
                        yield xlsx._local(e.tag), e.text


def _furniture(book: xlsx.Workbook, sheet_part: str, part: str) -> Iterator[tuple]:
    """Rows of one sheet, without file and sheet. The cells of the sheet are skipped as they stream by."""
    rels = _folder_rels(book, sheet_part)
    if part == "comments":
        for kind, target in rels.values():
            if kind == "comments":
                root = book._tree(target)
                authors = [e.text or "" for e in root.iter() if xlsx._local(e.tag) == "author"]
                for e in root.iter():
                    if xlsx._local(e.tag) == "comment":
                        k = int(e.get("authorId") or -1)
                        body = next((x for x in e if xlsx._local(x.tag) == "text"), [])
                        yield e.get("ref"), authors[k] if 0 <= k < len(authors) else None, xlsx._text(body)
        return
    last = 0
    with book.open(sheet_part) as f:
        for _, e in xlsx.iterparse(f):
            name = xlsx._local(e.tag)
            if name == "row":
                last = int(e.get("r") or last + 1)
                if part == "hidden" and _yes(e.get("hidden")):
                    yield "row", last, last
                e.clear()
            elif name == "col" and part == "hidden" and _yes(e.get("hidden")):
                yield "column", int(e.get("min")), int(e.get("max"))
            elif name == "col" and part == "widths" and e.get("width"):
                yield int(e.get("min")), int(e.get("max")), float(e.get("width"))
            elif name == "mergeCell" and part == "merges":
                yield (e.get("ref"),)
            elif name == "hyperlink" and part == "links":
                rel = next((v for k, v in e.attrib.items() if xlsx._local(k) == "id" and "}" in k), None)
                place = e.get("location")
                target = rels[rel][1] + (f"#{place}" if place else "") if rel in rels else f"#{place}" if place else None
                yield e.get("ref"), target, e.get("tooltip")
            elif name == "dataValidation" and part == "validations":
                inner = {xlsx._local(x.tag): "".join(x.itertext()) for x in e}
                yield e.get("sqref") or inner.get("sqref"), e.get("type") or "none", e.get("operator"), inner.get("formula1"), inner.get("formula2"), _yes(e.get("allowBlank"))


@dataclass
class _Part(InputPartition):
    file: str
    kind: str
    sheet: str | None
    at: object


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only, self.part = options["path"].removeprefix("file:"), options.get("sheetname"), options.get("part", "cells")
        self.every = options.get("sheets") == "all" or (self.part != "cells" and self.only is None)

    def partitions(self):
        out: list[InputPartition] = []
        for f in sorted(glob.glob(self.path)):
            kind = sniff(f)
            if self.part != "cells" and kind != "xlsx":
                raise ValueError(f"{f}: of .{kind} files only cells are read")
            if kind == "ods" or self.part in ("sheets", "names", "properties"):
                out.append(_Part(f, kind, None, None))
            elif kind == "xls":
                out += [_Part(f, kind, name, at) for name, _, at in xlsx.chosen(xls._load(f).sheets, self.only, self.every)]
            else:
                out += [_Part(f, kind, name, at) for name, at in xlsx.chosen(xlsx.Workbook(f).sheets, self.only, self.every)]
        return out

    def read(self, p):
        if self.part != "cells":
            book = xlsx.Workbook(p.file)
            if p.sheet is None:
                yield from ((p.file, *x) for x in _catalog(book, self.part))
            else:
                yield from ((p.file, p.sheet, *x) for x in _furniture(book, p.at, self.part))
        elif p.kind == "ods":
            yield from xlsx.cell_batches((p.file, *x) for x in ods.read_cells(p.file, self.only, self.every))
        elif p.kind == "xls":
            for row, col, *cell in xls._load(p.file).cells(p.at):
                yield p.file, p.sheet, row + 1, col, *cell, None
        else:
            yield from xlsx.cell_batches((p.file, p.sheet, row, *cell) for row, cells in xlsx.Workbook(p.file).rows(p.at) for cell in cells)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        part = self.options.get("part", "cells")
        if part not in PARTS:
            raise ValueError(f"part is one of {', '.join(PARTS)}")
        return PARTS[part]

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
