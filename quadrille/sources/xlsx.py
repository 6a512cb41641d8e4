"""Workbooks (.xlsx) as a Spark data source and sink.

Reading: one partition a file and sheet; each yields cells in long form, as read from the sheet's XML by a streaming
parser. Without sheetName the first sheet is read. Writing: each task writes its rows' XML (quadrille.sources.fragments).

    register(spark)
    spark.read.format("xlsx").option("sheetName", "Data").load("/books/*.xlsx")
    df.write.format("xlsx").option("sheetName", "Data").mode("overwrite").save("/books/out.xlsx")
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import io
import itertools
import math
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import fromstring, iterparse, parse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrille.functions.dates import DATE_FORMAT_IDS, datetime_to_serial, is_date_format, iso, serial_to_datetime
from quadrille.functions.refs import absolute, column_letters, column_number, parse_ref, shift_formula
from quadrille.sources.fragments import FragmentWriter

CELLS = "file string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string"
MAX_ROWS, MAX_COLS, MAX_TEXT = 1_048_576, 16_384, 32_767


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _decode(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _text(element) -> str:
    """The text of a string item: its runs, without phonetic ones."""
    return _decode("".join(t.text or "" for run in element for t in ([run] if _local(run.tag) == "t" else run if _local(run.tag) == "r" else []) if _local(t.tag) == "t"))


#: A row and its cells as most programs write them; attributes in this order, no formula, no runs.
_PLAIN_ROW = re.compile(r'\s*<row(?: r="([1-9][0-9]{0,6})")?(?: [a-zA-Z:0-9]+="[^"<>]*")*(?:/>|>(.*?)</row>)', re.S)
_PLAIN_CELL = re.compile(r'<c(?: r="([A-Z]{1,3})[0-9]+")?(?: s="([0-9]+)")?(?: t="([a-zA-Z]+)")?(?:/>|>(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)')


def _plain_text(text: str) -> str:
    if "&" in text or "\r" in text:
        text = _entities(text)
    return _decode(text) if "_x" in text else text


def _entities(text: str) -> str:
    """Text with entities, as a parser reads it."""
    return fromstring(f"<t>{text}</t>").text or ""


class Workbook:
    """The parts of an .xlsx file, found through its relationships."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        self.names = {n.lower(): n for n in self.zip.namelist()}
        self.main = next(t for _, kind, t in self._rels("_rels/.rels", "") if kind == "officeDocument")
        folder, _, name = self.main.rpartition("/")
        rels = {i: (kind, t) for i, kind, t in self._rels(f"{folder}/_rels/{name}.rels".lstrip("/"), folder)}
        self.sheets, self.date1904 = [], False
        for e in self._tree(self.main).iter():
            if _local(e.tag) == "sheet":
                rel = next(v for k, v in e.attrib.items() if _local(k) == "id" and "}" in k)
                if rels[rel][0] == "worksheet":
                    self.sheets.append((e.get("name"), rels[rel][1]))
            elif _local(e.tag) == "workbookPr":
                self.date1904 = e.get("date1904") in ("1", "true")
        self.parts = {kind: t for kind, t in rels.values()}

    def open(self, part: str):
        return self.zip.open(self.names[part.lower()])

    def _tree(self, part: str):
        with self.open(part) as f:
            return parse(f).getroot()

    def _rels(self, part: str, folder: str) -> list[tuple[str, str, str]]:
        if part.lower() not in self.names:
            return []
        out = []
        for e in self._tree(part):
            t = e.get("Target")
            t = t[1:] if t.startswith("/") else os.path.normpath(os.path.join(folder, t)) if e.get("TargetMode") != "External" else t
            out.append((e.get("Id"), e.get("Type").rpartition("/")[2], t))
        return out

    def strings(self) -> list[str]:
        if "sharedStrings" not in self.parts:
            return []
        return [_text(e) for e in self._tree(self.parts["sharedStrings"]) if _local(e.tag) == "si"]

    def date_styles(self) -> set[int]:
        if "styles" not in self.parts:
            return set()
        codes, out, root = {}, set(), self._tree(self.parts["styles"])
        for e in root.iter():
            if _local(e.tag) == "numFmt":
                codes[int(e.get("numFmtId"))] = e.get("formatCode") or ""
        for group in root:
            if _local(group.tag) == "cellXfs":
                for k, xf in enumerate(group):
                    n = int(xf.get("numFmtId") or 0)
                    if is_date_format(codes[n]) if n in codes else n in DATE_FORMAT_IDS:
                        out.add(k)
        return out

    def rows(self, part: str, most: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
        """Row number, and (col from 0, kind, num, str, bool, err, formula) of each cell; most bounds the bytes of the
        part. Most files write a row's plain cells in one way, which one expression takes; a sheet with anything else
        is parsed as XML from its first such row on."""
        if most is not None and self.zip.getinfo(self.names[part.lower()]).file_size > most:
            raise ValueError(f"{part} has more than {most} bytes")
        done = 0
        for row, cells in self._plain_rows(part):
            if cells is None:
                break
            done += 1
            yield row, cells
        else:
            return
        yield from itertools.islice(self._parsed_rows(part), done, None)

    def _plain_rows(self, part: str) -> Iterator[tuple[int, list[tuple] | None]]:
        """Rows of plain cells; (0, None) where there is something else."""
        strings, dates, last, held = self.strings(), self.date_styles(), 0, ""
        places: dict[str, int] = {}
        with self.open(part) as raw:
            f = io.TextIOWrapper(raw, encoding="utf-8", errors="strict", newline="")
            begun = False
            while True:
                block = f.read(1 << 18)
                held += block
                if not begun:
                    at = held.find("<sheetData>")
                    if at < 0:
                        if block and len(held) < 1 << 22:
                            continue
                        yield 0, None
                        return
                    if "<!" in held[:at] or ("encoding=" in held[:200] and not re.search("encoding=.utf-8", held[:200], re.I)):
                        yield 0, None
                        return
                    held, begun = held[at + 11 :], True
                stop = held.find("</sheetData>")
                end = stop if stop >= 0 else held.rfind("</row>") + 6
                if end > 5 or stop >= 0:
                    text, at = held[:end], 0
                    for m in _PLAIN_ROW.finditer(text):
                        if m.start() != at:
                            break
                        at = m.end()
                        last = int(m[1]) if m[1] else last + 1
                        cells, place, found = [], -1, _PLAIN_CELL.findall(m[2] or "")
                        if len(found) != (m[2] or "").count("<c"):
                            yield 0, None
                            return
                        for letters, style, kind, value, inline in found:
                            if letters:
                                place = places.get(letters)
                                if place is None:
                                    place = places[letters] = column_number(letters) - 1
                            else:
                                place += 1
                            if place >= MAX_COLS:
                                raise ValueError(f"column {place + 1} is beyond the sheet")
                            cells.append((place, *self._plain_cell(kind, style, value, inline, strings, dates)))
                        yield last, cells
                    if text[at:].strip():
                        yield 0, None
                        return
                    if stop >= 0:
                        return
                    held = held[end:]
                if not block:
                    yield 0, None  # cut off: the parser says where
                    return

    def _plain_cell(self, kind: str, style: str, value: str, inline: str, strings: list[str], dates: set[int]) -> tuple:
        if not kind or kind == "n":
            if value == "":
                return "z", None, None, None, None, None
            try:
                x = float(value) + 0.0
            except ValueError:
                return "s", None, _entities(value), None, None, None
            if style and int(style) in dates:
                return "d", x, iso(serial_to_datetime(x, self.date1904)), None, None, None
            return "n", x, None, None, None, None
        if kind == "inlineStr":
            return "s", None, _plain_text(inline), None, None, None
        if kind == "s" and value.isdigit():
            k = int(value)
            return ("s", None, strings[k], None, None, None) if k < len(strings) else ("z", None, None, None, None, None)
        if kind == "str":
            return "s", None, _plain_text(value), None, None, None
        if value == "":
            return "z", None, None, None, None, None
        if kind == "b":
            return "b", None, None, value.strip() in ("1", "true"), None, None
        if kind == "e":
            return "e", None, None, None, _entities(value), None
        if kind == "d" and (when := _iso_moment(value.strip())):
            return "d", datetime_to_serial(when, self.date1904), iso(when), None, None, None
        return ("z", None, None, None, None, None) if kind == "s" else ("s", None, _entities(value), None, None, None)

    def _parsed_rows(self, part: str) -> Iterator[tuple[int, list[tuple]]]:
        """rows() of any XML: read rows are taken out of the tree, so memory holds one row."""
        strings, dates, last = self.strings(), self.date_styles(), 0
        anchors: dict[str, tuple[str, int, int]] = {}
        with self.open(part) as f:
            parents: list = []
            for event, e in iterparse(f, ("start", "end")):
                if event == "start":
                    parents.append(e)
                    continue
                parents.pop()
                if not e.tag.endswith("row") or _local(e.tag) != "row":
                    continue
                given = e.get("r") or ""
                last = int(given) if given.isascii() and given.isdigit() and int(given) > 0 else last + 1
                cells, place = [], -1
                for c in e:
                    if _local(c.tag) == "c":
                        letters = re.match("[A-Za-z]*", c.get("r") or "")[0]
                        place = column_number(letters) - 1 if letters else place + 1
                        if place >= MAX_COLS:
                            raise ValueError(f"column {place + 1} is beyond the sheet")
                        *cell, formula = self._cell(c, strings, dates)
                        cells.append((place, *cell, self._shared(c, formula, last, place, anchors)))
                yield last, cells
                if parents:
                    parents[-1].clear()

    def _shared(self, c, formula: str | None, row: int, col: int, anchors: dict[str, tuple[str, int, int]]) -> str | None:
        """The formula of a cell; a follower of a shared formula has its anchor's, moved to its place."""
        f = next((e for e in c if _local(e.tag) == "f"), None)
        if f is None or f.get("t") != "shared" or f.get("si") is None:
            return formula
        if formula:
            if f.get("ref"):
                anchors[f.get("si")] = formula, row, col
            return formula
        if f.get("si") not in anchors:
            return formula
        text, r, k = anchors[f.get("si")]
        return shift_formula(text, row - r, col - k)

    def _cell(self, c, strings: list[str], dates: set[int]) -> tuple:
        kind, formula, value, inline = c.get("t") or "n", None, None, None
        for e in c:
            name = _local(e.tag)
            if name == "v":
                value = e.text
            elif name == "f":
                formula = e.text
            elif name == "is":
                inline = _text(e)
        if kind == "inlineStr":
            return "s", None, inline or "", None, None, formula
        if kind == "str":
            return "s", None, _decode(value or ""), None, None, formula
        if value is None or value == "":
            return "z", None, None, None, None, formula
        if kind == "s":
            k = int(value) if value.strip().isdigit() else -1
            return ("s", None, strings[k], None, None, formula) if 0 <= k < len(strings) else ("z", None, None, None, None, formula)
        if kind == "b":
            return "b", None, None, value.strip() in ("1", "true"), None, formula
        if kind == "e":
            return "e", None, None, None, value, formula
        if kind == "d":
            when = _iso_moment(value.strip())
            return ("d", datetime_to_serial(when, self.date1904), iso(when), None, None, formula) if when else ("s", None, value, None, None, formula)
        try:
            x = float(value) + 0.0
        except ValueError:
            return "s", None, value, None, None, formula
        style = c.get("s") or "0"
        if style.isdigit() and int(style) in dates:
            return "d", x, iso(serial_to_datetime(x, self.date1904)), None, None, formula
        return "n", x, None, None, None, formula


def _iso_moment(text: str) -> dt.datetime | None:
    """A cell's ISO date; without a zone it is UTC."""
    try:
        when = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    return when.astimezone(dt.timezone.utc).replace(tzinfo=None) if when.tzinfo else when


@dataclass
class _Sheet(InputPartition):
    file: str
    sheet: str
    part: str


def chosen(sheets: list[tuple], only: str | None, every: bool) -> list[tuple]:
    """The sheet of a name, each, or the first one."""
    return sheets if every else [s for s in sheets if s[0] == only] if only is not None else sheets[:1]


class _Reader(DataSourceReader):
    """sheetName names the sheet; without it the first one is read, and with sheets=all each."""

    def __init__(self, options):
        self.path, self.only, self.all = options["path"].removeprefix("file:"), options.get("sheetname"), options.get("sheets") == "all"
        self.most = int(options["maxuncompressedbytes"]) if options.get("maxuncompressedbytes") else None

    def partitions(self):
        out = []
        for f in sorted(glob.glob(self.path)):
            out += [_Sheet(f, name, part) for name, part in chosen(Workbook(f).sheets, self.only, self.all)]
        return out

    def read(self, partition):
        yield from cell_batches((partition.file, partition.sheet, row, *cell) for row, cells in Workbook(partition.file).rows(partition.part, self.most) for cell in cells)


_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string()]


def cell_batches(cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Cells in the columns of CELLS, as Arrow batches."""
    names = [x.split()[0] for x in CELLS.split(", ")]
    while some := list(itertools.islice(cells, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _KINDS)], names=names)


def _number_xml(ref: str, x) -> str:
    return f'<c r="{ref}"><v>{x}</v></c>'


def _date_xml(ref: str, value: dt.date) -> str:
    when = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
    serial = datetime_to_serial(when.replace(tzinfo=None))
    return f'<c r="{ref}" s="{2 if serial == int(serial) else 1}"><v>{serial!r}</v></c>'


_CELL_XML = {
    type(None): lambda ref, x: "", bool: lambda ref, x: f'<c r="{ref}" t="b"><v>{int(x)}</v></c>', int: _number_xml, decimal.Decimal: _number_xml,
    float: lambda ref, x: f'<c r="{ref}"><v>{x}</v></c>' if math.isfinite(x) else f'<c r="{ref}" t="e"><v>#NUM!</v></c>', dt.date: _date_xml, dt.datetime: _date_xml,
    str: lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_escaped(x)}</t></is></c>',
}


def cell_xml(ref: str, value) -> str:
    known = _CELL_XML.get(type(value))
    return known(ref, value) if known else _date_xml(ref, value) if isinstance(value, dt.date) else _CELL_XML[str](ref, str(value))


_ODD_TEXT = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\r\ufffe\uffff]")


def _escaped(text: str) -> str:
    if "_x" in text:
        text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    if len(text) > MAX_TEXT // 2 and len(text.encode("utf-16-le")) // 2 > MAX_TEXT:
        raise ValueError(f"a cell holds {MAX_TEXT} characters at most")
    return escape(_ODD_TEXT.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


class _Writer(FragmentWriter):
    """The file has one sheet, with the column names as its first row. Options, those with structure as JSON: sheetName,
    widths ([12, null, 30]), freeze ("B2"), merges (["A1:B1"]), autoFilter ("A1:C9"), links ({"A2": "https://..."} or
    "#Sheet!A1"), validations ([{"range", "type", "operator", "formula1", "formula2", "list"}]), conditionalFormats
    ([{"range", "xml"}]), protect (a password), printArea, landscape, names ({"Rate": "0.2"}), title, creator, sheetRows
    (rows go on in further sheets; these have the first one's widths, panes, validations, formats and protection)."""

    def row_xml(self, number, values):
        cells = "".join([cell_xml(f"{letters}{number}", x) for (letters, _), x in zip(self.columns(), values)])
        return f'<row r="{number}">{cells}</row>'

    def columns(self):
        if not hasattr(self, "_columns"):
            if len(self.names) > MAX_COLS:
                raise ValueError(f"a sheet has {MAX_COLS} columns at most")
            self._columns = [(column_letters(k), n) for k, n in enumerate(self.names, 1)]
        return self._columns

    def book(self, sheets):
        for name, _ in sheets:
            check_sheet_name(name)
        names = dict(self.option("names") or {})
        if self.option("printArea"):
            names["_xlnm.Print_Area"] = f"{_sheet_ref(self.sheet)}!{absolute(self.option('printArea'))}"
        if self.option("autoFilter"):
            names["_xlnm._FilterDatabase"] = f"{_sheet_ref(self.sheet)}!{absolute(self.option('autoFilter'))}"
        parts = _fixed_parts(self.sheet, names, self.option("title"), self.option("creator"), [n for n, _ in sheets[1:]])
        header, out = "".join(cell_xml(f"{k}1", n) for k, n in self.columns()), []
        for k, (_, rows) in enumerate(sheets, 1):
            extra, rels = self._after_rows(k == 1)
            head = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}" xmlns:r="{_REL}">{self._before_rows()}<sheetData><row r="1">{header}</row>'
            if rels:
                parts[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = f'<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>'
            out.append((f"xl/worksheets/sheet{k}.xml", [head.encode(), *rows, f"</sheetData>{extra}</worksheet>".encode()]))
        return [(n, [x.encode()]) for n, x in parts.items()] + out

    def _before_rows(self):
        out = ""
        if freeze := self.option("freeze"):
            box = parse_ref(freeze)
            if box is None or box.b is not None:
                raise ValueError(f"freeze takes a cell, not {freeze!r}")
            col, row = box.a.col - 1, box.a.row - 1
            pane = "bottomRight" if col and row else "bottomLeft" if row else "topRight"
            out += f'<sheetViews><sheetView workbookViewId="0"><pane{f" xSplit=\"{col}\"" if col else ""}{f" ySplit=\"{row}\"" if row else ""} topLeftCell="{freeze}" activePane="{pane}" state="frozen"/></sheetView></sheetViews>'
        if widths := self.option("widths"):
            out += "<cols>" + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1) if w is not None) + "</cols>"
        return out

    def _after_rows(self, first: bool = True):
        """What follows the rows, in the order that the format asks for, and the sheet's relationships. Filter, merges and
        links are the first sheet's."""
        out, rels = "", ""
        if (password := self.option("protect")) is not None:
            out += f'<sheetProtection password="{password_hash(str(password))}" sheet="1" objects="1" scenarios="1"/>'
        if first and self.option("autoFilter"):
            out += f"<autoFilter ref={_quoted(self.option('autoFilter'))}/>"
        if first and (merges := self.option("merges")):
            boxes = [_box(m) for m in merges]
            if any(a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3] for k, a in enumerate(boxes) for b in boxes[:k]):
                raise ValueError("merges overlap")
            out += f'<mergeCells count="{len(merges)}">' + "".join(f"<mergeCell ref={_quoted(m)}/>" for m in merges) + "</mergeCells>"
        for k, rule in enumerate(self.option("conditionalFormats") or [], 1):
            out += f"<conditionalFormatting sqref={_quoted(rule['range'])}>{rule_xml(rule, k)}</conditionalFormatting>"
        if checks := self.option("validations"):
            out += f'<dataValidations count="{len(checks)}">' + "".join(map(_validation_xml, checks)) + "</dataValidations>"
        if first and (links := self.option("links")):
            out += "<hyperlinks>"
            for k, (ref, target) in enumerate(links.items(), 1):
                if target.startswith("#"):
                    out += f"<hyperlink ref={_quoted(ref)} location={_quoted(target[1:])}/>"
                else:
                    out += f'<hyperlink ref={_quoted(ref)} r:id="rId{k}"/>'
                    rels += f'<Relationship Id="rId{k}" Type="{_REL}/hyperlink" Target={_quoted(target)} TargetMode="External"/>'
            out += "</hyperlinks>"
        if self.option("landscape"):
            out += '<pageSetup orientation="landscape"/>'
        return out, rels


def check_sheet_name(name: str) -> None:
    if not re.fullmatch(r"[^\[\]:*?/\\]{1,31}", name) or name[0] == "'" or name[-1] == "'":
        raise ValueError(f"sheet name {name!r} can't be used")


def _sheet_ref(name: str) -> str:
    return name if re.fullmatch(r"[^\W\d]\w*", name) else "'" + name.replace("'", "''") + "'"


def _box(text: str) -> tuple[int, int, int, int]:
    ref = parse_ref(text)
    if ref is None or ref.a.col is None or ref.a.row is None:
        raise ValueError(f"{text!r} is no range")
    b = ref.b or ref.a
    return min(ref.a.row, b.row), min(ref.a.col, b.col), max(ref.a.row, b.row), max(ref.a.col, b.col)


def password_hash(password: str) -> str:
    """The sheet hash of quadrille.functions.text.sheet_password, for a writer's option."""
    h = 0
    for c in reversed(password):
        h = (h ^ ord(c)) << 1
        h = (h & 0x7FFF) | (h >> 15)
    return f"{h ^ len(password) ^ 0xCE4B:X}"


def _validation_xml(v: dict) -> str:
    first = v.get("formula1")
    if v.get("list") is not None:
        first = '"' + ",".join(map(str, v["list"])).replace('"', '""') + '"'
        if len(first) > 257:
            raise ValueError("a list of values has 255 characters at most")
    formulas = "".join(f"<formula{k}>{escape(str(f).removeprefix('='))}</formula{k}>" for k, f in ((1, first), (2, v.get("formula2"))) if f is not None)
    operator = f" operator={_quoted(v['operator'])}" if v.get("operator") else ""
    return f"<dataValidation type={_quoted(v['type'])}{operator} allowBlank=\"{int(v.get('allowBlank', True))}\" sqref={_quoted(v['range'])}>{formulas}</dataValidation>"


def rule_xml(rule: dict, priority: int) -> str:
    """A conditional format: type and what that type takes (operator, formulas, rank, percent, bottom, text, colors,
    icons, low, high), as quadrille.operators.rules evaluates it."""
    kind, top_left = rule["type"], rule["range"].partition(":")[0]
    flag = lambda name: f' {name}="1"' if rule.get(name) else ""
    attributes, body = "", "".join(f"<formula>{escape(str(f).removeprefix('='))}</formula>" for f in rule.get("formulas", []))
    if kind == "cellIs":
        attributes = f" operator={_quoted(rule['operator'])}"
    elif kind == "top10":
        attributes = f' rank="{rule["rank"]}"' + flag("percent") + flag("bottom")
    elif kind == "aboveAverage":
        attributes = ' aboveAverage="0"' if rule.get("below") else ""
    elif kind in ("containsText", "notContainsText", "beginsWith", "endsWith"):
        text = '"' + rule["text"].replace('"', '""') + '"'
        test = {
            "containsText": f"NOT(ISERROR(SEARCH({text},{top_left})))", "notContainsText": f"ISERROR(SEARCH({text},{top_left}))",
            "beginsWith": f"LEFT({top_left},LEN({text}))={text}", "endsWith": f"RIGHT({top_left},LEN({text}))={text}",
        }[kind]
        attributes, body = f" operator={_quoted({'notContainsText': 'notContains'}.get(kind, kind))} text={_quoted(rule['text'])}", f"<formula>{escape(test)}</formula>"
    elif kind == "dataBar":
        ends = [f'<cfvo type="num" val="{rule[e]}"/>' if rule.get(e) is not None else f'<cfvo type="{o}"/>' for e, o in (("low", "min"), ("high", "max"))]
        body = f"<dataBar>{''.join(ends)}<color rgb={_quoted(rule['color'])}/></dataBar>"
    elif kind == "colorScale":
        stops = ['<cfvo type="min"/>', *(['<cfvo type="percentile" val="50"/>'] if len(rule["colors"]) == 3 else []), '<cfvo type="max"/>']
        body = f"<colorScale>{''.join(stops)}{''.join(f'<color rgb={_quoted(c)}/>' for c in rule['colors'])}</colorScale>"
    elif kind == "iconSet":
        n = int(rule["icons"][0])
        body = f"<iconSet iconSet={_quoted(rule['icons'])}{flag('reverse')}>" + "".join(f'<cfvo type="percent" val="{round(100 * k / n)}"/>' for k in range(n)) + "</iconSet>"
    return f'<cfRule type={_quoted(kind)} priority="{priority}"{attributes}>{body}</cfRule>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _fixed_parts(sheet: str, names: dict[str, str] | None = None, title: str | None = None, creator: str | None = None, more: list[str] | tuple = ()) -> dict[str, str]:
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    defined = "".join(f'<definedName name={_quoted(n)}{" localSheetId=\"0\"" if n.startswith("_xlnm") else ""}>{escape(str(f).removeprefix("="))}</definedName>' for n, f in (names or {}).items())
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(2, len(more) + 2))
    listed = "".join(f'<sheet name={_quoted(n)} sheetId="{k}" r:id="rId{k + 1}"/>' for k, n in enumerate(more, 2))
    rels = "".join(f'<Relationship Id="rId{k + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(2, len(more) + 2))
    out = {
        "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/>{types}<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/><Relationship Id="rId2" Type="{_PKG}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="{_PKG}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">' + (f"<dc:title>{escape(title)}</dc:title>" if title else "") + (f"<dc:creator>{escape(creator)}</dc:creator>" if creator else "") + "</cp:coreProperties>",
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={_quoted(sheet)} sheetId="1" r:id="rId1"/>{listed}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/>{rels}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    return out


def _quoted(text: str) -> str:
    return '"' + escape(text, {'"': "&quot;", "\n": "&#10;"}) + '"'


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
