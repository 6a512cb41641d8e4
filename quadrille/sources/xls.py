"""Workbooks of Excel 97 to 2003 (.xls, BIFF8) as a Spark data source, read from their compound file.

One partition a file and sheet. Cells come in long form, in the columns of the .xlsx source; formulas give their cached
results. Blank cells are not reported.

    register(spark)
    spark.read.format("xls").load("/books/*.xls")
"""

from __future__ import annotations

import bisect
import glob
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrille.functions.dates import DATE_FORMAT_IDS, is_date_format, iso, serial_to_datetime
from quadrille.sources.xlsx import CELLS, chosen

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST_SECTOR = 0xFFFFFFFA

#: BIFF error codes and their texts. Fixed values.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}

#: BIFF8 record types. Fixed values.
FORMULA, EOF, DATEMODE, FILEPASS, CONTINUE, BOUNDSHEET, MULRK, RSTRING, XF, SST, LABELSST = 0x06, 0x0A, 0x22, 0x2F, 0x3C, 0x85, 0xBD, 0xD6, 0xE0, 0xFC, 0xFD
NUMBER, LABEL, BOOLERR, STRING, RK, FORMAT, BOF = 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E, 0x809


class CompoundFile:
    """The streams of a compound file, by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<2H", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff, mini_table, next_table = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < _LAST_SECTOR]
        seen = set()
        while next_table < _LAST_SECTOR:
            if next_table in seen:
                raise ValueError("the compound file's sector table loops")
            seen.add(next_table)
            *more, next_table = self._numbers(self._sector(next_table))
            tables += [s for s in more if s < _LAST_SECTOR]
        self.table = [n for s in tables for n in self._numbers(self._sector(s))]
        self.mini_table = self._numbers(b"".join(self._chain(mini_table)))
        self.entries = {}
        root = b"".join(self._chain(directory))
        for at in range(0, len(root) - 127, 128):
            length, kind = struct.unpack_from("<HB", root, at + 64)
            start, size = struct.unpack_from("<2I", root, at + 116)
            if kind in (2, 5):
                name = root[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
                self.entries.setdefault("" if kind == 5 else name.lower(), (start, size))

    @staticmethod
    def _numbers(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not out:
            raise ValueError("a sector lies beyond the compound file")
        return out

    def _walk(self, start: int, table) -> Iterator[int]:
        steps = 0
        while start < _LAST_SECTOR:
            if steps > len(table) or start >= len(table):
                raise ValueError("a chain of sectors is broken")
            yield start
            start, steps = table[start], steps + 1

    def _chain(self, start: int) -> Iterator[bytes]:
        return (self._sector(s) for s in self._walk(start, self.table))

    def read(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        start, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return b"".join(self._chain(start))[:size]
        small, m = b"".join(self._chain(self.entries[""][0])), self.mini_size
        return b"".join(small[s * m : (s + 1) * m] for s in self._walk(start, self.mini_table))[:size]


def records(stream: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<2H", stream, at)
        if at + 4 + size > len(stream):
            raise ValueError(f"the record at {at} is cut short")
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


def _string(data: bytes, at: int, wide_count: bool = True) -> str:
    """A text with its length in front, in one record."""
    count = struct.unpack_from("<H", data, at)[0] if wide_count else data[at]
    at += 2 if wide_count else 1
    flags = data[at]
    at += 1 + 2 * bool(flags & 8) + 4 * bool(flags & 4)
    return data[at : at + 2 * count].decode("utf-16-le", "replace") if flags & 1 else data[at : at + count].decode("latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The shared strings of a record and those that continue it, read from all of them joined. Where a string's
    characters reach the end of a record, the next one begins with a byte that says how wide the rest is."""
    data, ends = b"".join(parts), list(itertools.accumulate(map(len, parts)))
    edges = set(ends)

    def characters(at: int, count: int, wide: bool) -> tuple[bytes, int]:
        """As UTF-16, and where they end."""
        if count and at in edges:
            wide, at = bool(data[at] & 1), at + 1
        stop = ends[bisect.bisect_right(ends, at)] if count else at
        here = min(count, (stop - at) >> wide)
        end = at + (here << wide)
        head = data[at:end] if wide else data[at:end].decode("latin-1").encode("utf-16-le")
        if here == count:
            return head, end
        if end != stop:
            raise ValueError("a character is split between records")
        tail, end = characters(end, count - here, wide)
        return head + tail, end

    out, at = [], 8
    try:
        total = struct.unpack_from("<I", data, 4)[0]
        while len(out) < total and at < len(data):
            count, flags = struct.unpack_from("<HB", data, at)
            runs, extra = at + 3, at + 3 + 2 * bool(flags & 8)
            after = 4 * (struct.unpack_from("<H", data, runs)[0] if flags & 8 else 0) + (struct.unpack_from("<I", data, extra)[0] if flags & 4 else 0)
            text, at = characters(extra + 4 * bool(flags & 4), count, bool(flags & 1))
            out.append(text.decode("utf-16-le", "replace"))
            at += after
    except (IndexError, struct.error):
        at = len(data) + 1
    if at > len(data):
        raise ValueError("the shared strings are cut short")
    return out


def rk_number(raw: int) -> float:
    """Bit 0: a hundredth; bit 1: a 30-bit integer, else the upper 30 bits of a double."""
    if raw & 2:
        value = float((raw - (1 << 32) if raw & 0x80000000 else raw) >> 2)
    else:
        value = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class OldWorkbook:
    def __init__(self, data: bytes):
        book = CompoundFile(data)
        stream = book.read("Workbook") or book.read("Book")
        if stream is None:
            raise ValueError("the compound file holds no workbook")
        self.stream, self.strings, self.date1904 = stream, [], False
        self.sheets: list[tuple[str, str, int]] = []
        self.styles: list[int] = []
        codes: dict[int, str] = {}
        listed: list[bytes] | None = None
        for k, (kind, d) in enumerate(records(stream, 0)):
            if k == 0 and (kind != BOF or struct.unpack_from("<H", d)[0] != 0x600):
                raise ValueError("only workbooks of Excel 97 to 2003 are read")
            if kind == CONTINUE:
                if listed is not None:
                    listed.append(d)
                continue
            if listed is not None:
                self.strings, listed = shared_strings(listed), None
            if kind == EOF:
                break
            elif kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            elif kind == DATEMODE:
                self.date1904 = d[:2] == b"\1\0"
            elif kind == FORMAT:
                codes[struct.unpack_from("<H", d)[0]] = _string(d, 2)
            elif kind == XF:
                self.styles.append(struct.unpack_from("<H", d, 2)[0])
            elif kind == SST:
                listed = [d]
            elif kind == BOUNDSHEET and d[5] == 0:
                self.sheets.append((_string(d, 6, wide_count=False), ("visible", "hidden", "veryHidden", "visible")[d[4] & 3], struct.unpack_from("<I", d)[0]))
        self.dates = DATE_FORMAT_IDS | {k for k, code in codes.items() if is_date_format(code)}

    def _number(self, style: int, x: float) -> tuple:
        if style < len(self.styles) and self.styles[style] in self.dates:
            try:
                return "d", x, iso(serial_to_datetime(x, self.date1904)), None, None
            except (OverflowError, ValueError):
                pass
        return "n", x + 0.0, None, None, None

    def cells(self, at: int) -> Iterator[tuple]:
        """Row and column from 0, kind, num, str, bool and err, in the order of the records."""
        depth, waiting = 0, None
        for kind, d in records(self.stream, at):
            if kind in (BOF, EOF):
                depth += 1 if kind == BOF else -1
                if not depth:
                    return
                continue
            if depth > 1:  # a chart on the sheet
                continue
            if kind == MULRK:
                row, first = struct.unpack_from("<2H", d)
                for k in range((len(d) - 6) // 6):
                    style, raw = struct.unpack_from("<HI", d, 4 + 6 * k)
                    yield row, first + k, *self._number(style, rk_number(raw))
            elif kind == STRING:
                if waiting:
                    yield *waiting, "s", None, _string(d, 0), None, None
                waiting = None
            elif kind in (NUMBER, RK, LABELSST, LABEL, RSTRING, BOOLERR, FORMULA):
                row, col, style = struct.unpack_from("<3H", d)
                found = None
                if kind == FORMULA:
                    waiting = None
                    if d[12:14] != b"\xff\xff":
                        kind = NUMBER
                    elif d[6] == 0:
                        waiting = row, col
                    elif d[6] == 1:
                        found = "b", None, None, d[8] == 1, None
                    elif d[6] == 2:
                        found = "e", None, None, None, ERRORS.get(d[8], "#VALUE!")
                    else:
                        found = "s", None, "", None, None
                if kind == NUMBER:
                    found = self._number(style, struct.unpack_from("<d", d, 6)[0])
                elif kind == RK:
                    found = self._number(style, rk_number(struct.unpack_from("<I", d, 6)[0]))
                elif kind == LABELSST:
                    k = struct.unpack_from("<I", d, 6)[0]
                    found = "s", None, self.strings[k] if k < len(self.strings) else "", None, None
                elif kind in (LABEL, RSTRING):
                    found = "s", None, _string(d, 6), None, None
                elif kind == BOOLERR:
                    found = ("e", None, None, None, ERRORS.get(d[6], "#VALUE!")) if d[7] == 1 else ("b", None, None, d[6] == 1, None)
                if found:
                    yield row, col, *found


def _load(path: str) -> OldWorkbook:
    with open(path, "rb") as f:
        return OldWorkbook(f.read())


@dataclass
class _Sheet(InputPartition):
    file: str
    sheet: str
    at: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only, self.every = options["path"].removeprefix("file:"), options.get("sheetname"), options.get("sheets") == "all"

    def partitions(self):
        return [_Sheet(f, name, at) for f in sorted(glob.glob(self.path)) for name, _, at in chosen(_load(f).sheets, self.only, self.every)]

    def read(self, partition):
        for row, col, *cell in _load(partition.file).cells(partition.at):
            yield partition.file, partition.sheet, row + 1, col, *cell, None


class XlsSource(DataSource):
    @classmethod
    def name(cls):
        return "xls"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsSource)
