"""A sink that makes one file of many tasks: each writes its rows as a deflated fragment, the commit joins them.

Fragments end on a full flush, so they are joined without being inflated, and their checksums are combined. Rows are
numbered by a column row_number (from 1) and each task's rows must come in order; tasks may come in any order, but not
interleave. With the option sheetRows, rows go on in further sheets once one holds so many (its header counts); without
it more rows than a sheet has are an error. The file is written beside its place and then renamed, so a failed commit leaves what was there. Fragments
of failed and repeated attempts lie in the same folder and go with it.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MAX_ROWS = 1_048_576


def crc_combine(a: int, b: int, length: int) -> int:
    """The CRC-32 of two stretches joined, from theirs and the second's length: a is shifted by length zero bytes in
    GF(2), by squaring the operator of one zero bit."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    op = [0xEDB88320, *(1 << k for k in range(31))]
    bits = length * 8
    while bits:
        if bits & 1:
            a = times(op, a)
        op = [times(op, x) for x in op]
        bits >>= 1
    return a ^ b


@dataclass
class Fragment:
    """Rows first to last of a sheet (from 0), as a task wrote them."""

    path: str
    sheet: int
    first: int
    last: int = 0
    size: int = 0
    crc: int = 0


@dataclass
class Fragments(WriterCommitMessage):
    parts: list[Fragment]


class _Open:
    """A fragment that is being written."""

    def __init__(self, path: str, sheet: int, first: int):
        self.made, self.held = Fragment(path, sheet, first), []
        self.packer, self.file = zlib.compressobj(6, zlib.DEFLATED, -15), open(path, "wb")

    def flush(self) -> None:
        raw = "".join(self.held).encode()
        self.held.clear()
        self.file.write(self.packer.compress(raw))
        self.made.size, self.made.crc = self.made.size + len(raw), zlib.crc32(raw, self.made.crc)

    def close(self, last: int) -> Fragment:
        self.flush()
        self.made.last = last
        self.file.write(self.packer.flush(zlib.Z_FULL_FLUSH))
        self.file.close()
        return self.made


class FragmentWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.path, self.sheet = self.options["path"].removeprefix("file:"), self.options.get("sheetname", "Sheet1")
        self.names = [f.name for f in schema.fields if f.name != "row_number"]
        if "row_number" not in schema.names:
            raise ValueError("a sheet's rows come by a column row_number (from 1)")
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.stage = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.several, self.most = "sheetrows" in self.options, self.option("sheetRows", MAX_ROWS)
        if not isinstance(self.most, int) or not 2 <= self.most <= MAX_ROWS:
            raise ValueError(f"sheetRows is a number from 2 to {MAX_ROWS}")

    def option(self, name: str, otherwise=None):
        """An option as JSON; text that is none as it stands."""
        if name.lower() not in self.options:
            return otherwise
        try:
            return json.loads(self.options[name.lower()])
        except ValueError:
            return self.options[name.lower()]

    def row_xml(self, number: int, values: tuple) -> str:
        raise NotImplementedError

    def number_rows(self, numbers: list) -> None:
        """Called with the numbers of each batch, before its rows are written."""

    def book(self, sheets: list[tuple[str, list[Fragment]]]) -> list[tuple[str, list[bytes | Fragment]]]:
        """The file's parts in order, each by its pieces; sheets have their name and rows."""
        raise NotImplementedError

    def sheet_name(self, k: int) -> str:
        """The name of a sheet, and of those in which its rows go on."""
        return self.sheet if not k else f"{self.sheet[: 31 - len(f' ({k + 1})')]} ({k + 1})"

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.stage, exist_ok=True)
        path = f"{self.stage}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        done, now, last = [], None, 0
        most, several = self.most - 1, self.several
        try:
            for batch in iterator:
                numbers = batch.column("row_number").to_pylist()
                self.number_rows(numbers)
                columns = [batch.column(n).to_pylist() for n in self.names]
                for number, *values in zip(numbers, *columns):
                    if number <= last:
                        raise ValueError(f"row {number} comes after row {last}: a task's rows must be in order, from 1")
                    sheet, place = divmod(number - 1, most)
                    if sheet and not several:
                        raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
                    if now is None or now.made.sheet != sheet:
                        if now is not None:
                            done.append(now.close(last))
                        now = _Open(f"{path}-{sheet}", sheet, number)
                    last = number
                    now.held.append(self.row_xml(place + 2, values))  # the header is row 1
                if now is not None:
                    now.flush()
            if now is not None:
                done.append(now.close(last))
        finally:
            if now is not None:
                now.file.close()
        return Fragments(done)

    def commit(self, messages):
        parts = sorted((f for m in messages if m is not None for f in m.parts), key=lambda f: f.first)
        if any(b.first <= a.last for a, b in zip(parts, parts[1:])):
            self.abort(messages)
            raise ValueError("rows of different tasks interleave: repartitionByRange by row_number first")
        beside = f"{self.path}.{uuid.uuid4().hex}"
        try:
            sheets: dict[int, list[Fragment]] = {0: []}
            for f in parts:
                sheets.setdefault(f.sheet, []).append(f)
            named = [(self.sheet_name(k), held) for k, held in sheets.items()]
            if len({n.lower() for n, _ in named}) < len(named):
                raise ValueError(f"sheet name {self.sheet!r} is that of a further sheet")
            with open(beside, "wb") as out:
                _zip(out, self.book(named))
            os.replace(beside, self.path)
        finally:
            if os.path.exists(beside):
                os.remove(beside)
            self.abort(messages)

    def abort(self, messages):
        shutil.rmtree(self.stage, ignore_errors=True)


def _zip(f, parts: list[tuple[str, list[bytes | Fragment]]]) -> None:
    entries = []

    def entry(name: str, blobs: Iterator[bytes], crc: int, size: int, method: int = 8) -> None:
        at = f.tell()
        f.write(struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0x800, method, 0, 33, crc, 0, size, len(name.encode()), 0) + name.encode())
        begun = f.tell()
        for b in blobs:
            f.write(b)
        end = f.tell()
        f.seek(at + 18)
        f.write(struct.pack("<I", end - begun))
        f.seek(end)
        entries.append((name, crc, end - begun, size, at, method))

    def packed(pieces: list[bytes | Fragment]) -> Iterator[bytes]:
        for k, x in enumerate(pieces, 1):
            if isinstance(x, bytes):
                p = zlib.compressobj(6, zlib.DEFLATED, -15)
                yield p.compress(x) + p.flush(zlib.Z_FINISH if k == len(pieces) else zlib.Z_FULL_FLUSH)
                continue
            with open(x.path, "rb") as g:
                while block := g.read(1 << 20):
                    yield block

    for name, pieces in parts:
        crc = size = 0
        for c, n in [(zlib.crc32(x), len(x)) if isinstance(x, bytes) else (x.crc, x.size) for x in pieces]:
            crc, size = crc_combine(crc, c, n), size + n
        if size >= 1 << 32:
            raise ValueError("a part of 4 GiB or more needs ZIP64")
        if name == "mimetype":
            entry(name, iter(pieces), crc, size, 0)
        else:
            entry(name, packed(pieces), crc, size)
    begun = f.tell()
    for n, c, small, raw, at, method in entries:
        f.write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0x800, method, 0, 33, c, small, raw, len(n.encode()), 0, 0, 0, 0, 0, at) + n.encode())
    f.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(entries), len(entries), f.tell() - begun, begun, 0))
