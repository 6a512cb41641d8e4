"""CSV as spreadsheets write it: a strict tokenizer, field typing and line export.

Fields are separated by one delimiter, records by CR, LF or CRLF. A quoted field keeps delimiters and line ends and
doubles its quotes; it is always text. A blank line is a row without cells; a byte-order mark is skipped; an open quote
at the end is an error. Unquoted fields may be typed: JSON-like finite numbers, TRUE and FALSE, '' as null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
Cell = str | float | bool | None


def type_field(text: str, quoted: bool) -> Cell:
    if quoted:
        return text
    if text == "":
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if re.fullmatch(_NUMBER, text) and math.isfinite(x := float(text)):
        return x + 0.0
    return text


def parse_csv(text: str, delimiter: str = ",", convert: bool = False) -> Iterator[list[Cell]]:
    text = text.removeprefix("﻿")
    d = re.escape(delimiter)
    field = re.compile(rf'"((?:[^"]|"")*)"([^{d}\r\n]*)|([^{d}\r\n]*)')
    at, row = 0, []
    while at < len(text):
        m = field.match(text, at)
        if m[1] is None and text[at] == '"':
            raise ValueError("a quoted field isn't closed")
        quoted = m[1] is not None
        value = m[1].replace('""', '"') + m[2] if quoted else m[3]
        end = m.end()
        ends = end >= len(text) or text[end] in "\r\n"
        if not (ends and not row and not quoted and value == ""):
            row.append(type_field(value, quoted) if convert else value)
        at = end
        if at < len(text) and text[at] == delimiter:
            at += 1
            if at >= len(text):
                row.append(None if convert else "")
                yield row
                return
            continue
        yield row
        row = []
        at += 2 if text.startswith("\r\n", at) else 1


def quote(col: Column, delimiter: str = ",") -> Column:
    """A field as written: quoted where it holds the delimiter, a quote or a line end."""
    special = '["\\r\\n' + re.escape(delimiter) + "]"
    return F.when(col.rlike(special), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(col, F.lit("")))


def csv_line(cells: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[quote(c.cast("string"), delimiter) for c in cells])


def typed_number(text: Column) -> Column:
    """The number of an unquoted field, or null."""
    x = text.try_cast("double")
    return F.when(text.rlike(f"^{_NUMBER}$") & (F.abs(x) < float("inf")), x)


def promote_header(names: list[Cell]) -> list[str]:
    """Names of the columns below a header row: blanks by place, repeats numbered past those taken."""
    out: list[str] = []
    for k, name in enumerate(names, 1):
        base = f"Column{k}" if name is None or name == "" else str(name)
        found, n = base, 1
        while found in out:
            n += 1
            found = f"{base}_{n}"
        out.append(found)
    return out


def sniff_delimiter(text: str) -> str:
    """The most frequent of comma, semicolon, tab and pipe outside quotes on the first line."""
    line = re.sub(r'"[^"]*"', "", text.removeprefix("﻿")).splitlines()[:1] or [""]
    return max(",;\t|", key=line[0].count)


def delimiter_of(text: Column) -> Column:
    """sniff_delimiter() of a column of texts; ties go by the order of comma, semicolon, tab and pipe."""
    line = F.regexp_replace(F.regexp_extract(text, r"^\x{FEFF}?([^\r\n]*)", 1), '"[^"]*"', "")
    counts = [F.struct((F.length(line) - F.length(F.translate(line, d, ""))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(",;\t|")]
    return F.array_max(F.array(*counts))["d"]
