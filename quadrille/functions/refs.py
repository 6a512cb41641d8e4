"""References in formulas: a scanner, copied formulas, and formulas that follow inserted and deleted rows or columns.

scan() cuts a formula into plain stretches and references; a reference is a pair of ends (the second one only for
ranges), each with a column, a row or both, and knows the sheet named before it. Every rewriting is a function from
references to references, so strings, function names and sheet names are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLS = 1_048_576, 16_384
GONE = "#REF!"


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def letters_of(n: Column) -> Column:
    """column_letters() of a column of numbers, up to three letters."""
    n = n.cast("int")
    digit = lambda below, size: F.when(n > below, F.char(F.lit(65) + F.floor((n - below - 1) / size).cast("int") % 26)).otherwise("")
    return F.concat(digit(702, 676), digit(26, 26), F.char(F.lit(65) + (n - 1) % 26))


def number_of(letters: Column) -> Column:
    """column_number() of a column of letters; null if there is any other character or none."""
    digits = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Za-z]{1,7}$"), F.aggregate(digits, F.lit(0).cast("long"), lambda n, d: F.when(d < 1, n).otherwise(n * 26 + d)))


@dataclass(frozen=True)
class End:
    col: int | None = None
    row: int | None = None
    col_fixed: bool = False
    row_fixed: bool = False

    def __str__(self) -> str:
        return ("$" * self.col_fixed + column_letters(self.col) if self.col else "") + ("$" * self.row_fixed + str(self.row) if self.row else "")


@dataclass(frozen=True)
class Ref:
    a: End
    b: End | None = None
    sheet: str | None = None

    def __str__(self) -> str:
        return str(self.a) if self.b is None else f"{self.a}:{self.b}"


_END = re.compile(r"(\$?)([A-Za-z]{1,3})?(?:(\$?)([0-9]{1,7}))?\Z")
#: A formula's lexemes as far as references matter: text, a sheet's name, a word (with its range partner), a character.
_LEXEME = re.compile(r"""(?P<text>"(?:[^"]|"")*")|(?P<quoted>'(?:[^']|'')*')!|(?P<plain>[\w.\[\]]+)!|(?P<word>[\w.$]+)(?P<pair>:[\w.$]+)?|(?P<other>.)""", re.S)


def parse_end(text: str) -> End | None:
    m = _END.match(text)
    if not m or not (m[2] or m[4]):
        return None
    if m[2] is None:  # only a row: its dollar was taken by the first group
        return End(None, int(m[4]), False, bool(m[1] or m[3]))
    return End(column_number(m[2]), int(m[4]) if m[4] else None, bool(m[1]), bool(m[3]))


def parse_ref(text: str) -> Ref | None:
    """A1, A1:B2, A:C or 1:3, with or without dollars."""
    first, colon, second = text.partition(":")
    a, b = parse_end(first), parse_end(second) if colon else None
    if a is None or (colon and b is None):
        return None
    if colon:
        same = (a.col is None) == (b.col is None) and (a.row is None) == (b.row is None)
        return Ref(a, b) if same else None
    return Ref(a) if a.col and a.row else None


def scan(formula: str) -> Iterator[str | Ref]:
    """The formula as stretches of text and references, in order."""
    sheet = None
    for m in _LEXEME.finditer(formula):
        if m["quoted"] is not None or m["plain"] is not None:
            sheet = m["quoted"][1:-1].replace("''", "'") if m["quoted"] else m["plain"]
            yield m[0]
            continue
        ref = None
        if m["word"] and formula[m.end() : m.end() + 1] not in ("(", "!"):
            ref = parse_ref(m[0])
            if ref is None and m["pair"] and parse_ref(m["word"]):
                yield from (replace(parse_ref(m["word"]), sheet=sheet), ":")
                ref, tail = parse_ref(m["pair"][1:]), m["pair"][1:]
                yield ref or tail
                sheet = None
                continue
        yield replace(ref, sheet=sheet) if ref else m[0]
        sheet = None


def rewrite(formula: str, move: Callable[[Ref], Ref | None]) -> str:
    """The formula with each reference moved; None is a dead one."""
    return "".join(x if isinstance(x, str) else str(moved) if (moved := move(x)) else GONE for x in scan(formula))


def _on_sheet(before: Ref, after: Ref) -> Ref | None:
    """after, if it lies on the sheet; the far end of a range stays at the edge."""
    ends = [e for e in (after.a, after.b) if e]
    if any((e.col is not None and e.col < 1) or (e.row is not None and e.row < 1) for e in ends):
        return None
    if after.b is not None and before.b is not None:
        clamp = lambda n, was, most: most if n is not None and was <= most < n else n
        b = replace(after.b, col=clamp(after.b.col, before.b.col, MAX_COLS), row=clamp(after.b.row, before.b.row, MAX_ROWS))
        after = replace(after, b=b)
        if (b.col or 0) < (after.a.col or 0) or (b.row or 0) < (after.a.row or 0):
            return None
    if any((e.col or 0) > MAX_COLS or (e.row or 0) > MAX_ROWS for e in (after.a, after.b) if e):
        return None
    return after


def shift_formula(formula: str, rows: int, cols: int) -> str:
    """The formula as copied by so many rows and columns: fixed parts stay, and what leaves the sheet is #REF!."""

    def moved(e: End | None) -> End | None:
        if e is None:
            return None
        return replace(e, col=e.col if e.col is None or e.col_fixed else e.col + cols, row=e.row if e.row is None or e.row_fixed else e.row + rows)

    return rewrite(formula, lambda r: _on_sheet(r, replace(r, a=moved(r.a), b=moved(r.b)))) if rows or cols else formula


def absolute(formula: str) -> str:
    """Every reference fixed, as print areas and filters are stored."""
    fix = lambda e: e and replace(e, col_fixed=e.col is not None, row_fixed=e.row is not None)
    return rewrite(formula, lambda r: replace(r, a=fix(r.a), b=fix(r.b)))


@dataclass(frozen=True)
class Axis:
    """Edits of rows (or columns) in order, each in the places that those before it left: (at, count, insert)."""

    edits: tuple[tuple[int, int, bool], ...] = ()

    def point(self, n: int) -> int | None:
        """Where a row is after the edits; None if it was deleted."""
        for at, count, insert in self.edits:
            if n >= at:
                if insert:
                    n += count
                elif n < at + count:
                    return None
                else:
                    n -= count
        return n

    def span(self, a: int, b: int) -> tuple[int, int] | None:
        """A range shrinks to what is left of it, and grows with rows inserted inside."""
        for at, count, insert in self.edits:
            if insert:
                a, b = a + count * (a >= at), b + count * (b >= at)
            else:
                a = a if a < at else max(at, a - count)
                b = b if b < at else b - count if b >= at + count else at - 1
                if b < a:
                    return None
        return a, b

    def column(self, n: Column) -> Column:
        """point() of a column of numbers."""
        for at, count, insert in self.edits:
            n = F.when(n >= at, n + count if insert else F.when(n >= at + count, n - count)).otherwise(n)
        return n

    def span_columns(self, a: Column, b: Column) -> tuple[Column, Column]:
        """span() of two columns; both null where the range is gone."""
        for at, count, insert in self.edits:
            if insert:
                a, b = F.when(a >= at, a + count).otherwise(a), F.when(b >= at, b + count).otherwise(b)
            else:
                low = F.when(a < at, a).otherwise(F.greatest(F.lit(at), a - count))
                high = F.when(b < at, b).when(b >= at + count, b - count).otherwise(at - 1)
                a, b = F.when(low <= high, low), F.when(low <= high, high)
        return a, b


def rewrite_formula(formula: str, rows: Axis = Axis(), cols: Axis = Axis(), sheet: str | None = None, own: bool = True) -> str:
    """The formula after rows and columns of a sheet were inserted and deleted. References that name no sheet move if
    the formula is on that sheet itself (own); those that name one, if it is that sheet."""

    def move(r: Ref) -> Ref | None:
        if not (own if r.sheet is None else sheet is not None and r.sheet.lower() == sheet.lower()):
            return r
        if r.b is None:
            c, n = cols.point(r.a.col), rows.point(r.a.row)
            return c and n and replace(r, a=replace(r.a, col=c, row=n))
        a, b = r.a, r.b
        for axis, name in ((cols, "col"), (rows, "row")):
            if getattr(a, name) is not None:
                low, high = sorted((getattr(a, name), getattr(b, name)))
                left = axis.span(low, high)
                if left is None:
                    return None
                a, b = replace(a, **{name: left[0]}), replace(b, **{name: left[1]})
        return _on_sheet(r, replace(r, a=a, b=b))

    return rewrite(formula, move)


def forget_sheet(formula: str, sheet: str) -> str:
    """The formula after a sheet was deleted: references to it are #REF!."""
    out, dead = [], False
    for x in scan(formula):
        if isinstance(x, str):
            name = x[:-1].strip("'").replace("''", "'") if x.endswith("!") and len(x) > 1 else None
            dead = name is not None and name.lower() == sheet.lower()
            if not dead:
                out.append(x)
        else:
            out.append(GONE if dead else str(x))
            dead = False
    return "".join(out)


def to_open_formula(formula: str) -> str:
    """A formula in OpenDocument syntax: references in brackets with a dot, arguments parted by semicolons."""
    out: list[str] = []
    for x in scan(formula.removeprefix("=")):
        if isinstance(x, Ref):
            name = out.pop() if x.sheet is not None and out and out[-1].endswith("!") else ""
            name = f"${name[:-1]}" if name else ""
            out.append("[" + ":".join(f"{name if k == 0 else ''}.{e}" for k, e in enumerate(e for e in (x.a, x.b) if e)) + "]")
        else:
            out.append(";" if x == "," else x)
    return "of:=" + "".join(out)


def from_open_formula(formula: str) -> str:
    """The inverse of to_open_formula(); other prefixes are dropped."""
    body = re.sub(r"^\w*:?=", "", formula)
    lexeme = re.compile(r'"(?:[^"]|"")*"|\[[^\]]*\]|.', re.S)

    def place(end: str) -> str:
        name, dot, cell = end.rpartition(".")
        name = name.removeprefix("$")
        if name and name[0] != "'" and not re.fullmatch(r"[^\W\d][\w.]*", name):
            name = f"'{name}'"
        return f"{name}!{cell}" if name else cell if dot else end

    def one(m: re.Match) -> str:
        if m[0] == ";":
            return ","
        if m[0][0] != "[" or len(m[0]) < 3:
            return m[0]
        first, colon, second = m[0][1:-1].partition(":")
        return place(first) + colon + place(second).rpartition("!")[2]

    return lexeme.sub(one, body)
