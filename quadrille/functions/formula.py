"""A spreadsheet formula language compiled to Spark columns.

compile_formula() parses a formula and lowers it to a value and an error column over a typed sheet, whose letters A, B,
... are bound to the columns of a DataFrame. A reference to the formula's own row is a column; other rows and vertical
ranges come from a resolver, which quadrille.operators.formulas supplies with joins and windows. Values have a kind
(number, text, boolean, blank), known when the formula is compiled where the branches of an IF agree, else carried
beside the value. A blank takes the other side's type. Errors win from the left. Unknown syntax or functions give None,
never an exception.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.refs import End, Ref, column_letters, column_number, parse_ref, shift_formula

__all__ = ["Sheet", "Stats", "Unsupported", "Value", "aggregate", "bind", "column_letters", "column_number", "compile_formula", "register_function", "shift_formula"]

#: Error codes. Fixed values.
NULL, DIV0, VALUE, REF, NAME, NUM, NA = "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"

_TOKEN = re.compile(
    r"\s*(?:(?P<ref>\$?[A-Za-z]{1,3}\$?[0-9]+(?::\$?[A-Za-z]{1,3}\$?[0-9]+)?(?![\w(!:]))|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w!:]))"
    r"|(?P<str>\"(?:[^\"]|\"\")*\")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)(?!!)|(?P<op><>|<=|>=|[-+*/^&=<>%(),]))\s*"
)
#: Binding of the binary operators, from loose to tight.
_BINDING = {op: k for k, ops in enumerate((("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))) for op in ops}


class Unsupported(Exception):
    pass


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


@dataclass
class Value:
    """kind: n, s, b, z (blank) or v; of v, tag holds the kind of each row and parts the columns by kind. err is null
    where there is none. maybe_blank: whether a null of col is a blank cell."""

    kind: str
    col: Column | None
    err: Column
    maybe_blank: bool = False
    tag: Column | None = None
    parts: dict[str, Column] | None = None


@dataclass
class Stats:
    """What the aggregates need of a range: sum, count, least and greatest number, and the first error."""

    total: Column
    count: Column
    least: Column
    most: Column
    err: Column


class Resolver(Protocol):
    def cell(self, ref: Ref, letters: str) -> Value: ...

    def range(self, ref: Ref) -> Stats: ...


@dataclass
class Sheet:
    """The columns of a sheet by letters: kind, column, and the column's error column or None."""

    columns: dict[str, tuple[str, Column, Column | None]]

    def value(self, letters: str) -> Value:
        kind, col, err = self.columns.get(letters, ("z", _null(), None))
        return Value(kind, col, _null() if err is None else err, True)


# -- syntax ----------------------------------------------------------------------------------------------------------


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsupported(text[at:])
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Tokens:
    def __init__(self, items: list[tuple[str, str]]):
        self.items = [*items, ("end", "")]

    def next_is(self, *ops: str) -> bool:
        return self.items[0][0] == "op" and self.items[0][1] in ops

    def take(self) -> tuple[str, str]:
        return self.items.pop(0)

    def expect(self, op: str) -> None:
        if not self.next_is(op):
            raise Unsupported(self.items[0][1])
        self.take()


def _expression(t: _Tokens, least: int = 0):
    """Precedence climbing; all binary operators group from the left."""
    left = _operand(t)
    while t.items[0][0] == "op" and _BINDING.get(t.items[0][1], -1) >= least:
        op = t.take()[1]
        left = ("bin", op, left, _expression(t, _BINDING[op] + 1))
    return left


def _operand(t: _Tokens):
    if t.next_is("+", "-"):
        minus = t.take()[1] == "-"
        x = _operand(t)
        return ("neg", x) if minus else x
    kind, text = t.take()
    if kind == "num":
        x = ("num", float(text))
    elif kind == "str":
        x = ("str", text[1:-1].replace('""', '"'))
    elif kind == "ref":
        x = ("ref", parse_ref(text.upper()))
    elif (kind, text) == ("op", "("):
        x = _expression(t)
        t.expect(")")
    elif kind == "name" and t.next_is("("):
        t.take()
        args = []
        if not t.next_is(")"):
            args.append(_expression(t))
            while t.next_is(","):
                t.take()
                args.append(_expression(t))
        t.expect(")")
        x = ("call", text.upper(), args)
    elif kind == "name" and text.upper() in ("TRUE", "FALSE"):
        x = ("bool", text.upper() == "TRUE")
    else:
        raise Unsupported(text)
    while t.next_is("%"):
        t.take()
        x = ("pct", x)
    return x


def parse(formula: str):
    t = _Tokens(tokenize(formula.strip().removeprefix("=").strip()))
    tree = _expression(t)
    if t.items[0][0] != "end":
        raise Unsupported(t.items[0][1])
    return tree


def references(tree) -> list[Ref]:
    """All references of a parsed formula."""
    if tree[0] == "ref":
        return [tree[1]]
    return [r for x in tree[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple) for r in references(y)]


# -- coercion --------------------------------------------------------------------------------------------------------

_RANK = {"n": 0, "s": 1, "b": 2}
_EMPTY: dict[str, Callable[[], Column]] = {"n": lambda: F.lit(0.0), "s": lambda: F.lit(""), "b": lambda: F.lit(False)}
_TYPES = {"n": "double", "s": "string", "b": "boolean"}


def spread(v: Value) -> tuple[Column, dict[str, Column]]:
    """The kind of each row, and the value by kind."""
    if v.kind == "v":
        return v.tag, v.parts
    parts = {k: v.col if k == v.kind else _null(t) for k, t in _TYPES.items()}
    if v.kind == "z":
        return F.lit("z"), parts
    return (F.when(v.col.isNull(), "z").otherwise(v.kind) if v.maybe_blank else F.lit(v.kind)), parts


def _merged(tag: Column, n: Column, s: Column, b: Column, err: Column) -> Value:
    return Value("v", F.struct(tag.alias("kind"), n.alias("num"), s.alias("str"), b.alias("bool")), err, False, tag, {"n": n, "s": s, "b": b})


def _text_number(text: Column) -> Column:
    """The number that a text shows, or null: decimal with an exponent, or hexadecimal."""
    t = F.btrim(text, F.lit(" \t\n\r\x0b\x0c\xa0"))
    x = t.try_cast("double")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (F.abs(x) < float("inf")), x)
    return F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(t, 3, 12), 16, 10).cast("double")).otherwise(plain)


def number(v: Value) -> Value:
    """A boolean is 1 or 0, a blank 0, text its number or #VALUE!."""
    if v.kind == "n":
        return Value("n", F.coalesce(v.col, F.lit(0.0)) if v.maybe_blank else v.col, v.err)
    if v.kind == "z":
        return Value("n", F.lit(0.0), v.err)
    if v.kind == "b":
        return Value("n", F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    if v.kind == "s":
        x = _text_number(v.col)
        return Value("n", F.when(v.col.isNull(), 0.0).otherwise(x), F.coalesce(v.err, F.when(v.col.isNotNull() & x.isNull(), VALUE)))
    x = _text_number(v.parts["s"])
    return Value("n", F.when(v.tag == "n", v.parts["n"]).when(v.tag == "b", v.parts["b"].cast("double")).when(v.tag == "s", x).otherwise(0.0), F.coalesce(v.err, F.when((v.tag == "s") & x.isNull(), VALUE)))


def _fifteen_digits(col: Column) -> Column:
    """15 significant digits; with an exponent from 1E+21 and below 1E-6."""
    shown = F.format_string("%.14e", col)
    digits = F.regexp_replace(F.translate(F.regexp_extract(shown, r"(\d\.\d+)e", 1), ".", ""), "0+$", "")
    power, n = F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int"), F.length(digits)
    point = power + 1
    rest = lambda start: digits.substr(start + F.lit(1), F.lit(15))
    large = F.concat(digits.substr(1, 1), F.when(n > 1, F.concat(F.lit("."), rest(F.lit(1)))).otherwise(""), F.when(power < 0, "E-").otherwise("E+"), F.abs(power).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    mixed = F.concat(digits.substr(F.lit(1), point), F.lit("."), rest(point))
    body = F.when((power >= 21) | (power < -6), large).when(power < 0, small).when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n))).otherwise(mixed)
    return F.concat(F.when(shown.startswith("-"), "-").otherwise(""), body)


def number_text(x: Column) -> Column:
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.try_cast("decimal(16,0)").cast("string")).otherwise(_fifteen_digits(x))


def text(v: Value) -> Value:
    """Whole numbers print without a fraction, booleans as TRUE and FALSE, a blank as ''."""
    if v.kind == "s":
        return Value("s", F.coalesce(v.col, F.lit("")) if v.maybe_blank else v.col, v.err)
    tag, parts = spread(v)
    shown = {"n": lambda: number_text(parts["n"]), "b": lambda: F.when(parts["b"], "TRUE").otherwise("FALSE"), "s": lambda: parts["s"]}
    out = F.when(tag == "z", "")
    for k in shown if v.kind == "v" else [v.kind] if v.kind != "z" else []:
        out = out.when(tag == k, shown[k]())
    return Value("s", out, v.err)


def truth(v: Value) -> Value:
    if v.kind == "b":
        return Value("b", F.coalesce(v.col, F.lit(False)) if v.maybe_blank else v.col, v.err)
    if v.kind in ("n", "z"):
        n = number(v)
        return Value("b", n.col != 0, n.err)
    tag, parts = spread(v)
    up = F.upper(parts["s"])
    out = F.when(tag == "s", up == "TRUE").when(tag == "n", parts["n"] != 0).when(tag == "b", parts["b"]).otherwise(False)
    return Value("b", out, F.coalesce(v.err, F.when((tag == "s") & ~up.isin("TRUE", "FALSE"), VALUE)))


def _compare(op: str, a: Value, b: Value) -> Value:
    """Numbers come before text, text before booleans; text compares without case."""
    fold = {"n": lambda c: c, "s": F.lower, "b": lambda c: c}
    if a.kind == "z" and b.kind == "z":
        x = y = F.lit(0)
    elif a.kind != "v" and b.kind != "v" and (a.kind == b.kind or "z" in (a.kind, b.kind)):
        kind = a.kind if a.kind != "z" else b.kind
        x, y = (_EMPTY[kind]() if v.kind == "z" else fold[kind](F.coalesce(v.col, _EMPTY[kind]()) if v.maybe_blank else v.col) for v in (a, b))
    elif a.kind != "v" and b.kind != "v" and not a.maybe_blank and not b.maybe_blank:
        x, y = F.lit(_RANK[a.kind]), F.lit(_RANK[b.kind])
    else:
        (ta, pa), (tb, pb) = spread(a), spread(b)
        left = F.when(ta != "z", ta).when(tb != "z", tb).otherwise("n")
        right = F.when(tb != "z", tb).otherwise(left)
        rank = lambda tag: F.when(tag == "n", 0).when(tag == "s", 1).otherwise(2)
        sign = F.when(rank(left) < rank(right), -1).when(rank(left) > rank(right), 1)
        for k in _RANK:
            p, q = (fold[k](F.coalesce(parts[k], _EMPTY[k]())) for parts in (pa, pb))
            sign = sign.when((left == k) & (p < q), -1).when((left == k) & (p > q), 1)
        x, y = sign.otherwise(0), F.lit(0)
    out = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return Value("b", out, F.coalesce(a.err, b.err))


def _finite(col: Column) -> Column:
    return ~(F.isnan(col) | (F.abs(col) == float("inf")))


def _binary(op: str, a: Value, b: Value) -> Value:
    if _BINDING[op] == 0:
        return _compare(op, a, b)
    if op == "&":
        x, y = text(a), text(b)
        return Value("s", F.concat(x.col, y.col), F.coalesce(x.err, y.err))
    x, y = number(a), number(b)
    err = F.coalesce(a.err, b.err, x.err, y.err)  # an operand's own error comes before a failed coercion
    if op == "/":
        return Value("n", F.when(y.col != 0, F.try_divide(x.col, y.col)), F.coalesce(err, F.when(y.col == 0, DIV0)))
    if op == "^":
        p = F.pow(x.col, y.col)
        return Value("n", F.when(_finite(p), p), F.coalesce(err, F.when(~_finite(p), NUM)))
    return Value("n", {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[op], err)


def _filled(v: Value) -> Value:
    """A blank result is the number 0."""
    if v.kind == "z":
        return Value("n", F.lit(0.0), v.err)
    if v.kind == "n":
        return number(v)
    if v.kind == "v" or v.maybe_blank:
        tag, parts = spread(v)
        return _merged(F.when(tag == "z", "n").otherwise(tag), F.when(tag == "z", 0.0).otherwise(parts["n"]), parts["s"], parts["b"], v.err)
    return v


# -- lowering --------------------------------------------------------------------------------------------------------

#: Functions added by users: a name and what makes a value of the arguments' values.
_ADDED: dict[str, Callable[[list[Value]], Value]] = {}


def register_function(name: str, build: Callable[[list[Value]], Value]) -> None:
    """Add a function to the language; build gets the values of the arguments."""
    _ADDED[name.upper()] = build


class Lowering:
    def __init__(self, sheet: Sheet, row: int, resolver: Resolver | None):
        self.sheet, self.row, self.resolver = sheet, row, resolver

    def _own(self, e: End) -> bool:
        return e.row == self.row and not e.row_fixed

    def cell(self, ref: Ref) -> Value:
        letters = column_letters(ref.a.col)
        if self._own(ref.a):
            return self.sheet.value(letters)
        if self.resolver is None:
            raise Unsupported(str(ref))
        return self.resolver.cell(ref, letters)

    def value(self, tree) -> Value:
        what = tree[0]
        if what == "num":
            return Value("n", F.lit(tree[1]), _null())
        if what == "str":
            return Value("s", F.lit(tree[1]), _null())
        if what == "bool":
            return Value("b", F.lit(tree[1]), _null())
        if what == "ref" and tree[1].b is None:
            return self.cell(tree[1])
        if what in ("neg", "pct"):
            v = number(self.value(tree[1]))
            return Value("n", -v.col if what == "neg" else v.col / 100.0, v.err)
        if what == "bin":
            return _binary(tree[1], self.value(tree[2]), self.value(tree[3]))
        if what == "call":
            return self.call(tree[1], tree[2])
        raise Unsupported(what)

    def call(self, name: str, args: list) -> Value:
        if name == "IF" and 1 <= len(args) <= 3:
            return self.choice(args)
        if name == "CONCATENATE":
            parts = [text(self.value(a)) for a in args]
            return Value("s", F.concat(*[p.col for p in parts]), F.coalesce(*[p.err for p in parts])) if parts else Value("s", F.lit(""), _null())
        if name in ("SUM", "COUNT", "AVERAGE", "MIN", "MAX"):
            return self.aggregate(name, args)
        if name in _ADDED:
            return _ADDED[name]([self.value(a) for a in args])
        raise Unsupported(name)

    def choice(self, args: list) -> Value:
        test = truth(self.value(args[0]))
        yes = _filled(self.value(args[1])) if len(args) > 1 else Value("b", F.lit(True), _null())
        no = _filled(self.value(args[2])) if len(args) > 2 else Value("b", F.lit(False), _null())
        err = F.coalesce(test.err, F.when(test.col, yes.err).otherwise(no.err))
        pick = lambda a, b: F.when(test.col, a).otherwise(b)
        if yes.kind == no.kind != "v":
            return Value(yes.kind, pick(yes.col, no.col), err)
        (ty, py), (tn, pn) = spread(yes), spread(no)
        return _merged(pick(ty, tn), *(pick(py[k], pn[k]) for k in "nsb"), err)

    def _stats(self, tree) -> list[Stats]:
        """The numbers of an argument: in referenced cells only numbers count, typed values are coerced."""
        if tree[0] == "ref" and tree[1].b is not None:
            a, b = tree[1].a, tree[1].b
            if self._own(a) and self._own(b):
                lo, hi = sorted((a.col, b.col))
                return [_one(self.sheet.value(column_letters(k)), True) for k in range(lo, hi + 1)]
            if self.resolver is None:
                raise Unsupported(str(tree[1]))
            return [self.resolver.range(tree[1])]
        return [_one(self.value(tree), tree[0] == "ref")]

    def aggregate(self, name: str, args: list) -> Value:
        stats = [s for a in args for s in self._stats(a)]
        if not stats:
            return Value("n", F.lit(0.0), F.lit(DIV0) if name == "AVERAGE" else _null())
        total, count, err = stats[0].total, stats[0].count, F.coalesce(*[s.err for s in stats])
        for s in stats[1:]:
            total, count = total + s.total, count + s.count
        if name == "SUM":
            return Value("n", total, err)
        if name == "COUNT":
            return Value("n", count.cast("double"), _null())
        if name == "AVERAGE":
            return Value("n", F.try_divide(total, count), F.coalesce(err, F.when(count == 0, DIV0)))
        ends = [s.least if name == "MIN" else s.most for s in stats]
        best = ends[0] if len(ends) == 1 else (F.least if name == "MIN" else F.greatest)(*ends)
        return Value("n", F.coalesce(best, F.lit(0.0)), err)


def _one(v: Value, referenced: bool) -> Stats:
    tag, parts = spread(v)
    if referenced:
        x, err = (v.col if v.kind == "n" else F.when(tag == "n", parts["n"])), v.err
    else:
        n = number(v)
        x, err = F.when(n.err.isNull() & (tag != "z"), n.col), n.err
    x = F.when(err.isNull(), x)
    return Stats(F.coalesce(x, F.lit(0.0)), x.isNotNull().cast("long"), x, x, err)


def compile_formula(formula: str, sheet: Sheet, row: int = 2, resolver: Resolver | None = None) -> Value | None:
    """The value and error of a fill-down formula as written in the given row, or None if it isn't supported. Without
    a resolver, only that row's cells can be referred to."""
    try:
        v = _filled(Lowering(sheet, row, resolver).value(parse(formula)))
    except Unsupported:
        return None
    return Value(v.kind, F.when(v.err.isNull(), v.col), v.err, v.maybe_blank, v.tag, v.parts)


def kind_of(data_type: str) -> str:
    return {"string": "s", "boolean": "b"}.get(data_type, "n")


def as_cell(col: Column, data_type: str) -> Column:
    """A column as cells hold it: numbers are doubles, dates serials."""
    if data_type in ("string", "boolean"):
        return col
    if data_type.startswith("timestamp") or data_type == "date":
        from quadrille.functions.dates import serial_column

        return serial_column(col)
    return col.cast("double")


def bind(df: DataFrame) -> Sheet:
    """The sheet of a DataFrame: its columns as A, B, ... ."""
    return Sheet({column_letters(k): (kind_of(kind), as_cell(F.col(f"`{name}`"), kind), None) for k, (name, kind) in enumerate(df.dtypes, 1)})


def aggregate(name: str, col: Column, exact: int | None = None) -> tuple[Column, Column]:
    """A range aggregate over all rows: its value, and its error. Empty ranges are 0, but an average #DIV/0!. With
    exact, sums are of decimals with so many places, so that they don't depend on the order of the rows."""
    none, total = _null(), F.sum(col) if exact is None else F.sum(col.cast(f"decimal(28,{exact})")).cast("double")
    return {
        "SUM": (F.coalesce(total, F.lit(0.0)), none),
        "COUNT": (F.count(col).cast("double"), none),
        "AVERAGE": (F.try_divide(total, F.count(col)), F.when(F.count(col) == 0, DIV0)),
        "MIN": (F.coalesce(F.min(col), F.lit(0.0)), none),
        "MAX": (F.coalesce(F.max(col), F.lit(0.0)), none),
    }[name.upper()]
