"""Display text of cells by format code, compiled to columns.

A code is a literal, so it is cut into sections and items when the plan is made, and each section becomes an expression
of built-in functions: no Python runs for any row. Numbers are rounded half away from zero on 15 significant digits:
a column of digits and an exponent, from which decimals are made. Dates come from whole ticks of the smallest unit
shown. Fractions take the best denominator among all of the code's width.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the built-in formats by id. Fixed values.
BUILTIN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Codes that formats stored by id alone show in en-US, where they differ. Fixed values.
SHOWN = {
    5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)', 8: '"$"#,##0.00_);[Red]("$"#,##0.00)', 14: "m/d/yyyy", 22: "m/d/yyyy h:mm",
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
}

_ITEM = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.?)|_(?P<gap>.?)|\*(?P<fill>.?)|\[(?P<bracket>[^\]]*)\]?|(?P<general>general)|(?P<half>am/pm|a/p)|(?P<date>y+|m+|d+|h+|s+)(?P<parts>\.0+)?'
    r"|(?P<power>e[+-])|(?P<digit>[0#?])|(?P<mark>[.,%/])|(?P<text>@)|(?P<other>.)",
    re.S | re.I,
)


@dataclass
class Item:
    """kind: lit, digit, point, comma, percent, slash, power, general, date, elapsed, half or text."""

    kind: str
    text: str = ""
    places: int = 0


@dataclass
class Section:
    items: list[Item]
    test: tuple[str, float] | None

    def has(self, *kinds: str) -> bool:
        return any(x.kind in kinds for x in self.items)


def _cut(code: str) -> list[str]:
    out, at = [], 0
    piece = re.compile(r'(?:"[^"]*"?|[\\_*].|\[[^\]]*\]?|[^;])*', re.S)
    while True:
        m = piece.match(code, at)
        out.append(m[0])
        if m.end() >= len(code):
            return out
        at = m.end() + 1


def _section(code: str) -> Section:
    items, test = [], None
    for m in _ITEM.finditer(code):
        what = m.lastgroup if m.lastgroup != "parts" else "date"
        if what == "bracket":
            inside = m["bracket"]
            if cond := re.fullmatch(r"(<=|>=|<>|<|>|=)\s*(-?[\d.]+(?:e[+-]?\d+)?)", inside, re.I):
                test = cond[1], float(cond[2])
            elif re.fullmatch(r"h+|m+|s+", inside, re.I):
                items.append(Item("elapsed", inside.lower()))
            elif inside.startswith("$"):
                items.append(Item("lit", inside[1:].partition("-")[0]))
        elif what in ("quoted", "escaped", "other"):
            items.append(Item("lit", m[what]))
        elif what == "gap":
            items.append(Item("lit", " "))
        elif what == "date":
            items.append(Item("date", m["date"].lower(), len(m["parts"] or ".") - 1))
        elif what == "mark":
            items.append(Item({".": "point", ",": "comma", "%": "percent", "/": "slash"}[m["mark"]], m["mark"]))
        elif what != "fill":
            items.append(Item(what, m[what] if what in ("half", "digit", "power") else ""))
    out: list[Item] = []
    for x in items:  # fractional seconds after an elapsed unit
        if out and out[-1].kind == "elapsed" and x.kind == "point" and not out[-1].places:
            out[-1].places = -1
        elif out and out[-1].kind == "elapsed" and out[-1].places and x.kind == "digit" and x.text == "0":
            out[-1].places = max(1, out[-1].places + 1) if out[-1].places > 0 else 1
        else:
            out.append(x)
    units = [x for x in out if x.kind in ("date", "elapsed")]
    for k, x in enumerate(units):  # m is minutes right after hours and right before seconds
        if x.kind == "date" and x.text[0] == "m" and ((k and units[k - 1].text[0] == "h") or (k + 1 < len(units) and units[k + 1].text[0] == "s")):
            x.text = "n" * len(x.text)
    return Section(out, test)


@lru_cache(1000)
def sections(code: str) -> tuple[Section, ...]:
    return tuple(_section(s) for s in _cut(code)[:4])


# -- numbers ---------------------------------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: expressions are trees, so each mention would compute it again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    """d: the 15 significant digits of |x|; p: the power of ten of the first one."""
    shown = F.format_string("%.14e", F.abs(x))
    return F.struct(F.concat(F.substring(shown, 1, 1), F.substring(shown, 3, 14)).alias("d"), F.substring_index(shown, "e", -1).cast("int").alias("p"))


def _scaled(digits: Column, power: Column) -> Column:
    """The digits of d.ddd times a power of ten, rounded to a whole number."""
    text = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 14), F.lit("E"), power.cast("string"))
    return F.when(power < 37, text.try_cast("decimal(38,0)").cast("string")).otherwise(F.concat(digits, F.repeat(F.lit("0"), power - 14)))


def _parted(digits: Column, places: Column) -> Column:
    """w: whole digits without leading zeros; f: the last so many digits."""
    full = F.when(F.length(digits) <= places, F.lpad(digits, places + 1, F.lit("0"))).otherwise(digits)

    def cut(text: Column) -> Column:
        whole = F.substring(text, F.lit(1), F.length(text) - places)
        return F.struct(F.when(whole == "0", "").otherwise(whole).alias("w"), F.when(places == 0, "").otherwise(F.right(text, places)).alias("f"))

    return let(full, cut)


def _fixed(x: Column, places: int) -> Column:
    """|x| rounded half up to so many places, as w and f."""
    return let(_digits(x), lambda g: let(_scaled(g["d"], g["p"] + places), lambda n: _parted(n, F.lit(places))))


def general(x: Column) -> Column:
    """Up to 11 characters in plain notation, else six digits and an exponent."""

    def plain(g: Column) -> Column:
        places = F.greatest(F.lit(0), 9 - F.greatest(g["p"], F.lit(0)))

        def joined(n: Column) -> Column:
            tail = F.regexp_replace(n["f"], "0+$", "")
            body = F.concat(F.when(n["w"] == "", "0").otherwise(n["w"]), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)))
            return F.when(g["p"].between(-4, 10) & (F.length(n["w"]) <= 11), body)

        return let(let(_scaled(g["d"], g["p"] + places), lambda n: _parted(n, places)), joined)

    six = F.format_string("%.5E", F.abs(x))
    short = F.concat(F.regexp_replace(F.regexp_replace(F.substring_index(six, "E", 1), "0+$", ""), r"\.$", ""), F.lit("E"), F.substring_index(six, "E", -1))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(x == 0, "0").otherwise(F.coalesce(let(_digits(x), plain), short)))


_PAD = {"0": "0", "?": " ", "#": ""}


def _place_whole(marks: list[str], digits: Column, grouped: bool = False) -> list[Column]:
    """What each placeholder of the whole part shows; the first one takes the digits that are too many."""
    out, n = [], F.length(digits)
    for k, mark in enumerate(marks):
        right = len(marks) - 1 - k  # places to its right
        comma = "," if grouped and right and right % 3 == 0 else ""
        if k == 0:
            text = digits.substr(F.lit(1), n - right)
            if grouped:
                longer = F.regexp_replace(F.concat(text, F.lit("0" * right)), r"(?<=\d)(?=(\d{3})+$)", ",")
                text = longer.substr(F.lit(1), F.length(longer) - (right + (right - 1) // 3 if right else 0))
        else:
            text = F.concat(digits.substr(n - right, F.lit(1)), F.lit(comma))
        blank = _PAD[mark] + (comma if mark == "0" else "")
        out.append(F.when(n > right, text).otherwise(blank))
    return out


def _place_part(marks: list[str], digits: Column) -> list[Column]:
    """What each decimal placeholder shows: zeros at the end are dropped by # and blank by ?."""
    kept = F.length(F.regexp_replace(digits, "0+$", ""))
    fixed = max((k + 1 for k, m in enumerate(marks) if m == "0"), default=0)
    out = []
    for k, mark in enumerate(marks):
        shown = digits.substr(k + 1, 1)
        out.append(shown if k < fixed else F.when(kept > k, shown).otherwise(_PAD[mark]))
    return out


def _number(section: Section, x: Column) -> Column:
    items = section.items
    spots = [k for k, i in enumerate(items) if i.kind == "digit"]

    def text(shown: dict[int, Column]) -> Column:
        parts = [shown[k] if k in shown else general(x) if i.kind == "general" else F.lit("" if i.kind in ("comma", "text") else i.text) for k, i in enumerate(items)]
        return F.concat(*parts) if parts else F.lit("")

    if not spots:
        return text({})
    size = F.abs(x) * float(100 ** sum(i.kind == "percent" for i in items))
    slash = next((k for k, i in enumerate(items) if i.kind == "slash" and k and items[k - 1].kind == "digit"), None)
    power = next((k for k, i in enumerate(items) if i.kind == "power"), None)
    if slash is not None:
        return let(size, lambda v: _fraction(items, spots, slash, v, text))
    return _scientific(items, spots, power, size, text) if power is not None else _decimal(items, spots, size, text)


def _around_point(items: list[Item], spots: list[int], end: int) -> tuple[list[int], list[int], int]:
    point = next((k for k, i in enumerate(items) if i.kind == "point" and k < end), end)
    return [k for k in spots if k < point], [k for k in spots if point < k < end], point


def _marks(items: list[Item], at: list[int]) -> list[str]:
    return [items[k].text for k in at]


def _decimal(items: list[Item], spots: list[int], x: Column, text: Callable) -> Column:
    whole, part, point = _around_point(items, spots, len(items))
    thousands, grouped = 0, False
    for k, i in enumerate(items):
        if i.kind == "comma":  # a comma without digits after it divides by 1000
            bound = point if k < point else len(items)
            if not any(k < j < bound for j in spots):
                thousands += 1
            elif k < point and any(j < k for j in spots):
                grouped = True
    value = _fixed(x / float(1000**thousands) if thousands else x, len(part))
    return let(value, lambda n: text(dict(zip([*whole, *part], [*_place_whole(_marks(items, whole), n["w"], grouped), *_place_part(_marks(items, part), n["f"])]))))


def _scientific(items: list[Item], spots: list[int], power: int, x: Column, text: Callable) -> Column:
    whole, part, _ = _around_point(items, spots, power)
    after = [k for k in spots if k > power]
    size, places = max(len(whole), 1), len(part)
    steps = size > 1 and any(items[k].text == "#" for k in whole)  # exponents are multiples of the whole digits
    exponent = lambda e: (F.floor(e / size) * size if steps else e - size + 1).cast("int")

    def rounded(g: Column) -> Column:
        top = g["p"]

        def carried(first: Column) -> Column:
            over = F.length(first) > top - exponent(top) + 1 + places  # rounded up to one more digit
            ten = F.concat(F.lit("1"), F.repeat(F.lit("0"), top + 1 - exponent(top + 1) + places))
            e = F.when(x == 0, 0).when(over, exponent(top + 1)).otherwise(exponent(top))
            return F.struct(F.when(x == 0, "0").when(over, ten).otherwise(first).alias("n"), e.alias("e"))

        return let(_scaled(g["d"], top - exponent(top) + places), carried)

    def shown(v: Column) -> Column:
        def placed(n: Column) -> Column:
            out = dict(zip([*whole, *part], [*_place_whole(_marks(items, whole), n["w"]), *_place_part(_marks(items, part), n["f"])]))
            out[power] = F.when(v["e"] < 0, "E-").otherwise("E+" if items[power].text.endswith("+") else "E")
            return text(out | dict(zip(after, _place_whole(_marks(items, after), F.abs(v["e"]).cast("string")))))

        return let(_parted(v["n"], F.lit(places)), placed)

    return let(let(_digits(x), rounded), shown)


def _fraction(items: list[Item], spots: list[int], slash: int, x: Column, text: Callable) -> Column:
    begin, end = slash, slash + 1
    while begin and items[begin - 1].kind == "digit":
        begin -= 1
    while end < len(items) and (items[end].kind == "digit" or re.fullmatch(r"\d", items[end].text)):
        end += 1
    whole, upper, lower = [k for k in spots if k < begin], [k for k in spots if begin <= k < slash], list(range(slash + 1, end))
    given = "".join(items[k].text for k in lower)
    fixed = int(given) if re.fullmatch(r"[1-9]\d*", given) else 0
    base = F.floor(x) if whole else F.lit(0).cast("long")
    rest = x - base
    pair = lambda error, d: F.struct(error.alias("e"), d.cast("long").alias("d"), F.floor(rest * d + 0.5).cast("long").alias("n"))
    if fixed:
        best = pair(F.lit(0.0), F.lit(fixed))
    else:  # the least error, then the least denominator
        best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(10 ** min(len(lower), 4) - 1)), lambda q: pair(F.round(F.abs(rest - F.floor(rest * q + 0.5) / q), 12), q)))

    def placed(f: Column) -> Column:
        carried = (f["n"] == f["d"]) & F.lit(bool(whole))
        n, units = F.when(carried, 0).otherwise(f["n"]), F.when(carried, base + 1).otherwise(base)
        lead = F.when((units > 0) | (n == 0), units.cast("string")).otherwise("")
        out = dict(zip([*whole, *upper], [*_place_whole(_marks(items, whole), lead), *_place_whole(_marks(items, upper), n.cast("string"))]))
        below = f["d"].cast("string")
        for j, k in enumerate(lower):
            out[k] = F.lit(items[k].text) if fixed else F.when(F.length(below) > j, F.substring(below, j + 1, 1)).otherwise(_PAD[items[k].text] if items[k].kind == "digit" else "")
        out[slash] = F.lit("/")
        if whole:  # a whole number leaves the fraction's width blank
            for k in range(begin, end):
                out[k] = F.when(n == 0, F.regexp_replace(out[k], ".", " ")).otherwise(out[k])
        return text(out)

    return let(best, placed)


# -- dates -----------------------------------------------------------------------------------------------------------

_WEEKDAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
_MONTHS = "January February March April May June July August September October November December".split()


def _named(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index.cast("int"))


def _padded(n: Column, width: int) -> Column:
    text = n.cast("long").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def _date(section: Section, x: Column, date1904: bool) -> Column:
    places = max((i.places for i in section.items if i.kind in ("date", "elapsed")), default=0)
    return let(F.floor(x * float(86_400 * 10**places) + 0.5), lambda ticks: _clock(section, ticks, places, date1904))


def _clock(section: Section, ticks: Column, places: int, date1904: bool) -> Column:
    per = 10**places
    days = F.floor(ticks / (86_400 * per))
    left = ticks - days * (86_400 * per)
    seconds, sub = F.floor(left / per), left % per
    hour, minute, second = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    if date1904:
        date = F.date_add(F.lit("1904-01-01").cast("date"), days.cast("int"))
        month, day, weekday = F.month(date), F.dayofmonth(date), F.dayofweek(date)
    else:  # 1900 has a 29 February, day 60, and a day 0 before its first
        date = F.date_add(F.lit("1899-12-30").cast("date"), F.when(days == 60, 59).when(days < 60, days + 1).otherwise(days).cast("int"))
        month = F.when(days == 0, 1).when(days == 60, 2).otherwise(F.month(date))
        day = F.when(days == 0, 0).when(days == 60, 29).otherwise(F.dayofmonth(date))
        weekday = F.pmod(days + 6, F.lit(7)) + 1
    year = F.when(days == 0, 1900).otherwise(F.year(date)) if not date1904 else F.year(date)
    half = section.has("half")
    out = []
    for i in section.items:
        n, tail = len(i.text), [F.lit("."), F.substring(F.lpad(sub.cast("string"), places, "0"), 1, i.places)] if i.places else []
        if i.kind == "elapsed":
            total = {"h": days * 24 + hour, "m": (days * 24 + hour) * 60 + minute, "s": days * 86_400 + seconds}[i.text[0]]
            out += [_padded(total, n), *tail]
        elif i.kind == "half":
            am, pm = ("AM", "PM") if n > 3 else (i.text[0], i.text[2])
            out.append(F.when(hour < 12, am).otherwise(pm))
        elif i.kind != "date":
            out.append(F.lit(i.text))
        elif i.text[0] == "y":
            out.append(_padded(year, 4) if n > 2 else _padded(year % 100, 2))
        elif i.text[0] == "m":
            out.append(_padded(month, n) if n < 3 else _named([m[:3] if n == 3 else m[:1] if n == 5 else m for m in _MONTHS], month))
        elif i.text[0] == "d":
            out.append(_padded(day, n) if n < 3 else _named([w[:3] if n == 3 else w for w in _WEEKDAYS], weekday))
        elif i.text[0] == "h":
            out.append(_padded(F.when(hour % 12 == 0, 12).otherwise(hour % 12) if half else hour, min(n, 2)))
        else:
            out += [_padded(minute if i.text[0] == "n" else second, min(n, 2)), *tail]
    return F.concat(*out)


# -- cells -----------------------------------------------------------------------------------------------------------

_TESTS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b, "=": lambda a, b: a == b}


def _shown(section: Section, x: Column, signed: bool, date1904: bool) -> Column:
    """A number in a section; signed: whether a minus is put before negative ones."""
    if section.has("date", "elapsed", "half"):
        shown = _date(section, F.abs(x), date1904)
        return F.when(x < 0, general(x)).otherwise(shown) if signed else shown
    shown = _number(section, F.abs(x))
    return F.concat(F.when(x < 0, "-").otherwise(""), shown) if signed else shown


def _text_section(parts: tuple[Section, ...]) -> Section | None:
    return parts[3] if len(parts) > 3 else parts[-1] if parts[-1].has("text") else None


def format_number_column(x: Column, code: str, date1904: bool = False) -> Column:
    parts = sections(code if code.strip() else "General")
    a, b, c, *_ = [*parts[: len(parts) - 1 if _text_section(parts) else 3], None, None, None]
    if a is None:
        out = general(x)
    elif a.test or (b and b.test):
        out = None
        for s in (a, b):
            if s and s.test:
                op, bound = s.test  # a section meant for negative numbers writes its own sign
                shown, hit = _shown(s, x, not (op[0] == "<" and bound <= 0), date1904), _TESTS[op](x, bound)
                out = F.when(hit, shown) if out is None else out.when(hit, shown)
        other = c if a.test and b and b.test else b if a.test else a
        out = out.otherwise(_shown(other, x, True, date1904) if other else general(x))
    else:
        out = _shown(a, x, True, date1904)
        if b:
            out = F.when(x < 0, _shown(b, x, False, date1904)).otherwise(out)
        if c:
            out = F.when(x == 0, _shown(c, x, True, date1904)).otherwise(out)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), "").when(odd, F.when(F.isnan(x), "NaN").when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(out)


def format_column(cell: Column, code: str, kind: str = "n", date1904: bool = False) -> Column:
    """The text of a column of numbers (kind n), texts (s) or booleans (b); null is ''. Dates are serials."""
    if kind == "b":
        return F.when(cell.isNull(), "").when(cell, "TRUE").otherwise("FALSE")
    if kind == "s":
        body = _text_section(sections(code if code.strip() else "General"))
        shown = cell if body is None else F.concat(F.lit(""), *[cell if i.kind == "text" else F.lit(i.text) for i in body.items])
        return F.when(cell.isNull(), "").otherwise(shown)
    return format_number_column(cell.cast("double"), code, date1904)
