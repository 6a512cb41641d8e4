"""Formula columns over a sheet of any size: fill-down formulas that read other rows, ranges, and each other.

A sheet is a DataFrame with a column of row numbers; its other columns are A, B, ... in order, and the formula columns
follow them. What a formula needs beyond its own row is brought in by Spark operators, chosen by how the reference
moves when the formula is filled down:

    A1 from row 2       another row at a fixed distance     equi-join on row + distance
    $A$1, A$1           one fixed row                       broadcast of that one row
    A$2:A$99            a fixed range                       aggregate, then broadcast of its one row
    A1:A3 from row 2    a range that moves along            window within blocks of rows, with their neighbours
    A$2:A2              a range that grows                  window within blocks, plus totals of the blocks before

No window ever spans the whole sheet, so no task holds it. Formula columns are computed in the order of their
dependencies. A formula whose evaluation reaches a cycle is 0, one that reads an unsupported formula is unsupported,
and unsupported formulas are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions.formula import Sheet, Stats, Unsupported, Value, as_cell, compile_formula, kind_of, parse, references
from quadrille.functions.refs import End, Ref, column_letters

#: Rows of a block of a growing range, and of a moving one at least.
BLOCK = 65_536


def _side(e: End, first_row: int) -> tuple[bool, int]:
    """Whether the row is fixed, and the row or its distance from the formula's."""
    return (True, e.row) if e.row_fixed else (False, e.row - first_row)


class _Gather:
    """Collects what one formula needs from other rows, as columns added to the sheet."""

    def __init__(self, df: DataFrame, row_col: str, sheet: Sheet, first_row: int):
        self.df, self.row_col, self.sheet, self.first_row, self.added = df, row_col, sheet, first_row, 0

    def _names(self, n: int) -> list[str]:
        self.added += n
        return [f"_ref{self.added - k}" for k in range(n)]

    def _known(self, letters: str) -> tuple[str, Column, Column | None]:
        if letters not in self.sheet.columns:
            return "z", F.lit(None).cast("string"), None
        return self.sheet.columns[letters]

    def cell(self, ref: Ref, letters: str) -> Value:
        kind, col, err = self._known(letters)
        fixed, at = _side(ref.a, self.first_row)
        value_name, err_name, key = self._names(3)
        kept = [col.alias(value_name), (F.lit(None).cast("string") if err is None else err).alias(err_name)]
        if fixed:
            one = self.df.filter(F.col(self.row_col) == at).agg(*[F.first(c).alias(n) for c, n in zip(kept, (value_name, err_name))])
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
        else:
            there = self.df.select((F.col(self.row_col) - at).alias(key), *kept)
            self.df = self.df.join(there, self.df[self.row_col] == there[key], "left").drop(key)
        return Value(kind, F.col(value_name), F.col(err_name), True)

    def range(self, ref: Ref) -> Stats:
        (fix_a, a), (fix_b, b) = _side(ref.a, self.first_row), _side(ref.b, self.first_row)
        lo, hi = sorted((ref.a.col, ref.b.col))
        cells = [self._known(column_letters(k)) for k in range(lo, hi + 1)]
        numbers = [col for kind, col, _ in cells if kind == "n"]
        errors = [err for _, _, err in cells if err is not None]
        names = dict(zip(("total", "count", "least", "most", "err"), self._names(5)))
        row = F.col(self.row_col)
        none = F.lit(None).cast("double")
        per_row = [
            sum((F.coalesce(x, F.lit(0.0)) for x in numbers), F.lit(0.0)).alias("_t"),
            sum((x.isNotNull().cast("long") for x in numbers), F.lit(0).cast("long")).alias("_n"),
            (F.array_min(F.array(*numbers)) if numbers else none).alias("_l"),
            (F.array_max(F.array(*numbers)) if numbers else none).alias("_m"),
            (F.coalesce(*errors) if errors else F.lit(None).cast("string")).alias("_e"),
        ]
        slim = self.df.select(row.alias("_row"), *per_row)
        first_error = F.min(F.when(F.col("_e").isNotNull(), F.struct("_row", "_e")))
        sums = {"total": F.sum("_t"), "count": F.sum("_n"), "least": F.min("_l"), "most": F.max("_m"), "err": first_error}
        if fix_a and fix_b:
            one = slim.filter(F.col("_row").between(*sorted((a, b)))).agg(*[c.alias(names[k]) for k, c in sums.items()])
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
        elif not fix_a and not fix_b:
            self._moving(slim, sums, names, *sorted((a, b)))
        elif fix_a and not fix_b:
            self._growing(slim, sums, names, a, b)
        else:
            raise Unsupported(str(ref))  # from here to a fixed row below
        return Stats(F.coalesce(names["total"], F.lit(0.0)), F.coalesce(names["count"], F.lit(0)), F.col(names["least"]), F.col(names["most"]), F.col(f"{names['err']}._e"))

    def _moving(self, slim: DataFrame, sums: dict[str, Column], names: dict[str, str], low: int, high: int) -> None:
        """Blocks hold their own rows and those that their windows reach; each row's window lies within its block."""
        size = max(4096, 4 * (high - low + 1))
        row = F.col("_row")
        block = F.floor(row / size)
        reach = F.sequence(F.least(block, F.floor((row - high) / size)), F.greatest(block, F.floor((row - low) / size)))
        dealt = slim.withColumn("_block", F.explode(reach))
        over = W.partitionBy("_block").orderBy("_row").rangeBetween(low, high)
        out = dealt.select("_row", "_block", *[c.over(over).alias(names[k]) for k, c in sums.items()]).filter(F.col("_block") == F.floor(F.col("_row") / size)).drop("_block")
        self.df = self.df.join(out, self.df[self.row_col] == out["_row"], "left").drop("_row")

    def _growing(self, slim: DataFrame, sums: dict[str, Column], names: dict[str, str], start: int, reach: int) -> None:
        """Totals of whole blocks are few, one a block; within a block, a window."""
        slim = slim.filter(F.col("_row") >= start).withColumn("_row", F.col("_row") - reach)
        block = F.floor(F.col("_row") / BLOCK)
        before = slim.groupBy(block.alias("_block")).agg(*[c.alias(k) for k, c in sums.items()])
        past = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
        carried = {"total": F.sum("total"), "count": F.sum("count"), "least": F.min("least"), "most": F.max("most"), "err": F.min("err")}
        before = before.select(F.col("_block").alias("_past"), *[c.over(past).alias(f"_p_{k}") for k, c in carried.items()])
        over = W.partitionBy("_block").orderBy("_row").rangeBetween(W.unboundedPreceding, 0)
        here = slim.withColumn("_block", block).select("_row", "_block", *[c.over(over).alias(f"_h_{k}") for k, c in sums.items()])
        both = here.join(F.broadcast(before), here["_block"] == before["_past"])
        add = lambda k: F.coalesce(f"_p_{k}", F.lit(0)) + F.coalesce(f"_h_{k}", F.lit(0))
        merged = {"total": add("total"), "count": add("count"), "least": F.least("_p_least", "_h_least"), "most": F.greatest("_p_most", "_h_most"), "err": F.coalesce("_p_err", "_h_err")}
        out = both.select(F.col("_row").alias("_at"), *[c.alias(names[k]) for k, c in merged.items()])
        self.df = self.df.join(out, self.df[self.row_col] == out["_at"], "left").drop("_at")


def _order(formulas: dict[str, str], letters: dict[str, str]) -> tuple[list[str], set[str], set[str]]:
    """The formulas by dependency, those that reach a cycle, and those that can't be supported."""
    of = {v: k for k, v in letters.items()}
    needs: dict[str, set[str]] = {}
    broken: set[str] = set()
    for name, f in formulas.items():
        try:
            refs = references(parse(f))
        except Unsupported:
            refs, _ = [], broken.add(name)
        used = {of.get(column_letters(k)) for r in refs for k in range(min(r.a.col, (r.b or r.a).col), max(r.a.col, (r.b or r.a).col) + 1)}
        needs[name] = {x for x in used if x}
    done: list[str] = []
    while ready := [n for n in formulas if n not in done and needs[n] <= set(done)]:
        done += ready
    circular = set(formulas) - set(done)
    return done, circular, broken


def fill_down(df: DataFrame, formulas: dict[str, str], row_col: str = "row", first_row: int = 2) -> DataFrame:
    """df with a column for each formula, and its errors in a column <name>_err. Formulas are written as in first_row.

    Null cells are blank; an empty sheet gives no rows; rows missing between others are blank to references. A formula
    that mixes kinds gives a struct of kind, num, str and bool."""
    inputs = [(n, t) for n, t in df.dtypes if n != row_col]
    sheet = Sheet({column_letters(k): (kind_of(t), as_cell(F.col(f"`{n}`"), t), None) for k, (n, t) in enumerate(inputs, 1)})
    letters = {name: column_letters(len(inputs) + k) for k, name in enumerate(formulas, 1)}
    order, circular, broken = _order(formulas, letters)
    out = df
    for name in [*order, *(n for n in formulas if n in circular)]:
        value, none = None, F.lit(None).cast("string")
        gather = _Gather(out, row_col, sheet, first_row)
        if name in circular:
            value = Value("n", F.lit(0.0), none)
        elif name not in broken:
            value = compile_formula(formulas[name], sheet, first_row, gather)
        if value is None:
            broken.add(name)
            out = out.withColumn(name, none).withColumn(f"{name}_err", none)
            # what reads an unsupported formula is unsupported
            broken |= {n for n in order if letters[name] in {column_letters(r.a.col) for r in (references(parse(formulas[n])) if n not in broken else [])}}
            continue
        keep = [F.col(f"`{c}`") for c in out.columns]
        out = gather.df.select(*keep, value.col.alias(name), value.err.alias(f"{name}_err"))
        sheet.columns[letters[name]] = (value.kind if value.kind in "nsb" else "s", F.col(f"`{name}`"), F.col(f"`{name}_err`"))
    return out.select(*df.columns, *[c for n in formulas for c in (n, f"{n}_err")])


def evaluate_footer(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None, exact: int | None = None) -> DataFrame:
    """Footer formulas of whole columns, such as {"total": "SUM(C:C)"}: one row, or one a group. Only the five
    aggregates of one column are taken; with exact, sums are of decimals with so many places."""
    import re

    from quadrille.functions.formula import aggregate
    from quadrille.functions.refs import column_number

    cols = []
    for name, f in formulas.items():
        m = re.fullmatch(r"=?\s*([A-Za-z]+)\(\s*([A-Za-z]{1,3}):([A-Za-z]{1,3})\s*\)", f)
        if not m or m[2].upper() != m[3].upper():
            raise Unsupported(f)
        column = df.columns[column_number(m[2]) - 1]
        value, err = aggregate(m[1], as_cell(F.col(f"`{column}`"), dict(df.dtypes)[column]), exact)
        cols += [value.alias(name), err.alias(f"{name}_err")]
    return df.groupBy(*(by or [])).agg(*cols)


__all__ = ["evaluate_footer", "fill_down"]
