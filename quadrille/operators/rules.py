"""Conditional-format and validation rules as predicates, aggregates and joins.

A rule adds a column to the sheet. Rules that look at a whole range take its figures from one aggregate (by group, where
``by`` names columns) that is joined back, so no window holds a whole sheet; ranks use a window only below a cut by
value. Nulls are blank cells: they meet no rule, but count as valid where blanks are allowed. Repeated rows are cells
of their own; ties share a rank; an empty sheet gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPARE = {
    "equal": lambda c, a, b: c == a, "notEqual": lambda c, a, b: c != a, "greaterThan": lambda c, a, b: c > a, "lessThan": lambda c, a, b: c < a,
    "greaterThanOrEqual": lambda c, a, b: c >= a, "lessThanOrEqual": lambda c, a, b: c <= a, "between": lambda c, a, b: c.between(a, b), "notBetween": lambda c, a, b: ~c.between(a, b),
}


def cell_is(cell: Column, operator: str, a, b=None) -> Column:
    """One of the eight comparisons; text compares without case; bounds belong to between."""
    fold = lambda v: v.lower() if isinstance(v, str) else v
    cell = F.lower(cell) if isinstance(a, str) else cell
    return F.coalesce(COMPARE[operator](cell, F.lit(fold(a)), F.lit(fold(b))), F.lit(False))


def text_is(cell: Column, operator: str, text: str) -> Column:
    """containsText, notContainsText, beginsWith or endsWith, without case."""
    low, want = F.lower(F.coalesce(cell.cast("string"), F.lit(""))), text.lower()
    return {"containsText": lambda: low.contains(want), "notContainsText": lambda: ~low.contains(want), "beginsWith": lambda: low.startswith(want), "endsWith": lambda: low.endswith(want)}[operator]()


def expression(df: DataFrame, formula: str, row: int = 2) -> Column:
    """Whether a formula, written for the given row, is true or not 0; errors and text are not."""
    from quadrille.functions.formula import bind, compile_formula, truth

    v = compile_formula(formula, bind(df), row)
    if v is None:
        raise ValueError(f"unsupported formula: {formula}")
    t = truth(v)
    return F.coalesce(F.when(t.err.isNull(), t.col), F.lit(False))


def beside(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """df with the figures of its group: one row of figures is broadcast, groups are joined."""
    if not by:
        return df.crossJoin(F.broadcast(stats))  # one row
    keys = stats.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[c for c in stats.columns if c not in by])
    on = functools.reduce(lambda p, q: p & q, [df[c].eqNullSafe(keys[f"_by{k}"]) for k, c in enumerate(by)])
    return df.join(keys, on, "left").drop(*[f"_by{k}" for k in range(len(by))])


def top(df: DataFrame, column: str, rank: int, out: str, percent: bool = False, bottom: bool = False, by: list[str] | None = None) -> DataFrame:
    """Whether a cell is among the top (or bottom) rank cells, or percent of them (one at least); ties are in.

    The value of the last rank is found among the counts of distinct values, so a hot group is summed up before it is
    sorted; then cells compare with that value."""
    by = by or []
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_v").asc() if bottom else F.col("_v").desc()
    if percent:
        limits = beside(values, values.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.sum("_n") * rank / 100)).alias("_limit")), by)
        upto = F.sum("_n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
        inside = limits.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") < F.col("_limit"))
    elif by:  # a distinct value's place is no later than its cells' rank, so more than rank values are never needed
        place = F.row_number().over(W.partitionBy(*by).orderBy(order))
        upto = F.sum("_n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
        inside = values.withColumn("_place", place).filter(F.col("_place") <= rank).withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") < rank)
    else:
        upto = F.sum("_n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
        inside = values.orderBy(order).limit(rank).withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") < rank)
    cut = inside.groupBy(*by).agg((F.max("_v") if bottom else F.min("_v")).alias("_cut"))
    meets = F.col(column) <= F.col("_cut") if bottom else F.col(column) >= F.col("_cut")
    return beside(df, cut, by).withColumn(out, F.coalesce(meets, F.lit(False))).drop("_cut")


def average(df: DataFrame, column: str, out: str, below: bool = False, equal: bool = False, by: list[str] | None = None, places: int | None = None) -> DataFrame:
    """Whether a cell is above (or below) its range's average. With places, the sum is one of decimals."""
    by = by or []
    total = F.sum(column) if places is None else F.sum(F.col(column).cast(f"decimal(28,{places})")).cast("double")
    stats = df.groupBy(*by).agg((F.try_divide(total, F.count(column))).alias("_avg"))
    c, a = F.col(column), F.col("_avg")
    meets = (c <= a if equal else c < a) if below else (c >= a if equal else c > a)
    return beside(df, stats, by).withColumn(out, F.coalesce(meets, F.lit(False))).drop("_avg")


def repeated(df: DataFrame, column: str, out: str, unique: bool = False, by: list[str] | None = None) -> DataFrame:
    """Whether a cell's value is there more than once (or just once); text without case."""
    by = by or []
    key = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    keyed = df.withColumn("_key", key)
    counts = keyed.filter(F.col("_key").isNotNull()).groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return beside(keyed, counts, [*by, "_key"]).withColumn(out, n == 1 if unique else n > 1).drop("_n", "_key")


def _span(df: DataFrame, column: str, by: list[str], low: float | None, high: float | None) -> DataFrame:
    fixed = lambda v, f: F.lit(float(v)) if v is not None else f(column).cast("double")
    return beside(df, df.groupBy(*by).agg(fixed(low, F.min).alias("_lo"), fixed(high, F.max).alias("_hi")), by)


def data_bar(df: DataFrame, column: str, out: str, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The length of a cell's bar from 0 to 1, between the least and greatest value or fixed bounds."""
    share = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return _span(df, column, by or [], low, high).withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col(column).isNotNull(), F.coalesce(share, F.lit(0.0)))))).withColumn(out, F.when(F.col(column).isNotNull(), F.col(out))).drop("_lo", "_hi")


def color_scale(df: DataFrame, column: str, out: str, colors: list[str], by: list[str] | None = None) -> DataFrame:
    """The colour (RRGGBB) of a cell between two or three colours, at the least value, the median and the greatest."""
    by = by or []
    spanned = _span(df, column, by, None, None)
    c, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    if len(colors) == 3:
        middle = df.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("_mid"))
        spanned = beside(spanned, middle, by)
    stops = [lo, *([F.col("_mid")] if len(colors) == 3 else []), hi]
    parts = []
    for k in range(0, 6, 2):
        levels = [int(x[-6:][k : k + 2], 16) for x in colors]
        mix = lambda j: levels[j] + (levels[j + 1] - levels[j]) * F.coalesce(F.try_divide(c - stops[j], stops[j + 1] - stops[j]), F.lit(0.0))
        shade = mix(0) if len(colors) == 2 else F.when(c < stops[1], mix(0)).otherwise(mix(1))
        parts.append(F.lpad(F.hex(F.floor(shade + 0.5)), 2, "0"))
    return spanned.withColumn(out, F.when(c.isNotNull(), F.concat(*parts))).drop("_lo", "_hi", "_mid")


def icon_set(df: DataFrame, column: str, out: str, icons: int = 3, reverse: bool = False, by: list[str] | None = None) -> DataFrame:
    """The number of a cell's icon from 0, by thresholds at round(100 k / icons) percent of the span."""
    shares = [round(100 * k / icons) / 100 for k in range(1, icons)]
    c, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    step = sum(((c >= lo + (hi - lo) * s).cast("int") for s in shares), F.lit(0))
    return _span(df, column, by or [], None, None).withColumn(out, F.when(c.isNotNull(), icons - 1 - step if reverse else step)).drop("_lo", "_hi")


def first_match(rules: list[Column]) -> Column:
    """The number (from 1) of the first rule that is met, as priorities go; null if none."""
    return F.coalesce(*[F.when(r, F.lit(k)) for k, r in enumerate(rules, 1)])


def matches(rules: list[Column]) -> Column:
    """The numbers of all rules that are met, in order of priority."""
    return F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in enumerate(rules, 1)]))


def valid(cell: Column, kind: str, operator: str = "between", a=None, b=None, items: list | None = None, formula: Column | None = None, allow_blank: bool = True) -> Column:
    """Whether a cell passes a validation: list, whole, decimal, date, time, textLength or custom."""
    if kind == "list":
        ok = cell.cast("string").isin([str(x) for x in items or []])
    elif kind == "custom":
        ok = formula
    elif kind == "textLength":
        units = F.length(cell.cast("string")) + F.length(F.regexp_replace(cell.cast("string"), r"[\x{0}-\x{FFFF}]", ""))  # UTF-16
        ok = cell_is(units, operator, a, b)
    else:
        number = cell.try_cast("double") if kind in ("whole", "decimal") else cell
        ok = cell_is(number, operator, a, b)
        if kind == "whole":
            ok = ok & (number == F.floor(number))
        if kind == "time":
            ok = ok & (number >= 0) & (number < 1)
    ok = F.coalesce(ok, F.lit(False))
    return F.when(cell.isNull(), F.lit(allow_blank)).otherwise(ok)


def valid_member(df: DataFrame, column: str, allowed: DataFrame, out: str, allow_blank: bool = True) -> DataFrame:
    """Membership in a list that is a column of another sheet, however long: a join with its distinct values."""
    keys = allowed.select(F.col(allowed.columns[0]).cast("string").alias("_item")).filter("_item is not null").distinct()
    joined = df.join(keys, df[column].cast("string") == keys["_item"], "left")
    return joined.withColumn(out, F.when(F.col(column).isNull(), F.lit(allow_blank)).otherwise(F.col("_item").isNotNull())).drop("_item")
