"""Edits of sheets: cells set and cleared, rows appended, sheets added and deleted, rows and columns shifted.

Sheets are tables of cells with columns sheet, row (from 1) and col (from 0), or of rows with a column of row numbers.
Every edit gives a new table; edits of one address in a batch must be unique (set_cells keeps the last by ``order``).
Null values of edits clear the cell. Empty tables are sheets without cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.refs import MAX_COLS, MAX_ROWS, Axis, forget_sheet, rewrite_formula

ADDRESS = ["sheet", "row", "col"]


def set_cells(cells: DataFrame, edits: DataFrame, keys: list[str] | None = None, keep: str | None = None, order: str | None = None) -> DataFrame:
    """Upsert by address. An edit with null in every value clears its cell; where the boolean column ``keep`` is true,
    null values leave the old ones (a change of style alone). Where addresses repeat, the greatest ``order`` wins."""
    keys = keys or ADDRESS
    values = [c for c in cells.columns if c not in keys]
    if order:
        edits = edits.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in edits.columns if c not in keys]), order).alias("_e")).select(*keys, "_e.*")
    new = edits.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[F.col(c).alias(f"_v{j}") for j, c in enumerate(values)], (F.col(keep) if keep else F.lit(False)).alias("_keep"), F.lit(True).alias("_edited"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]
    both = cells.join(new, on, "full")
    edited, kept = F.coalesce("_edited", F.lit(False)), F.coalesce("_keep", F.lit(False))
    chosen = [F.when(edited & ~kept, F.col(f"_v{j}")).when(edited, F.coalesce(f"_v{j}", c)).otherwise(F.col(c)).alias(c) for j, c in enumerate(values)]
    cleared = edited & ~kept
    for j in range(len(values)):
        cleared = cleared & F.col(f"_v{j}").isNull()
    return both.filter(~cleared).select(*[F.coalesce(k, f"_k{j}").alias(k) for j, k in enumerate(keys)], *chosen)


def append_rows(sheet: DataFrame, new: DataFrame, row_col: str = "row", edited_rows: DataFrame | None = None) -> DataFrame:
    """new, whose rows are numbered from 1, after the last row of the sheet or of the edits, whichever is later."""
    last = sheet.agg(F.max(row_col).alias("_last"))
    if edited_rows is not None:
        last = last.union(edited_rows.agg(F.max(row_col))).agg(F.max("_last").alias("_last"))
    moved = new.crossJoin(F.broadcast(last)).withColumn(row_col, F.col(row_col) + F.coalesce("_last", F.lit(0))).drop("_last")  # one row
    over = F.assert_true(F.col(row_col) <= MAX_ROWS, F.lit(f"a sheet has {MAX_ROWS} rows at most")).isNull()
    return sheet.unionByName(moved.filter(over))


def valid_sheet_name(name: Column) -> Column:
    """1 to 31 characters, none of [ ] : * ? / \\ , no apostrophe at an end."""
    return F.coalesce(name.rlike(r"^[^\[\]:*?/\\]{1,31}$") & ~name.rlike(r"^'|'$"), F.lit(False))


def add_sheet(catalog: DataFrame, cells: DataFrame, name: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog (sheet, position, state) and cells with a sheet after the others; an error if the name is no good or
    is there without case."""
    spark = catalog.sparkSession
    if not spark.range(1).select(valid_sheet_name(F.lit(name))).first()[0] or not catalog.filter(F.lower("sheet") == name.lower()).isEmpty():
        raise ValueError(f"sheet name {name!r} can't be used")
    row = catalog.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position")).select(F.lit(name).alias("sheet"), "position", F.lit("visible").alias("state"))
    return catalog.select("sheet", "position", "state").unionByName(row), cells.unionByName(new.withColumn("sheet", F.lit(name)).select(cells.columns))


def delete_sheet(catalog: DataFrame, cells: DataFrame, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog, cells and defined names (name, scope, formula) without a sheet: names of its scope go, other formulas
    that refer to it get #REF!. The last visible sheet can't go."""
    if catalog.filter((F.col("sheet") != name) & (F.col("state") == "visible")).isEmpty():
        raise ValueError("a workbook keeps one visible sheet")
    kept = cells.filter(F.col("sheet") != name)
    return catalog.filter(F.col("sheet") != name), map_formulas(kept, lambda f: forget_sheet(f, name)), map_formulas(names.filter(~F.col("scope").eqNullSafe(name)), lambda f: forget_sheet(f, name))


def map_formulas(table: DataFrame, change, column: str = "formula", own: Column | None = None) -> DataFrame:
    """table with its formulas rewritten. Filled-down formulas repeat, so each distinct text is rewritten once and
    joined back. change takes the formula, or the formula and whether the row is own."""
    flag = F.lit(True) if own is None else own
    marked = table.withColumn("_own", flag)
    single = own is None

    @F.pandas_udf("string")
    def run(text: pd.Series, mine: pd.Series) -> pd.Series:
        return pd.Series([change(t) if single else change(t, bool(m)) for t, m in zip(text, mine)], index=text.index, dtype=object)

    texts = marked.filter(F.col(column).isNotNull()).select(F.col(column).alias("_old"), F.col("_own").alias("_mine")).distinct()
    texts = texts.withColumn("_new", run("_old", "_mine"))
    joined = marked.join(texts, (marked[column] == texts["_old"]) & (marked["_own"] == texts["_mine"]), "left")
    return joined.withColumn(column, F.col("_new")).select(*table.columns)


def shift(cells: DataFrame, rows: Axis = Axis(), cols: Axis = Axis(), sheet: str | None = None, edge: bool = True) -> DataFrame:
    """The cells after rows and columns (from 1) of a sheet (or of all) were inserted and deleted, in order. Other
    sheets' formulas follow where they name that sheet. A cell beyond the edge of a sheet is an error; without edge the
    rows are those of a table, which may be longer than a sheet."""
    own = F.lit(True) if sheet is None else F.col("sheet") == sheet
    row, col = rows.column(F.col("row")), cols.column(F.col("col") + 1) - 1
    moved = cells.withColumn("_r", F.when(own, row).otherwise(F.col("row"))).withColumn("_c", F.when(own, col).otherwise(F.col("col"))).filter("_r is not null and _c is not null")
    fits = (F.col("_r") <= MAX_ROWS) & (F.col("_c") < MAX_COLS) if edge else F.col("_c") < MAX_COLS
    over = F.assert_true(fits, F.lit("cells were moved off the sheet")).isNull()
    moved = moved.filter(over).withColumn("row", F.col("_r")).withColumn("col", F.col("_c")).select(cells.columns)
    if "formula" not in cells.columns:
        return moved
    return map_formulas(moved, lambda f, mine: rewrite_formula(f, rows, cols, sheet, mine), own=own)


def insert_rows(cells: DataFrame, at: int, count: int, sheet: str | None = None, edge: bool = True) -> DataFrame:
    return shift(cells, rows=Axis(((at, count, True),)), sheet=sheet, edge=edge)


def delete_rows(cells: DataFrame, at: int, count: int, sheet: str | None = None, edge: bool = True) -> DataFrame:
    return shift(cells, rows=Axis(((at, count, False),)), sheet=sheet, edge=edge)


def insert_columns(cells: DataFrame, at: int, count: int, sheet: str | None = None) -> DataFrame:
    """at: the column number from 1."""
    return shift(cells, cols=Axis(((at, count, True),)), sheet=sheet)


def delete_columns(cells: DataFrame, at: int, count: int, sheet: str | None = None) -> DataFrame:
    return shift(cells, cols=Axis(((at, count, False),)), sheet=sheet)


def shift_boxes(boxes: DataFrame, rows: Axis = Axis(), cols: Axis = Axis()) -> DataFrame:
    """Ranges (r1, c1, r2, c2; from 1) of merges, rules, links, filters, prints after the same edits; ranges of which
    nothing is left go."""
    r1, r2 = rows.span_columns(F.col("r1"), F.col("r2"))
    c1, c2 = cols.span_columns(F.col("c1"), F.col("c2"))
    moved = boxes.withColumn("_b", F.struct(r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2")))
    moved = moved.withColumns({k: F.col(f"_b.{k}") for k in ("r1", "c1", "r2", "c2")}).drop("_b")
    return moved.filter("r1 is not null and c1 is not null and r2 is not null and c2 is not null")


def shift_table_columns(columns: DataFrame, cols: Axis) -> DataFrame:
    """The columns (table, col from 1, header) of tables after edits of columns: deleted ones go, and each table gets
    new headers ColumnN, N being the first number free in it, for the places that opened inside it."""
    from quadrille.operators.shaping import name_headers

    moved = columns.withColumn("_to", cols.column(F.col("col"))).filter("_to is not null").drop("col").withColumnRenamed("_to", "col")
    span = moved.groupBy("table").agg(F.min("col").alias("_a"), F.max("col").alias("_b"))
    places = span.select(F.col("table").alias("_t"), F.explode(F.sequence("_a", "_b")).alias("_c"))
    full = places.join(moved, (places["_t"] == moved["table"]) & (places["_c"] == moved["col"]), "left")
    grouped = full.groupBy(F.col("_t").alias("table")).agg(F.array_sort(F.collect_list(F.struct(F.col("_c").alias("col"), "header"))).alias("_h"))  # 16,384 columns at most
    named = grouped.withColumn("_n", name_headers(F.transform("_h", lambda h: h["header"])))
    return named.select("table", F.posexplode("_n").alias("_p", "header"), "_h").select("table", F.element_at("_h", F.col("_p") + 1)["col"].alias("col"), "header")


def merge_styles(base: Column, patch: Column, fields: list[str], whole: tuple[str, ...] = ("fill", "numFmt")) -> Column:
    """A style struct patched property by property; fills and number formats are replaced as a whole."""
    return F.struct(*[F.coalesce(patch[f], base[f]).alias(f) for f in [*fields, *(w for w in whole if w not in fields)]])
