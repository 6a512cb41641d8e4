"""Shapes of sheets: cells, rows and typed columns; headers, gaps, repeats, previews, records and lines.

Cells are rows of (row from 1, col from 0, value); rows hold an array of cells, short ones being padded; the typed form
has one column per header. Order is always data: a row number, never the order of a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The columns of a table as cells (row, col, value), in text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("col"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)])
    return df.select(F.col(row).alias("row"), F.explode(pairs).alias("_x")).select("row", "_x.col", "_x.value")


def to_rows(cells: DataFrame) -> DataFrame:
    """row and cells: its values by place, gaps null. A row holds 16,384 cells at most."""
    kept = cells.filter("value is not null").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))
    width = F.array_max(F.map_keys("_m"))
    return kept.select("row", F.transform(F.sequence(F.lit(0), width), lambda k: F.element_at("_m", k)).alias("cells"))


def trim_nulls(cells: Column) -> Column:
    """An array of cells without the nulls at its end."""
    last = F.aggregate(cells, F.struct(F.lit(0).alias("at"), F.lit(0).alias("last")), lambda s, x: F.struct((s["at"] + 1).alias("at"), F.when(x.isNotNull(), s["at"] + 1).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    return F.when(last == 0, F.slice(cells, 1, 0)).otherwise(F.slice(cells, F.lit(1), last))


def name_headers(header: Column) -> Column:
    """Names of the columns below a header row, as an array: blanks by place (Column3), repeats numbered past the names
    taken before (Name_2)."""
    named = F.transform(header, lambda x, k: F.coalesce(F.when(x == "", None).otherwise(x), F.concat(F.lit("Column"), (k + 1).cast("string"))))

    def add(taken: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.when(n == 1, name).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))
        return F.concat(taken, F.array(F.element_at(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1)))

    return F.aggregate(named, F.array().cast("array<string>"), add)


def promote_header(cells: DataFrame, header_index: int = 0) -> DataFrame:
    """The typed form: row, and one text column per header. The header is the row of that index among the rows with
    cells; rows above it are skipped. Cells right of it get columns too (ColumnN), as their width is found first."""
    seen = cells.filter("value is not null").groupBy("row").agg(F.max("col").alias("_w"))
    head = seen.orderBy("row").limit(header_index + 1).orderBy(F.desc("row")).limit(1).first()  # one row number
    if head is None:
        return cells.select("row").limit(0)
    row, width = head["row"], seen.filter(F.col("row") >= head["row"]).agg(F.max("_w")).first()[0] + 1
    names = cells.filter(F.col("row") == row).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))
    names = names.select(name_headers(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.element_at("_m", k)))).first()[0]  # one header
    body = cells.filter(F.col("row") > row).groupBy("row")
    return body.agg(*[F.max(F.when(F.col("col") == k, F.col("value"))).alias(n) for k, n in enumerate(names)])


def records(typed: DataFrame, row: str = "row") -> DataFrame:
    """Each row as a JSON object of its columns, nulls included."""
    return typed.select(row, F.to_json(F.struct(*[c for c in typed.columns if c != row]), {"ignoreNullFields": "false"}).alias("record"))


def gap_rows(rows: DataFrame, row: str = "row", by: list[str] | None = None, block: int = 100_000) -> DataFrame:
    """The numbers of the rows that are missing between two rows; none before the first.

    The next row is looked up within blocks of numbers, and across blocks by the first row of the next block, one row
    a block, so that no window spans the sheet."""
    by = by or []
    keyed = rows.select(*by, F.col(row).alias("_r")).distinct().withColumn("_b", F.floor(F.col("_r") / block))
    firsts = keyed.groupBy(*by, "_b").agg(F.min("_r").alias("_f"))
    nexts = firsts.withColumn("_after", F.lead("_f").over(W.partitionBy(*by).orderBy("_b"))).drop("_f")
    within = keyed.withColumn("_next", F.lead("_r").over(W.partitionBy(*by, "_b").orderBy("_r")))
    joined = within.join(nexts, [*by, "_b"]).withColumn("_next", F.coalesce("_next", "_after")).filter(F.col("_next") > F.col("_r") + 1)
    return joined.select(*by, F.explode(F.sequence(F.col("_r") + 1, F.col("_next") - 1)).alias(row))


def number_rows(rows: DataFrame, order: str, given: str, out: str = "row", block: str | None = None) -> DataFrame:
    """Row numbers where some are missing or invalid: the last valid one before, and one more for each row since. rows
    of one sheet come by ``order``; ``block`` names the sheet."""
    over = W.partitionBy(*([block] if block else [F.lit(0)])).orderBy(order)
    ok = F.when(F.col(given).rlike(r"^[1-9]\d{0,6}$"), F.col(given).try_cast("int")) if dict(rows.dtypes)[given] == "string" else F.when(F.col(given) > 0, F.col(given))
    marked = rows.withColumn("_ok", ok).withColumn("_n", F.row_number().over(over))
    anchor = F.last(F.when(F.col("_ok").isNotNull(), F.struct("_ok", "_n")), ignorenulls=True).over(over)
    return marked.withColumn("_a", anchor).withColumn(out, F.coalesce(F.col("_a._ok") + F.col("_n") - F.col("_a._n"), F.col("_n"))).drop("_ok", "_n", "_a")


def expand_repeats(cells: DataFrame, count: str, out: str) -> DataFrame:
    """Cells with a repeat count written out, numbered from 1; a count below 1 gives none."""
    return cells.filter(F.col(count) > 0).withColumn(out, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))))


def filled(value: Column) -> Column:
    return value.isNotNull() & (value.cast("string") != "")


def count_filled(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """rows: those with a filled cell; cells: the filled ones."""
    n = sum((filled(F.col(c)).cast("long") for c in columns), F.lit(0))
    return rows.groupBy(*(by or [])).agg(F.count_if(n > 0).alias("rows"), F.coalesce(F.sum(n), F.lit(0)).alias("cells"))


def preview(rows: DataFrame, n: int, row: str) -> DataFrame:
    """The first n rows by number: each task keeps n, and the driver's plan takes n of those."""
    return rows.orderBy(row).limit(n)


def visible(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.coalesce("state", F.lit("visible")) == "visible")


def pick_sheet(cells: DataFrame, catalog: DataFrame, name: str | None = None) -> DataFrame:
    """The cells of a sheet by name, or of the first one in tab order."""
    chosen = catalog.filter(F.col("sheet") == name) if name is not None else catalog.orderBy("position").limit(1)
    return cells.join(F.broadcast(chosen.select("sheet")), "sheet", "left_semi")  # one row


def plain_text(runs: Column) -> Column:
    """The text of rich-text runs (an array of structs with text)."""
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def csv_lines(rows: DataFrame, columns: list[str], row: str = "row", delimiter: str = ",", gaps: bool = True) -> DataFrame:
    """row and line: each row as CSV, and an empty line for each row missing between two."""
    from quadrille.functions.csv_text import csv_line

    lines = rows.select(row, csv_line([F.col(c) for c in columns], delimiter).alias("line"))
    return lines.unionByName(gap_rows(rows, row).withColumn("line", F.lit(""))) if gaps else lines


def column_widths(cells: DataFrame, by: str = "col", value: str = "value") -> DataFrame:
    """The width that shows all texts of each column: 1.2 times the longest, from 10 to 255."""
    width = F.round(F.max(F.length(value)) * F.lit(1.2), 2)
    return cells.groupBy(by).agg(F.least(F.lit(255.0), F.greatest(F.lit(10.0), F.coalesce(width, F.lit(0.0)))).alias("width"))
