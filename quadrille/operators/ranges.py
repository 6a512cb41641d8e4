"""Ranges of cells: parsing, overlap, cover and membership, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.refs import MAX_COLS, MAX_ROWS, number_of

#: Rows of a bucket of the overlap join.
BUCKET = 64


def parse_box(text: Column) -> Column:
    """A1 or A1:C9 as a struct of r1, c1, r2, c2 (from 1), corners in any order; null if it is none on the sheet."""
    bare = F.regexp_replace(F.upper(text), r"\$", "")
    ok = bare.rlike(r"^[A-Z]{1,3}[1-9][0-9]{0,6}(:[A-Z]{1,3}[1-9][0-9]{0,6})?$")
    first, second = F.substring_index(bare, ":", 1), F.substring_index(bare, ":", -1)
    col = lambda t: number_of(F.regexp_extract(t, "^[A-Z]+", 0))
    row = lambda t: F.regexp_extract(t, "[0-9]+$", 0).try_cast("long")
    ends = [(col(first), col(second)), (row(first), row(second))]
    fits = (F.greatest(*ends[0]) <= MAX_COLS) & (F.greatest(*ends[1]) <= MAX_ROWS)
    return F.when(ok & fits, F.struct(F.least(*ends[1]).alias("r1"), F.least(*ends[0]).alias("c1"), F.greatest(*ends[1]).alias("r2"), F.greatest(*ends[0]).alias("c2")))


def overlaps(a: DataFrame, b: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of ids whose boxes (id, r1, c1, r2, c2) share a cell; of one table each pair once. Boxes meet by
    buckets of rows; a pair counts in the bucket of the later start. Very high boxes are in many buckets, and so are
    as many rows."""
    deal = lambda t: t.select("id", "r1", "c1", "r2", "c2").withColumn("_b", F.explode(F.expr(f"sequence(r1 div {bucket}, r2 div {bucket})")))
    x, y = deal(a).alias("x"), deal(a if b is None else b).alias("y")
    meets = "x.r1 <= y.r2 and y.r1 <= x.r2 and x.c1 <= y.c2 and y.c1 <= x.c2"
    met = x.join(y, "_b").filter(f"{meets} and _b = greatest(x.r1, y.r1) div {bucket}" + (" and x.id < y.id" if b is None else ""))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def covered(boxes: DataFrame) -> DataFrame:
    """The cells (id, row, col) of each box, and whether a cell is the box's anchor or covered by it."""
    cells = boxes.select("id", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row"), "c2")
    cells = cells.select("id", "row", F.explode(F.sequence("c1", "c2")).alias("col"), "r1", "c1")
    return cells.select("id", "row", "col", ((F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).alias("anchor"))


def mark_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with merge (the id of the merge they lie in, or null) and anchor: an equi-join with the merges' cells."""
    inside = covered(merges).select(F.col("id").alias("merge"), F.col("row").alias("_r"), F.col("col").alias("_c"), "anchor")
    return cells.join(inside, (cells["row"] == inside["_r"]) & (cells["col"] == inside["_c"]), "left").drop("_r", "_c")
