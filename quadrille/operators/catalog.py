"""Dictionaries of a workbook: shared strings, styles, authors, shared formulas, and the look-ups into them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.functions.refs import shift_formula

#: Ranges of positions by which first-seen ids are counted.
BLOCKS = 1024


def shared_strings(cells: DataFrame, value: str, position: str) -> DataFrame:
    """str, id (from 0, by first position) and refs of each distinct text.

    Ids are ranks within ranges of positions plus the counts of the ranges before, which are one row a range; so the
    distinct texts never meet in one task."""
    texts = cells.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("str")).agg(F.min(position).alias("_at"), F.count(F.lit(1)).alias("refs"))
    ends = texts.agg(F.min("_at").cast("double").alias("_lo"), F.max("_at").cast("double").alias("_hi"))
    share = F.try_divide(F.col("_at") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    dealt = texts.crossJoin(F.broadcast(ends)).withColumn("_b", F.floor(F.coalesce(share, F.lit(0.0)) * (BLOCKS - 1))).drop("_lo", "_hi")  # one row
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy("_at", "str")))
    return ranked.join(F.broadcast(before), "_b").select("str", (F.col("_before") + F.col("_k") - 1).alias("id"), "refs")


def look_up(cells: DataFrame, index: str, dictionary: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """cells with a dictionary's value; an index that is not there gives null."""
    small = dictionary.select(F.col(key).alias("_key"), F.col(value).alias(out))
    return cells.join(small, cells[index] == small["_key"], "left").drop("_key")


def distinct_styles(cells: DataFrame, columns: list[str], first_id: int = 0) -> DataFrame:
    """Each distinct combination with its id, in order of its columns, and its number of cells. A workbook has 64,000
    styles at most, so that many rows are numbered together."""
    groups = cells.groupBy(*columns).agg(F.count(F.lit(1)).alias("cells"))
    return groups.withColumn("id", (F.row_number().over(W.orderBy(*[F.col(c).asc_nulls_first() for c in columns])) - 1 + first_id).cast("long"))


def expand_shared(cells: DataFrame) -> DataFrame:
    """cells (sheet, row, col, formula, si, anchor) with the formulas of followers of a shared formula: their anchor's,
    moved to their place. Followers of one anchor at one distance share the text, which is made once."""
    anchors = cells.filter("si is not null and formula is not null").groupBy("sheet", "si").agg(F.min_by(F.struct("formula", "row", "col"), F.struct("row", "col")).alias("_a"))
    joined = cells.join(anchors, ["sheet", "si"], "left").withColumn("_dr", F.col("row") - F.col("_a.row")).withColumn("_dc", F.col("col") - F.col("_a.col"))

    @F.pandas_udf("string")
    def moved(f: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([shift_formula(x, int(y), int(z)) for x, y, z in zip(f, r, c)], index=f.index, dtype=object)

    needed = F.col("formula").isNull() & F.col("_a").isNotNull()
    texts = joined.filter(needed).select(F.col("_a.formula").alias("_f"), F.col("_dr").alias("_r"), F.col("_dc").alias("_c")).distinct().withColumn("_new", moved("_f", "_r", "_c"))
    out = joined.join(texts, (joined["_a.formula"] == texts["_f"]) & (joined["_dr"] == texts["_r"]) & (joined["_dc"] == texts["_c"]), "left")
    return out.withColumn("formula", F.coalesce("formula", "_new")).select(cells.columns)


def last_row(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or [])).agg(F.max("row").alias("last_row"))
