"""Sharding: proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the fractional rank (rank + 1/2) / rows of the
source puts all sources on one scale, and equal cuts of that order give every shard the corpus mixture. Ranks are
built from counts of hash buckets: the bucket counts are summed up in a small table, and only the rows of one bucket
are ever ranked together, so a source with a third of all rows is split like the others.

Law: rows (counts differ by one at most). Defined cases: null text has no bytes (size 1, crc 0); a null source is a
source of its own; null doc_ids hash as an empty string; identical rows are interchangeable; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that are ranked together on average.
BUCKET_ROWS = 20_000


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list, out: str, total: str | None) -> DataFrame:
    """Adds the rank from 0 of each row among the rows of its group, ordered by bucket and then order."""
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_c"))
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(over.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    if total:
        counts = counts.withColumn(total, F.sum("_c").over(over))
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, bucket])], "_before", *([total] if total else []))
    on = None
    for i, c in enumerate([*group, bucket]):
        cond = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = cond if on is None else on & cond
    rank = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order))
    joined = df.withColumn("_rn", rank).join(counts, on, "left")
    return joined.withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_rn", "_before", *[f"_k{i}" for i in range(len(group) + 1)])


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard and slot of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.col(f"`{source_col}`").alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_m"),
    )
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    head = F.conv(F.substring("_m", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_b", F.shiftright(head * F.lit(buckets), 32))
    order = ["_m", "doc_id", "text_crc32", "size"]
    rows = _ranked(rows, ["source"], "_b", order, "_r", "_n")
    rows = rows.withColumn("_f", (F.col("_r") + 0.5) / F.col("_n"))
    rows = rows.withColumn("_fb", F.floor(F.col("_f") * buckets).cast("long"))
    rows = _ranked(rows, [], "_fb", ["_f", F.col("source").asc_nulls_first(), *order], "_pos", None)
    shard = F.expr(f"(_pos * {shards}) div {max(n, 1)}")
    first = F.expr(f"((_pos * {shards}) div {max(n, 1)} * {n} + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"), (F.col("_pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
