"""Line dedup: drop the lines whose normalised form is found in many documents, using DataFrame functions only.

Lines are split at \\n; a line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. The keys of each
document are made distinct, hashed to 128 bits and counted with map-side combining; frequent keys are those of
``min_docs`` distinct doc_ids or more: the few keys of as many rows are looked up, and their documents made distinct
and counted. Documents then learn which of their own keys are frequent and rebuild their text by
position. The keys of a document travel as hashes, its text moves once. No group of lines is ever gathered: the
counts are sums, and the frequent keys are broadcast only when their counted number is small.

Defined cases: null and empty text are one empty line; an empty key is never dropped; rows that share
a doc_id count as one document, those without one as none; rows that share a doc_id, or have none, keep their own texts; extra columns pass
through, but those named like the new ones are replaced; an empty table gives none; a very long text is one row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import BLANKS, ascii_lower, materialise

#: Frequent keys that are broadcast at most: about 16 MB as a hash table.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _exploded(docs: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.transform(_lines(F.col("_text")), line_key))
    out = docs.select("_id", F.explode(keys).alias("_key")).filter(F.length("_key") > 0)
    return out.select("_id", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(7), F.col("_key")).alias("_g"))


def _shipped(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """docs with three more columns, named by names; columns of docs with these names are replaced."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    lines = _exploded(slim)
    rows = lines.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
    repeated = materialise(rows.filter(F.col("_n") >= min_docs).select("_h", "_g"), "repeated-lines")
    hits = materialise(lines.join(_shipped(repeated), ["_h", "_g"], "left_semi").select("_id", "_h", "_g"), "line-hits")
    counted = hits.filter(F.col("_id").isNotNull()).distinct().groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
    frequent = materialise(counted.filter(F.col("_n") >= min_docs).select("_h", "_g"), "frequent-lines")
    per_doc = hits.join(_shipped(frequent), ["_h", "_g"], "left_semi").groupBy("_id").agg(F.collect_set("_h").alias("_drop")).withColumnRenamed("_id", "_of")
    # per_doc grows with the corpus, so it is never broadcast
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    whole = docs.select(F.struct(*rest).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    joined = whole.join(per_doc.hint("merge"), F.col("_id").eqNullSafe(F.col("_of")), "left").withColumn("_lines", _lines(F.col("_text")))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~((F.length(line_key(x)) > 0) & F.array_contains(F.col("_drop"), F.xxhash64(line_key(x)))))
    )
    joined = joined.withColumn("_kept", kept)
    return joined.select(
        "_row.*",
        F.array_join("_kept", "\n").alias(names[0]),
        F.size("_lines").cast("long").alias(names[1]),
        (F.size("_lines") - F.size("_kept")).cast("long").alias(names[2]),
    )
