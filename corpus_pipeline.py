"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import materialise

#: A stage on words shingles and similarity cannot be put in SQL, nor a trained classifier.
ORACLE_SQL = None


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has."""
    out = []
    for name in names:
        while name in docs.columns:
            name = f"_{name}"
        out.append(name)
    return out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; those without text or doc_id stay, and all if nothing can be learned."""
    from quadrille.llm.toxicity import score_documents, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    return score_documents(docs, model, keep_below=0.3) if model.weights else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines found in 10 documents or more; n_chars follows."""
    from quadrille.llm.line_dedup import dedup_lines

    kept, n_lines, n_dropped = _fresh(docs, "kept", "n_lines", "n_dropped")
    out = dedup_lines(docs, names=(kept, n_lines, n_dropped)).withColumn("text", F.when(F.col("text").isNotNull(), F.col(kept)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    from quadrille.llm.ngram_join import near_groups

    groups = near_groups(docs).select(F.col("doc_id").alias("_of"), "component_id").filter("component_id <> _of").select("_of").distinct()
    return docs.join(groups, docs["doc_id"] == groups["_of"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    from quadrille.llm.decontaminate import find_leaks

    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_of")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["_of"], "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row; null texts have no tokens, repeated rows are encoded each."""
    import public_tokenizers

    from quadrille.llm.bpe import encode_documents

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that the one before kept. An empty table of documents gives no rows; extra
    columns go with their rows up to the last stage, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
