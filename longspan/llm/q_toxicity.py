"""Query op1: toxicity of all documents, learned from the labels outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read
from .toxicity import fit, labelled_sample, score


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored: null and empty texts by the score of no evidence, repeated rows alike, rows without an id
    in no held-out fold but that of the empty string.  An empty table gives an empty one; other columns are
    ignored."""
    docs = read(spark, sf_dir, "documents")
    train = docs.where(fold("doc_id", 4) != 2)
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    scored = score(docs, fit(labelled_sample(train, labels)))
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "evidence",
        F.size("passages").alias("n_passages"),
    )


QUERIES = {"op1_toxicity": op1_toxicity}
