"""Query op9: language-model scores of all documents, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import fold, read
from .lm import fit, score


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored: null and empty texts as one end, repeated rows alike.  Without training rows every token
    is unknown; an empty table gives an empty one; other columns are ignored."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs.where(fold("doc_id", 5) != 1)))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1)


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
