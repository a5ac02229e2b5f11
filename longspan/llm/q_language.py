"""Query op4: language of all documents, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import fold, read
from .language import fit, predict, training_sample


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is judged: a null text or one without a letter is `und` with score 0, repeated rows alike, ties go
    to the language first in order.  An empty table gives an empty one; other columns are ignored."""
    docs = read(spark, sf_dir, "documents")
    model = fit(training_sample(docs.where(fold("doc_id", 4) != 2)))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
