"""Query op7: PNG media columns over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .media import encode_media, media_features


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is stored and read back: a null text as an empty one, equal texts alike.  An empty table gives an
    empty one; other columns are ignored."""
    return media_features(encode_media(read(spark, sf_dir, "documents")))


QUERIES = {"op7_media_columns": op7_media_columns}
