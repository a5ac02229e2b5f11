"""Query op10: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .decontam import find_items


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each text and item found in it, the best region; null and empty texts and items match nothing,
    repeated rows are reported each.  Empty tables give an empty one; other columns are ignored."""
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
