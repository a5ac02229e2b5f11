"""Query op6: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .packing import pack, pieces


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is packed: a null or empty text is one end token, repeated rows once each.  An empty table gives an
    empty one; other columns are ignored."""
    return pack(pieces(read(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
