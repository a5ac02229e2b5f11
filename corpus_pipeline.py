"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage works on all that the one before kept, written as Parquet and read again in between.  All stages but the last
return the columns of their input, further ones and clashing names included, and an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longspan.llm import language, lines
from longspan.llm.common import materialise, read, without
from longspan.llm.decontam import find_items
from longspan.llm.neardup import near_duplicates
from longspan.llm.packing import pack, pieces
from longspan.llm.q_packing import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language learned from their own labels; those without a letter or a clear language go.

    Null and empty texts go; a null ``lang`` is filled in; rows of one id are judged each by its text, copies alike; rows without
    an id stay if their text does.  Without any label all documents go.
    """
    return language.keep_known(docs, language.fit(language.training_sample(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source.

    Every row stays, also with a null, empty or emptied text; rows of a null source count as one source; repeated rows
    count once each.
    """
    return lines.clean_documents(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (five-word shingles, 0.8).

    Null and empty texts and rows without an id are linked with nothing and stay; of rows that repeat an id all stay or
    go.
    """
    found = near_duplicates(docs, words=5, num=80, den=100)
    return without(docs, found.where("NOT kept"), "duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and items match nothing, so these documents stay, as do rows without an id; rows of one id go
    together.
    """
    return without(docs, find_items(docs, read(spark, sf_dir, "benchmark")), "contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 4096 tokens.

    A null or empty text is one end token; repeated rows are packed each; the columns are those of the packing.
    """
    return pack(pieces(docs, tokenizer_path(), cache_words=50_000, batch_chars=2_000_000))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
