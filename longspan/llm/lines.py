"""Line de-duplication by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line's ratio is the share of the host's pages that hold it.  Lines whose ratio
exceeds ``max_ratio`` and which at least ``min_pages`` pages of the host hold are boilerplate and go from every
page of that host.  Lines count once a page.  Only 64-bit hashes of lines are shuffled, summed map-side first,
so a host with a third of all pages costs no more than its distinct lines.  A host's boilerplate list is
bounded (lines a page / ``max_ratio``); the lists are written out, and Spark broadcasts them only if that
table is under its own threshold, else it joins by host with skew splitting.

Defined results: blank lines are never boilerplate; a null text stays null with no lines; an empty text has one
(blank) line; a null host is a host of its own; repeated rows are pages of their own; an empty table gives an
empty one; the result has only the columns named below, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_RATIO, MIN_PAGES = 0.025, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, keys``: the hashes of each host's boilerplate lines.  ``pages`` has host and text."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).withColumnRenamed("host", "total_host")
    held = (
        pages.where("text IS NOT NULL")
        .select("host", F.explode(_keys(F.col("text"))).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n_held"))
        .where(F.col("n_held") >= min_pages)
    )
    often = held.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).where(F.col("n_held") > max_ratio * F.col("n_pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``doc_id, host, text, n_lines, n_removed`` with boilerplate lines taken out."""
    return _cleaned(docs.select("doc_id", F.col(host).alias("host"), "text"), max_ratio, min_pages).drop("kept", "hit", "keys")


def clean_documents(
    docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, its other columns as they are but for ``n_chars``."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), "text")
    cleaned = _cleaned(row, max_ratio, min_pages)
    own = [F.col("text") if c == "text" else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return cleaned.select(*own)


def _cleaned(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    found = materialise(boilerplate(pages.select("host", "text"), max_ratio, min_pages), "boilerplate").withColumnRenamed("host", "found_host")
    joined = pages.join(found, F.col("host").eqNullSafe(F.col("found_host")), "left").drop("found_host")
    none = F.array().cast("array<bigint>")
    marked = joined.withColumn("hit", F.when(F.col("keys").isNull(), none).otherwise(F.array_intersect(_keys(F.col("text")), "keys")))
    lines = _lines(F.col("text"))
    kept = F.when(F.size("hit") <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("hit", F.xxhash64(x))))
    size = lambda x: F.when(F.col("text").isNull(), 0).otherwise(x).cast("bigint")
    return (
        marked.withColumn("kept", kept)
        .withColumn("n_lines", size(F.size(lines)))
        .withColumn("n_removed", size(F.size(lines) - F.size("kept")))
        .withColumn("text", F.array_join("kept", "\n"))
    )
