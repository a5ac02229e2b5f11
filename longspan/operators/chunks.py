"""Cutting inputs into chunks and blocks, and block-level duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import byte_width
from ..sources.shared import materialise


def cut(files: DataFrame, size: int, key: str = "archive_id", data: str = "data", also: tuple[str, ...] = ()) -> DataFrame:
    """``archive_id, chunk_no, offset, chunk_size, chunk_bytes, eof, data`` and the columns ``also``; an empty input is one empty chunk."""
    length = F.octet_length(data)
    last = F.greatest(F.floor((length - 1) / size), F.lit(0)).cast("int")
    rows = files.where(F.col(data).isNotNull()).select(
        F.col(key).cast("string").alias("archive_id"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"), last.alias("_last"), F.col(data).cast("binary").alias("_data"), *also
    )
    part = F.substring("_data", F.col("chunk_no") * size + 1, F.lit(size))
    cut_rows = rows.select("archive_id", "chunk_no", (F.col("chunk_no").cast("bigint") * size).alias("offset"), (F.col("chunk_no") == F.col("_last")).alias("eof"), part.alias("data"), *also)
    return cut_rows.select(
        "archive_id", "chunk_no", "offset", F.octet_length("data").cast("bigint").alias("chunk_size"), byte_width(F.octet_length("data")).alias("chunk_bytes"), "eof", "data", *also
    )


def blocks_of_streams(streams: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of stream rows (archive_id, chunk_no, stream_no, data)."""
    last = F.greatest(F.floor((F.octet_length("data") - 1) / block_bytes), F.lit(0)).cast("int")
    rows = streams.select("archive_id", "chunk_no", "stream_no", F.explode(F.sequence(F.lit(0), last)).alias("block_no"), "data")
    return rows.withColumn("data", F.substring("data", F.col("block_no") * block_bytes + 1, F.lit(block_bytes)))


def numbered_copies(blocks: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """Each block with its digest, how many blocks share it, and its place among them.

    Only digests and places are shuffled.  Blocks are dealt out by ranges of digest and place, so that a digest that a
    third of all blocks share spreads over many tasks; each task numbers its own, and what stands before is added
    from counts by task and digest, which are few.
    """
    rows = blocks.select(*order, F.octet_length("data").alias("u_len"), digest.alias("digest"))
    dealt = materialise(rows.repartitionByRange("digest", *order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("here"))
    w = Window.partitionBy("digest")
    before = F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    counts = counts.select("digest", "part", F.sum("here").over(w).alias("copies"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("digest", "part").orderBy(*order))
    numbered = dealt.withColumn("own", own).join(counts, ["digest", "part"])
    return numbered.select(*order, "u_len", "digest", "copies", (F.col("own") + F.col("before")).cast("int").alias("copy_no"))


def first_seen(blocks: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """``digest``, the least place it is at, and its copies: summed map-side, so hot digests don't matter."""
    rows = blocks.select(F.struct(*order).alias("place"), F.octet_length("data").cast("bigint").alias("u_len"), digest.alias("digest"))
    found = rows.groupBy("digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.min("u_len").alias("u_len"))
    return found.select("digest", "place.*", "copies", "u_len")
