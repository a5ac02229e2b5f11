"""Ratios, percentages and rankings over tokens, blocks and timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bits_per_byte, mb_per_second, percentage, ratio


def token_counters(stats: DataFrame, *keys: str) -> DataFrame:
    """Counters of ``parse.parse_stats`` summed, with the ratio (1 + match bytes) / literal bytes."""
    names = ("chunk_size", "literals", "literal_bytes", "matches", "match_bytes", "inserts", "tag_hits", "tag_misses")
    total = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return total.withColumn("match_ratio", F.when(F.col("literal_bytes") > 0, (1.0 + F.col("match_bytes")) / F.col("literal_bytes")))


def archive_summary(blocks: DataFrame) -> DataFrame:
    """Per archive: chunks, blocks, sizes in and out of the codec, the first block type, and the stage percentages."""
    used = F.col("u_len") > 0
    place = F.struct("stream_no", "block_no", "c_type")
    chunks = blocks.where("error IS NULL").groupBy("archive_id", "chunk_no").agg(
        F.max("chunk_size").alias("original"),
        F.sum(F.when(used, F.col("u_len"))).alias("u_total"),
        F.sum(F.when(used, F.col("c_len"))).alias("c_total"),
        F.count_if(used).alias("n_blocks"),
        F.min(F.when(used, place)).alias("first"),
    )
    both = chunks.groupBy("archive_id").agg(
        F.sum("original").alias("original"),
        F.count(F.lit(1)).alias("n_chunks"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("u_total", "c_total", "n_blocks")],
        F.min(F.when(F.col("first").isNotNull(), F.struct("chunk_no", F.col("first.c_type").alias("c_type"))))["c_type"].alias("first_type"),
    )
    return both.select(
        "archive_id",
        "n_chunks",
        "n_blocks",
        "original",
        "u_total",
        "c_total",
        "first_type",
        percentage(F.col("u_total"), F.col("original")).alias("pct_tokens"),
        percentage(F.col("c_total"), F.col("u_total")).alias("pct_codec"),
        percentage(F.col("c_total"), F.col("original")).alias("pct_all"),
        ratio(F.col("original"), F.col("c_total")).alias("ratio"),
        bits_per_byte(F.col("original"), F.col("c_total")).alias("bits_per_byte"),
    )


def validated(blocks: DataFrame) -> DataFrame:
    """``archive_id, damaged, misordered``: per archive, errors in its index and blocks out of order, from one pass over the index."""
    index = blocks.select("archive_id", "chunk_no", "stream_no", "block_no", "next_head", "error").repartition("archive_id")
    before = F.lag("next_head").over(Window.partitionBy("archive_id", "chunk_no", "stream_no").orderBy("block_no"))
    marked = index.withColumn("wrong", F.col("error").isNull() & (F.col("next_head") != 0) & (F.col("next_head") <= before))
    return marked.groupBy("archive_id").agg(F.count("error").alias("damaged"), F.count_if("wrong").alias("misordered"))


def misordered(blocks: DataFrame) -> DataFrame:
    """Blocks whose link does not point past the link before it in their stream."""
    w = Window.partitionBy("archive_id", "chunk_no", "stream_no").orderBy("block_no")
    return blocks.withColumn("before", F.lag("next_head").over(w)).where("next_head <> 0 AND before IS NOT NULL AND next_head <= before").drop("before")


def speed_rows(runs: DataFrame) -> DataFrame:
    """Timed runs (method, level, input_size, packed_size, pack_s, unpack_s) with ratio, bits per byte and MB/s.

    Unpacking speed is told by the packed size, as usual in such tables, and by the original size.
    """
    return runs.select(
        "*",
        ratio(F.col("input_size"), F.col("packed_size")).alias("ratio"),
        bits_per_byte(F.col("input_size"), F.col("packed_size")).alias("bits_per_byte"),
        mb_per_second(F.col("input_size"), F.col("pack_s")).alias("pack_mb_s"),
        mb_per_second(F.col("packed_size"), F.col("unpack_s")).alias("unpack_mb_s"),
        mb_per_second(F.col("input_size"), F.col("unpack_s")).alias("unpack_original_mb_s"),
    )


def ranked(runs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Size and time as percentages of the largest of the group, their mean, and the rank by it.

    Rankings compare a handful of methods, so a window without a key (``group`` None) is one small task.
    """
    keys = group or [F.lit(1)]
    w = Window.partitionBy(*keys)
    indexed = runs.withColumn("size_index", F.col("packed_size") * 100.0 / F.max("packed_size").over(w)).withColumn("time_index", F.col("pack_s") * 100.0 / F.max("pack_s").over(w))
    overall = indexed.withColumn("overall_index", (F.col("size_index") + F.col("time_index")) / 2)
    return overall.withColumn("rank", F.rank().over(w.orderBy("overall_index")))
