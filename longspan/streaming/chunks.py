"""Chunks of a stream of files or rows, with running totals, as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import cut
from ..sources.files import as_files
from ..sources.shared import shared_dir


def chunk_stream(rows: DataFrame, size: int) -> DataFrame:
    """Streaming (archive_id, data) to chunk rows with checksum; stateless, so it restarts from its offsets alone."""
    return cut(rows, size).select("archive_id", "chunk_no", "offset", "chunk_size", "chunk_bytes", "eof", F.md5("data").alias("digest"))


def run_chunks(spark: SparkSession, path: str, size: int, files_per_batch: int = 1) -> DataFrame:
    """Read a folder of Parquet documents as a stream, write its chunks as micro-batches, return what was written."""
    schema = spark.read.parquet(path).schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    head, dot, tail = path.rpartition(".")
    pattern = f"{head}[.]{tail}" if dot else path  # a pattern, so that a single file is taken as well as a folder
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    chunks = chunk_stream(as_files(source), size)
    query = chunks.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(chunks.schema).parquet(f"{out}/rows")


def running_totals(chunks: DataFrame, watermark_column: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Per archive: chunks, bytes and whether the end was seen; digests are put together in batch afterwards."""
    kept = chunks.withWatermark(watermark_column, delay) if watermark_column else chunks
    return kept.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_size").alias("n_bytes"), F.max("eof").alias("ended"))
