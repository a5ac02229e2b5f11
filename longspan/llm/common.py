"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import materialise, shared_dir

__all__ = ["fold", "fold_of", "materialise", "over_batches", "read", "shared_dir", "slices", "tidy", "without"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def fold_of(doc_id: int | None, n: int) -> int:
    """``fold`` in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def _libc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives unused memory back to the system when its task ends.

    Workers live on for the next stage; without this each would keep the largest heap that any stage needed.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := _libc_trim()) is not None:
                trim(0)

    return wrapped


BATCH_BYTES = 32_000_000


def over_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = 1_000
) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once a task and returns the function of a batch.

    Batches are handed on ``rows`` rows at a time, fewer if they are long (``BATCH_BYTES`` on average), so that few texts
    are Python objects at once.  The session's ``arrow.maxRecordsPerBatch`` is set to the same, as executors hold two
    copies of what Spark sends at once, in the JVM beside its heap and in the worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield f(batch.slice(at, step))

    return df.mapInArrow(tidy(run), schema)


def slices(texts: list, rows: int = 512, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``rows`` entries and about ``size`` characters (one entry at least)."""
    start = total = 0
    for i, x in enumerate(texts):
        n = 0 if x is None else len(x)
        if i > start and (i - start >= rows or total + n > size):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not among ``ids``.

    The ids are written first, so that the join knows their size: it is a broadcast only below Spark's threshold.
    """
    gone = materialise(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), name)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
