"""Suffix order and the Burrows-Wheeler transform of blocks, by prefix doubling in numpy, and its inverse.

A suffix that is a prefix of another comes first.  The transform is that of the block with an end that is below every
byte; the end itself is left out, and its row kept as the index.  Memory is about 60 bytes a byte of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def suffix_array(data: bytes) -> np.ndarray:
    """Begins of the suffixes in order."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < max(n, 2):
        key = rank * (n + 258)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0) + 1
        if n == 0 or rank[order[-1]] == n:
            break
        step *= 2
    return order


def bwt(data: bytes) -> tuple[bytes, int]:
    """(the byte before each suffix, in suffix order, without the end; the row of the end)."""
    if not data:
        return b"", 0
    rows = np.concatenate([[len(data)], suffix_array(data)])
    raw = np.frombuffer(data, np.uint8)
    index = int(np.flatnonzero(rows == 0)[0])
    return raw[np.delete(rows, index) - 1].tobytes(), index


def unbwt(coded: bytes, index: int) -> bytes:
    """Undo ``bwt``."""
    n = len(coded)
    if not 0 <= index <= n:
        raise ValueError("the index is outside the block")
    if not n:
        return b""
    column = np.insert(np.frombuffer(coded, np.uint8).astype(np.int16), index, -1)
    first = np.sort(column, kind="stable")
    following = np.argsort(column, kind="stable").tolist()  # the row of the suffix that begins one place later
    out, row = bytearray(n), 0
    for i in range(n):
        row = following[row]
        out[i] = first[row]
    return bytes(out)


#: Blocks that Spark sends at once, and bytes of blocks that are Python objects at once.
ROWS, BYTES = 1000, 1 << 20


def _by_parts(df: DataFrame, make, schema) -> DataFrame:
    """``mapInArrow`` of ``make`` over parts of few bytes, whatever the task's share of the table."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield make(batch.slice(at, step))

    return df.mapInArrow(run, schema)


def bwt_rows(blocks: DataFrame, keys: tuple[str, ...] = ("archive_id", "chunk_no")) -> DataFrame:
    """``keys, bwt, bwt_index`` of each row's ``data``."""
    schema = blocks.select(*keys).schema.add("bwt", "binary").add("bwt_index", "long")

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [bwt(x.as_py() or b"") for x in batch.column(len(keys))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([x for x, _ in made], pa.binary()), pa.array([i for _, i in made], pa.int64())], [*keys, "bwt", "bwt_index"])

    return _by_parts(blocks.select(*keys, "data"), coded, schema)


def unbwt_rows(coded: DataFrame, keys: tuple[str, ...] = ("archive_id", "chunk_no")) -> DataFrame:
    """``keys, data``: undo ``bwt_rows``."""
    schema = coded.select(*keys).schema.add("data", "binary")

    def undone(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [unbwt(x.as_py() or b"", i.as_py()) for x, i in zip(*batch.columns[len(keys) :], strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(made, pa.binary())], [*keys, "data"])

    return _by_parts(coded.select(*keys, "bwt", "bwt_index"), undone, schema)


def suffix_rows(rows: DataFrame, key: str, data: str = "data") -> DataFrame:
    """``key, rank, pos`` of every suffix, both from 0."""
    schema = rows.select(key).schema.add("rank", "long").add("pos", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                order = suffix_array(batch.column(1)[i].as_py() or b"")
                own = pa.array([batch.column(0)[i].as_py()] * len(order), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(len(order))), pa.array(order)], [key, "rank", "pos"])

    return rows.select(key, data).mapInArrow(run, schema)
