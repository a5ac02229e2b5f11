"""Values at the bytes of each text: rolling tags, delta coding and distances between equal bytes, in numpy.

Every row is a text of its own.  A text goes through its kernel in pieces with the few bytes of context that it needs, so a
long one takes no more memory than a short one, and nothing is shuffled.  Texts that are null or too short give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import SPAN, rolling_tags
from .filters import apply_filter

PIECE, ROWS, DISTANCE, FARTHEST = 1 << 20, 1 << 16, 4, 4096
Pieces = Iterator[tuple[np.ndarray, np.ndarray]]


def tag_pieces(data: memoryview, bits: int = 0) -> Pieces:
    """(places, tags) of the places with ``SPAN`` bytes whose tag has ``bits`` low ones."""
    low = (1 << bits) - 1
    for at in range(0, len(data) - SPAN + 1, PIECE):
        tags = rolling_tags(data[at : at + PIECE + SPAN - 1])
        kept = np.flatnonzero((tags & low) == low) if bits else np.arange(len(tags))
        yield kept + at, tags[kept] if bits else tags


def delta_pieces(data: memoryview) -> Iterator[bytes]:
    """The bytes less those ``DISTANCE`` before them."""
    for at in range(0, len(data), PIECE):
        lead = min(at, DISTANCE)
        yield apply_filter("delta", bytes(data[at - lead : at + PIECE]), DISTANCE)[lead:]


def undelta_pieces(coded: Iterator[bytes]) -> Iterator[bytes]:
    """Undo ``delta_pieces``: the last bytes of a piece stand before the next one as they would code themselves."""
    carry = b""
    for part in coded:
        whole = apply_filter("delta", carry + part, DISTANCE, back=True)
        yield whole[len(carry) :]
        carry = whole[-DISTANCE:]


def _placed(parts: Iterator[bytes]) -> Pieces:
    at = 0
    for part in parts:
        yield np.arange(at, at + len(part)), np.frombuffer(part, np.uint8)
        at += len(part)


def gap_counts(data: memoryview, counts: np.ndarray) -> None:
    """Adds how often each distance below ``len(counts)`` lies between a byte and the next equal one."""
    byte, last = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    for at in range(0, len(data), PIECE):
        part = np.frombuffer(data[at : at + PIECE], np.uint8)
        byte, places = np.concatenate([byte, part]), np.concatenate([last, np.arange(at, at + len(part))])
        order = np.argsort(byte, kind="stable")
        byte, places = byte[order], places[order]
        same = byte[1:] == byte[:-1]
        gaps = np.diff(places)[same]
        counts += np.bincount(gaps[gaps < len(counts)], minlength=len(counts))
        ends = np.append(~same, True) if len(byte) else same
        byte, last = byte[ends], places[ends]


def _map(texts: DataFrame, key: str, data: str, schema: str, run) -> DataFrame:
    """``run`` over batches of keys and memory views of the texts that have bytes."""
    kinds = f"{key} {texts.schema[key].dataType.simpleString()}, {schema}"

    def views(batch: pa.RecordBatch) -> Iterator[tuple[int, memoryview]]:
        for i, x in enumerate(batch.column(1)):
            if x.is_valid and len(view := memoryview(x.as_buffer()).cast("B")):
                yield i, view

    return texts.select(key, data).mapInArrow(lambda batches: run((b.column(0), views(b)) for b in batches), kinds)


def _rows(texts: DataFrame, key: str, data: str, column: str, kind: str, pieces: Callable[[memoryview], Pieces]) -> DataFrame:
    """``key, pos, column``: a row for each place that ``pieces`` gives."""
    names, to = [key, "pos", column], {"bigint": pa.int64(), "int": pa.int32()}[kind]

    def made(keys: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        own = np.repeat([i for i, _, _ in held], [len(p) for _, p, _ in held])
        pos, values = np.concatenate([p for _, p, _ in held]), np.concatenate([v for _, _, v in held])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(pos), pa.array(values.astype(to.to_pandas_dtype()))], names)

    def run(batches):
        for keys, views in batches:
            held, size = [], 0
            for i, view in views:
                for pos, values in pieces(view):
                    for a in range(0, len(pos), ROWS):
                        held.append((i, pos[a : a + ROWS], values[a : a + ROWS]))
                        size += len(held[-1][1])
                        if size >= ROWS:
                            yield made(keys, held)
                            held, size = [], 0
            if size:
                yield made(keys, held)

    return _map(texts, key, data, f"pos bigint, {column} {kind}", run)


def _summed(texts: DataFrame, key: str, data: str, schema: str, rows_of: Callable[[memoryview], list[tuple]]) -> DataFrame:
    """``key`` and the columns of ``schema``: the rows that ``rows_of`` makes of a whole text."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches):
        for keys, views in batches:
            found = [(i, r) for i, view in views for r in rows_of(view)]
            if found:
                columns = zip(*(r for _, r in found), strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _ in found])), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *names])

    return _map(texts, key, data, schema, run)


def tag_rows(texts: DataFrame, key: str, data: str = "data", bits: int = 0) -> DataFrame:
    """``key, pos, tag`` of the places whose tag has ``bits`` low ones."""
    return _rows(texts, key, data, "tag", "bigint", lambda x: tag_pieces(x, bits))


def tag_sets(texts: DataFrame, key: str, data: str = "data", places: int = 256) -> DataFrame:
    """``key, total, first_places``: different tags of a text, and different remainders of them by ``places``."""

    def rows(x: memoryview) -> list[tuple]:
        found = np.zeros(0, np.int32)
        for _, tags in tag_pieces(x):
            found = np.sort(np.concatenate([found, tags.astype(np.int32)]))  # several times faster than np.unique
            found = found[np.append(True, found[1:] != found[:-1])]
        return [(len(found), int(np.count_nonzero(np.bincount(found & places - 1))))] if len(found) else []

    return _summed(texts, key, data, "total bigint, first_places bigint", rows)


def tag_density(texts: DataFrame, key: str, data: str = "data", bits: tuple[int, ...] = (1, 2, 4, 6)) -> DataFrame:
    """``key, bits, places, anchors``: places of a text with a tag, and how many of the tags have as many low ones."""

    def rows(x: memoryview) -> list[tuple]:
        anchors, places = dict.fromkeys(bits, 0), 0
        for pos, tags in tag_pieces(x):
            places += len(pos)
            for n in bits:
                low = (1 << n) - 1
                anchors[n] += int(np.count_nonzero((tags & low) == low))
        return [(n, places, anchors[n]) for n in bits] if places else []

    return _summed(texts, key, data, "bits int, places bigint, anchors bigint", rows)


def delta_rows(texts: DataFrame, key: str, data: str = "data") -> DataFrame:
    """``key, pos, coded``."""
    return _rows(texts, key, data, "coded", "int", lambda x: _placed(delta_pieces(x)))


def undelta_rows(texts: DataFrame, key: str, data: str = "data") -> DataFrame:
    """``key, pos, decoded``: coded and undone."""
    return _rows(texts, key, data, "decoded", "int", lambda x: _placed(undelta_pieces(delta_pieces(x))))


def delta_returns(texts: DataFrame, key: str, data: str = "data") -> DataFrame:
    """``key, n_bytes, same``: whether all bytes of a text come back from their coded form."""

    def rows(x: memoryview) -> list[tuple]:
        at, same = 0, True
        for part in undelta_pieces(delta_pieces(x)):
            same &= part == x[at : at + len(part)]
            at += len(part)
        return [(at, same and at == len(x))]

    return _summed(texts, key, data, "n_bytes bigint, same boolean", rows)


def byte_gaps(texts: DataFrame, key: str, data: str = "data", below: int = FARTHEST) -> DataFrame:
    """``gap, n``: distances below ``below`` between a byte and the next equal one, counted by task before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(below, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    gap_counts(memoryview(x.as_buffer()).cast("B"), counts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["gap", "n"])

    return texts.select(data).mapInArrow(run, "gap bigint, n bigint").groupBy("gap").agg(F.sum("n").alias("n"))
