"""Relational view of repeated text: maximal nearest-earlier matches and coverage by 31-grams, and matches of two tables.

The hash of every 31-character gram is made in numpy, a text at a time, no string per place.  Coverage asks only whether a
gram stands earlier anywhere, runs ask for the nearest earlier place; both are found by ``stretches``.
This is the analytic view, not the greedy token sequence of ``parse``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import stretches
from .grams import gram_hashes, texts_of

GRAM = 31


def gram_rows(docs: DataFrame, width: int = GRAM, wanted=None) -> DataFrame:
    """``doc_id, pos, gram, fresh`` (pos from 1) of every place with ``width`` characters; ``fresh`` at a text's
    first place of the gram.  ``wanted``, a broadcast bitmap of gram hashes, leaves out grams that it doesn't hold."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        key, pos, gram, fresh = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(pos, pa.int64()), pa.array(gram), pa.array(fresh)], ["doc_id", "pos", "gram", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            held, size = [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = gram_hashes(text.as_py() or "", width)
                at = np.arange(len(grams)) if keep is None else np.flatnonzero(keep[_slot(grams, len(keep))])
                grams = grams[at]
                fresh = np.zeros(len(grams), bool)
                fresh[np.unique(grams, return_index=True)[1]] = True
                held.append((np.full(len(grams), key.as_py()), at + 1, grams, fresh))
                size += len(grams)
                if size > 500_000:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return texts_of(docs).mapInArrow(run, "doc_id bigint, pos bigint, gram bigint, fresh boolean")


def _slot(grams: np.ndarray, size: int) -> np.ndarray:
    return (grams.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)


BITMAP = 1 << 25


def bitmap_of(grams: DataFrame) -> np.ndarray | None:
    """Which hash remainders the distinct ``gram`` values have, 32 MB at most; None if so many that it would keep all."""
    n = grams.count()
    if n > BITMAP // 4:
        return None
    out = np.zeros(min(BITMAP, 1 << max(10, (16 * n).bit_length())), bool)
    size = len(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).to_numpy(), size)))], ["slot"])

    for part in grams.select("gram").mapInArrow(run, "slot bigint").toArrow().column("slot").chunks:
        out[part.to_numpy()] = True
    return out


def coverage(docs: DataFrame, width: int = GRAM) -> DataFrame:
    """``doc_id, covered_chars``: characters under some gram with an earlier copy; texts without any are left out."""
    return stretches.coverage(docs, width)


def match_runs(docs: DataFrame, width: int = GRAM) -> DataFrame:
    """Maximal runs against the nearest earlier copy: ``doc_id, pos, source_doc, source_pos, length``."""
    return stretches.match_runs(docs, width)


def anchor_matches(left: DataFrame, right: DataFrame, width: int = GRAM, bits: int = 3) -> DataFrame:
    """Matches between two tables over sampled grams (those whose hash has ``bits`` low zeros, in both alike).

    ``doc_id, source_doc, anchors``: how many sampled grams of each pair agree.  Grams of both sides are distinct per
    text before the join, the sampling is by content, so both sides keep the same grams, and the left side's grams that
    the right side can't have never become rows (unless the right side has more than 8 million).
    """
    low = F.col("gram").bitwiseAND((1 << bits) - 1) == 0
    sources = gram_rows(right, width).where(low).select(F.col("doc_id").alias("source_doc"), "gram").distinct()
    sources = materialise(sources, "sources")
    bitmap = bitmap_of(sources.select("gram").distinct())
    wanted = None if bitmap is None else left.sparkSession.sparkContext.broadcast(bitmap)
    sampled = gram_rows(left, width, wanted).where(low & F.col("fresh")).select("doc_id", "gram")
    return sampled.join(sources, "gram").groupBy("doc_id", "source_doc").agg(F.count(F.lit(1)).alias("anchors"))
