"""Hashes of all grams of a text, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(text: str, width: int) -> np.ndarray:
    """Two steps of doubling put a window's hash together from those of powers of two."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        part, size, out, done, left = (codes + np.uint64(11)) * M1, 1, None, 0, width
        while left:
            if left & 1:
                out = part[:n] if out is None else (out ^ (out >> np.uint64(29))) * M2 + part[done : done + n]
                done += size
            left >>= 1
            if left:
                part = (part[:-size] ^ (part[:-size] >> np.uint64(31))) * M1 + part[size:]
                size *= 2
        out = (out ^ (out >> np.uint64(32))) * M1
    return (out ^ (out >> np.uint64(30))).view(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("CAST(doc_id AS bigint) doc_id", "text")
