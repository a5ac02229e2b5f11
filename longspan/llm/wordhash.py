"""64-bit hashes of the words of many texts at once, in numpy.

Words are the maximal runs of bytes other than blank and 0x09-0x0D, on the UTF-8 form; as those bytes never
occur inside a longer UTF-8 sequence, this is the same as cutting the characters.  A word's hash is a
polynomial of random byte weights, from one running sum over all bytes, then mixed.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WEIGHTS = np.random.Generator(np.random.PCG64(20_24)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHTS[_SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, kept for the worker's life."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all parts in order, where each part's words begin and end in them)."""
    joined = b" ".join([*parts, b""])
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    powers, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_WEIGHTS[raw] * powers[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return hashes, np.searchsorted(starts, bounds)
