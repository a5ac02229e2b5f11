"""Chunks to literal and back-reference tokens, and back.

The parse is sequential inside a chunk and chunks are independent, so a chunk is a row and the kernel runs in an
Arrow map; nothing is shuffled.  A kernel looks at sampled places only (those whose rolling tag has the level's
low bits set), found with numpy for the whole chunk at once; candidates are extended by comparing slices.

Tokens are (kind, out_pos, length, distance), kind 0 literal, 1 match; their wire form splits runs at 65,535.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tags import rolling_tags
from ..options import GREAT_MATCH, LONGEST_TOKEN, MATCH_LEVELS, MINIMUM_MATCH


def _common(data: memoryview, a: int, b: int, limit: int) -> int:
    """Length of the common run of data[a:] and data[b:], at most ``limit``: whole slices, then the first bit that differs."""
    n = 0
    step = 64
    while n < limit:
        step = min(step, limit - n)
        x, y = data[a + n : a + n + step], data[b + n : b + n + step]
        if x == y:
            n += step
            step *= 2
        elif step > 1024:
            step //= 2
        else:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((differ & -differ).bit_length() - 1 >> 3)
    return n


def _common_back(data: memoryview, a: int, b: int, limit: int) -> int:
    """Length of the common run that ends before data[a] and data[b], at most ``limit``."""
    n = 0
    while n < limit:
        step = min(32, limit - n)
        differ = int.from_bytes(data[a - n - step : a - n], "little") ^ int.from_bytes(data[b - n - step : b - n], "little")
        if differ:
            return n + step - 1 - (differ.bit_length() - 1 >> 3)
        n += step
    return n


def _gram_hashes(data: bytes) -> np.ndarray:
    """An order-sensitive 64-bit hash of the ``MINIMUM_MATCH`` bytes from each place on, by doubling."""
    n = len(data) - MINIMUM_MATCH + 1
    part = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, done, size, left = None, 0, 1, MINIMUM_MATCH
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = part[:n].copy() if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part[done : done + n]
                done += size
            left >>= 1
            if left:
                part = (part[:-size] ^ (part[:-size] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + part[size:]
                size *= 2
    return out


class Parser:
    """Greedy parse of one chunk at a level; ``stats`` tells what the sampled places met.

    Instead of filling a table byte by byte, the sampled places are sorted once by the hash of their bytes, which
    links each to the nearest earlier place with the same bytes.  The scan then visits only places with a link and
    jumps over what a match covers; a place follows as many links as the level keeps equal anchors.
    """

    def __init__(self, level: int = 7):
        _, self.bits, self.keep = MATCH_LEVELS[level]

    def _linked(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(sampled places, index of the nearest earlier place with the same bytes or -1)."""
        tags = rolling_tags(data)
        low = (1 << self.bits) - 1
        places = np.flatnonzero((tags & low) == low)
        places = places[(places > 0) & (places <= len(data) - MINIMUM_MATCH)]
        link = np.full(len(places), -1)
        if len(places):
            grams = _gram_hashes(data)[places]
            order = np.argsort(grams, kind="stable")
            same = grams[order[1:]] == grams[order[:-1]]
            link[order[1:][same]] = order[:-1][same]
            seen = np.ones(len(places), bool)
            seen[np.unique(tags[places], return_index=True)[1]] = False
            self.stats["tag_misses"] = int((seen & (link < 0)).sum())
        return places, link

    def tokens(self, data: bytes) -> list[tuple[int, int, int, int]]:
        self.stats = dict.fromkeys(("inserts", "probes", "tag_hits", "tag_misses"), 0)
        out: list[tuple[int, int, int, int]] = []
        n = len(data)
        end = n - MINIMUM_MATCH
        view = memoryview(data)
        sampled, links = self._linked(data)
        self.stats["inserts"] = len(sampled)
        places, link = sampled.tolist(), links.tolist()
        visit = np.flatnonzero(links >= 0)
        at_visit, visit = sampled[visit].tolist(), visit.tolist()
        last = i = 0
        best_at = best_from = best_len = 0

        def emit() -> None:
            nonlocal last, best_len
            if last < best_at:
                out.append((0, last, best_at - last, 0))
            out.append((1, best_at, best_len, best_at - best_from))
            last, best_len = best_at + best_len, 0

        while i < len(visit):
            p = at_visit[i]
            if best_len and p > best_at + MINIMUM_MATCH:
                # a sampled place without a link, between there and here, would have closed the pending match
                s = bisect_left(places, best_at + MINIMUM_MATCH)
                if places[s] < p:
                    emit()
            if last and p <= last:
                i = bisect_right(at_visit, last, i)
                continue
            self.stats["probes"] += 1
            j, found, source, reach = link[visit[i]], 0, 0, 0
            for _ in range(self.keep):
                if j < 0:
                    break
                q = places[j]
                ahead = _common(view, q, p, end - p)
                back = _common_back(view, q, p, min(q, p - last)) if ahead or p == end else 0
                if ahead + back >= MINIMUM_MATCH:
                    self.stats["tag_hits"] += 1
                    if ahead + back > found:
                        found, source, reach = ahead + back, q - back, back
                j = link[j]
            i += 1
            if found > best_len:
                best_at, best_from, best_len = p - reach, source, found
            if best_len >= GREAT_MATCH or best_len and p >= best_at + MINIMUM_MATCH:
                emit()
        if best_len:
            emit()
        if last < n:
            out.append((0, last, n - last, 0))
        return out


def rebuild(tokens: list[tuple[int, int, int, int]], literals: bytes) -> bytes:
    """Bytes of a chunk from its tokens and literal stream; a match that reaches past its own start repeats."""
    out, at = bytearray(), 0
    for kind, _, length, distance in tokens:
        if not kind:
            out += literals[at : at + length]
            at += length
        elif distance >= length:
            out += out[len(out) - distance : len(out) - distance + length]
        else:
            if not 0 < distance <= len(out):
                raise ValueError("a match points before its chunk")
            period = bytes(out[-distance:])
            out += (period * (length // distance + 1))[:length]
        if kind and not 0 < distance <= len(out) - length:
            raise ValueError("a match points before its chunk")
    if at != len(literals):
        raise ValueError("literals are left over")
    return bytes(out)


def to_streams(tokens: list[tuple[int, int, int, int]], data: bytes, width: int) -> tuple[bytes, bytes]:
    """(control stream, literal stream): head, 16-bit length and, for matches, ``width`` bytes of distance; then a
    literal of length 0 and the CRC of the chunk."""
    control, literals = bytearray(), bytearray()
    for kind, at, length, distance in tokens:
        if not kind:
            literals += data[at : at + length]
        while length:
            part = min(length, LONGEST_TOKEN)
            control += bytes([kind]) + part.to_bytes(2, "little")
            if kind:
                control += distance.to_bytes(width, "little")
            length -= part
    control += b"\0\0\0" + zlib.crc32(data).to_bytes(4, "little")
    return bytes(control), bytes(literals)


def from_streams(control: bytes, width: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(tokens, CRC) of a control stream."""
    tokens, at, pos = [], 0, 0
    while True:
        if at + 3 > len(control):
            raise ValueError("the control stream is cut short")
        kind, length = control[at], int.from_bytes(control[at + 1 : at + 3], "little")
        at += 3
        distance = 0
        if kind:
            distance = int.from_bytes(control[at : at + width], "little")
            at += width
        elif not length:
            return tokens, int.from_bytes(control[at : at + 4], "little")
        tokens.append((kind, pos, length, distance))
        pos += length


CHUNK_KEYS = "archive_id string, chunk_no int"
TOKENS = f"{CHUNK_KEYS}, token_no bigint, kind int, out_pos bigint, len bigint, distance bigint"
STATS = f"{CHUNK_KEYS}, chunk_size bigint, literals bigint, literal_bytes bigint, matches bigint, match_bytes bigint, inserts bigint, probes bigint, tag_hits bigint, tag_misses bigint, crc32 bigint, roundtrip boolean"
STREAMS = f"{CHUNK_KEYS}, stream_no int, u_len bigint, data binary, chunk_bytes int, chunk_size bigint"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _over(chunks: DataFrame, schema: str, kinds: list, rows_of) -> DataFrame:
    """Rows made from each chunk's (archive_id, chunk_no, data), some chunks' worth at a time."""
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows += rows_of(*(x.as_py() for x in row))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return chunks.select("archive_id", "chunk_no", "data").mapInArrow(run, schema)


_KEYS = [pa.string(), pa.int32()]
_LONG = pa.int64()


def parse_chunks(chunks: DataFrame, level: int = 7) -> DataFrame:
    """One row per token."""

    def rows(archive, chunk, data):
        return [(archive, chunk, i, *t) for i, t in enumerate(Parser(level).tokens(data or b""))]

    return _over(chunks, TOKENS, [*_KEYS, _LONG, pa.int32(), _LONG, _LONG, _LONG], rows)


def parse_stats(chunks: DataFrame, level: int = 7) -> DataFrame:
    """Counters of each chunk's parse, and whether the tokens rebuild it."""

    def rows(archive, chunk, data):
        data = data or b""
        parser = Parser(level)
        tokens = parser.tokens(data)
        literal = [t for t in tokens if not t[0]]
        match = [t[2] for t in tokens if t[0]]
        control, literals = to_streams(tokens, data, 8)
        again, crc = from_streams(control, 8)
        ok = rebuild(again, literals) == data and crc == zlib.crc32(data)
        s = parser.stats
        counts = (len(literal), sum(t[2] for t in literal), len(match), sum(match))
        return [(archive, chunk, len(data), *counts, *(s[k] for k in ("inserts", "probes", "tag_hits", "tag_misses")), crc, ok)]

    return _over(chunks, STATS, [*_KEYS, *[_LONG] * 10, pa.bool_()], rows)


def token_streams(chunks: DataFrame, level: int = 7) -> DataFrame:
    """Two rows per chunk: control tokens (stream 0) and literal bytes (stream 1)."""

    def rows(archive, chunk, data):
        data = data or b""
        width = max(1, -(-len(data).bit_length() // 8))
        streams = to_streams(Parser(level).tokens(data), data, width)
        return [(archive, chunk, i, len(x), x, width, len(data)) for i, x in enumerate(streams)]

    return _over(chunks, STREAMS, [*_KEYS, pa.int32(), _LONG, pa.binary(), pa.int32(), _LONG], rows)
