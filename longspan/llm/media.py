"""Media columns: payload bytes stored losslessly as PNG in a binary column, read back, and hashed.

The PNG codec is written out here: chunks with CRC tests, one zlib stream over the IDAT chunks,
and the five row filters undone with numpy.  The perceptual hash takes the low frequencies of a
2-D cosine transform of the decoded picture.

Defined results: a null text is an empty one; an empty text becomes one row of padding; repeated
rows give repeated results; an empty table gives an empty one; other columns of the input are
ignored by ``media_features``, so names can't clash.  A damaged picture raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
IDAT_BYTES = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter byte; None, Sub or Up by the least sum of absolute signed samples."""
    up = rows.copy()
    up[1:] -= rows[:-1]
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    out = np.empty((len(rows), 1 + rows.shape[1]), np.uint8)
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (rows, sub, up)]
    kind = np.argmin(cost, axis=0).astype(np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 1)[:, None], sub, np.where((kind == 2)[:, None], up, rows))
    return out


def png_encode(payload: bytes, level: int = 4) -> bytes:
    """8-bit RGB picture of 64 pixels a row; ``payload`` has a positive multiple of 192 bytes.

    Of the unfiltered and the row-wise filtered form, the shorter one is kept.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    plain = np.zeros((len(rows), 1 + STRIDE), np.uint8)
    plain[:, 1:] = rows
    packed = min((zlib.compress(x.tobytes(), level) for x in (plain, _filtered(rows))), key=len)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", head)]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters.  Runs of Sub rows, and of Up rows, are undone in one numpy call each."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    h, stride = rows.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    if sub.any():
        rows[sub] = np.cumsum(rows[sub].reshape(-1, stride // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, stride)
    edges = np.flatnonzero(np.diff(kinds, prepend=255))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), h], strict=True):
        kind = kinds[a]
        if kind == 2:
            if a:
                rows[a] += rows[a - 1]
            if b - a > 1:
                rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
        elif kind >= 3:
            for y in range(a, b):
                above = rows[y - 1].astype(np.int16) if y else np.zeros(stride, np.int16)
                line = rows[y].astype(np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for x in range(0, stride, bpp):
                    top = above[x : x + bpp]
                    if kind == 3:
                        guess = (left + top) >> 1
                    else:
                        pa_, pb, pc = np.abs(top - corner), np.abs(left - corner), np.abs(left + top - 2 * corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, top, corner))
                    left = line[x : x + bpp] = (line[x : x + bpp] + guess) & 255
                    corner = top
                rows[y] = line
    return rows


MOST_BYTES = 1 << 31


def png_decode(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels); every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    if len(data) < 20:
        raise ValueError("PNG is cut short")
    at, head, idat, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"PNG chunk {kind!r} is damaged")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("PNG head has the wrong size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical PNG chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise ValueError("PNG is cut short")
    width, height, depth, colour, packing, filtering, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit PNG without palette or interlacing is read")
    if packing or filtering:
        raise ValueError("unknown PNG compression or filter method")
    size = height * (1 + width * channels)
    if not width or not height or size > MOST_BYTES:
        raise ValueError(f"a PNG of {width} x {height} is not read")
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(idat), size + 1)  # never more than the head tells
    except zlib.error as e:
        raise ValueError(f"PNG samples can't be unpacked: {e}") from None
    if len(raw) != size or not unpacker.eof:
        raise ValueError("PNG has the wrong number of samples")
    rows = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels), channels)
    return rows.reshape(height, width, channels)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


_DCT = _cosines(32)


def _shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Area means over ``n`` equal strips of the first axis."""
    sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    at = np.linspace(0, len(x), n + 1)
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    cut = sums[low] + (at - low)[:, None] * (sums[low + 1] - sums[low])
    return np.diff(cut, axis=0) * (n / len(x))


def cosine_hash(picture: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed their median (the constant term aside)."""
    grey = picture[..., :3] @ np.array([0.299, 0.587, 0.114]) if picture.shape[2] >= 3 else picture[..., 0].astype(float)
    low = (_DCT @ _shrunk(_shrunk(grey, 32).T, 32).T @ _DCT.T)[:8, :8].ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % STRIDE if raw else STRIDE)


SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, error string"
)


def encode_media(docs: DataFrame, level: int = 4) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a PNG in a binary column."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [payload_of(x) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([png_encode(p, level) for _, p in made], pa.binary()),
                ],
                ["doc_id", "n_bytes", "media"],
            )

        return f

    return over_batches(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), make, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode the binary column and compute digests and the hash of what was read back.

    A picture that is null or damaged has nulls for what can't be told, and ``error`` says why.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for data in batch.column(2).to_pylist():
                try:
                    if data is None:
                        raise ValueError("no picture")
                    picture = png_decode(data)
                    payload = picture.tobytes()
                    own = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                    rows.append((*own, len(data), hashlib.sha256(data).hexdigest(), cosine_hash(picture).hex(), None))
                except ValueError as e:
                    stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    rows.append((None, None, None, *stored, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

        return f

    return over_batches(media.select("doc_id", "n_bytes", "media"), make, SCHEMA)
