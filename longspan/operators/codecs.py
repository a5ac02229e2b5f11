"""Block codecs and the tests before them: minimum size, compressibility gate, keep only what got smaller."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import METHODS, STORED_BELOW, SUPPORTED, ZSTD_LEVELS, Options
from . import lzo

GATE_BYTES = 100 << 20
_LZ4 = pa.Codec("lz4_raw")


class UnsupportedCodec(ValueError):
    """There is no library for this method here; nothing else is used in its place."""


#: Codecs of a user's own: method -> (pack(data, level), unpack(data, size)); set on the driver; columns carry them to the tasks.
_OWN: dict[str, tuple[Callable[[bytes, int], bytes], Callable[[bytes, int], bytes]]] = {}


def register(method: str, pack: Callable[[bytes, int], bytes], unpack: Callable[[bytes, int], bytes]) -> None:
    """Give a method without a library, or a name of one's own for columns, a pair of functions."""
    if method in SUPPORTED:
        raise ValueError(f"{method} has a codec already")
    _OWN[method] = (pack, unpack)


def registered(method: str) -> bool:
    return method in _OWN


def _lzma_filter(level: int, size: int, dictionary: int = 0) -> dict:
    dictionary = dictionary or 1 << (2 * level + 16 if level < 4 else level + 19 if level < 7 else level + 18)
    return {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": max(4096, min(dictionary, size)), "nice_len": 32 if level < 7 else 64, "mode": lzma.MODE_NORMAL if level >= 5 else lzma.MODE_FAST, "mf": lzma.MF_BT4 if level >= 5 else lzma.MF_HC4}


@cache
def _zstd(level: int):
    """A level's compressor, which a process makes once."""
    import zstandard

    return zstandard.ZstdCompressor(level=level)


def sizes_by_level(method: str, data: bytes, levels: range = range(1, 10)) -> list[int]:
    """Packed size at each level; what is coded alike at several is coded once."""
    if method == "lzo":  # knows no levels
        return [len(encode(method, data))] * len(levels)
    if method == "bzip2":
        alike = [min(level, 1 + len(data) // 79_000) for level in levels]
    elif method == "lzma":
        alike = [tuple(_lzma_filter(level, len(data)).items()) for level in levels]
    else:
        alike = list(levels)
    found: dict = {}
    for key, level in zip(alike, levels, strict=True):
        if key not in found:
            found[key] = len(encode(method, data, level))
    return [found[key] for key in alike]


def encode(method: str, data: bytes, level: int = 7, zstd_level: int = 0, dictionary: int = 0) -> bytes:
    if method == "none":
        return data
    if method == "bzip2":
        # one block is the same at every level that holds it, but for the level's digit; runs grow by a quarter at most
        least = min(level, 1 + len(data) // 79_000)
        packed = bz2.compress(data, least)
        return packed if least == level else packed[:3] + b"%d" % level + packed[4:]
    if method == "gzip":
        return zlib.compress(data, level)
    if method == "lzma":
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[_lzma_filter(level, len(data), dictionary)])
    if method == "zstd":
        return _zstd(zstd_level or ZSTD_LEVELS[level]).compress(data)
    if method == "lzo":
        return lzo.compress(data)
    if method in _OWN:
        return _OWN[method][0](data, level)
    raise UnsupportedCodec(method)


def decode(method: str, data: bytes, size: int, dictionary: int = 0) -> bytes:
    """Undo ``encode``; ``size`` is what must come out."""
    if method == "none":
        out = data
    elif method == "bzip2":
        out = bz2.decompress(data)
    elif method == "gzip":
        out = zlib.decompress(data)
    elif method == "lzma":
        f = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": max(4096, dictionary or size)}
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[f]).decompress(data, size) if size else b""
    elif method == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    elif method == "lzo":
        out = lzo.decompress(data, size)
    elif method in _OWN:
        out = _OWN[method][1](data, size)
    else:
        raise UnsupportedCodec(method)
    if len(out) != size:
        raise ValueError(f"a {method} block has {len(out)} bytes, not {size}")
    return out


def dictionary_of(code: int) -> int:
    """Bytes of an LZMA dictionary by its stored code, 0 to 40."""
    return 0xFFFFFFFF if code == 40 else (2 | code & 1) << code // 2 + 11


def compressibility(data: bytes, threshold: int = 100) -> int:
    """Percentage (1 at least) to which a quick codec brings the block, 0 if not below the threshold.

    The test begins with 100 MB and takes a longer prefix each time it fails, until the block ends.
    """
    size = min(len(data), GATE_BYTES)
    while size:
        packed = len(_LZ4.compress(data[:size], asbytes=True))
        percent = max(1, packed * 100 // size)
        if packed < size * threshold // 100:
            return percent if percent <= threshold else 0
        if size == len(data):
            return 0
        size = min(len(data), size * 2)
    return 0


def encode_block(data: bytes, options: Options) -> tuple[int, bytes]:
    """(block type, payload): stored if small, if the gate refuses it, or if the codec makes it no smaller."""
    stored = METHODS["none"][0], data
    if options.method == "none" or len(data) < STORED_BELOW:
        return stored
    if options.gated and not compressibility(data, options.threshold):
        return stored
    dictionary = dictionary_of(options.dictionary) if options.dictionary >= 0 else 0
    packed = encode(options.method, data, options.level, options.zstd_level, dictionary)
    return (METHODS[options.method][0], packed) if len(packed) < len(data) else stored


def gate(data: Column, threshold: int = 100) -> Column:
    """``compressibility`` of a binary column."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: compressibility(bytes(x or b""), threshold)).astype(np.int32)

    return run(data)


def coded(data: Column, method: str, level: int = 7) -> Column:
    """A binary column through a codec."""
    own = _OWN.get(method)
    if method not in SUPPORTED and own is None:
        raise UnsupportedCodec(method)
    pack = own[0] if own else lambda x, n: encode(method, x, n)

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else pack(bytes(x), level))

    return run(data)


def decoded(data: Column, size: Column, method: str) -> Column:
    own = _OWN.get(method)
    if method not in SUPPORTED and own is None:
        raise UnsupportedCodec(method)
    unpack = own[1] if own else lambda x, n: decode(method, x, n)

    @F.pandas_udf("binary")
    def run(values: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpack(bytes(x), int(n)) for x, n in zip(values, sizes, strict=True)], dtype=object)

    return run(data, size)


def method_string(method: str, level: int, percent: int = 50) -> str:
    """What a ZPAQ coder would be asked for: level, block code, redundancy and type; a label for others."""
    if method != "zpaq":
        return f"{method}-{level}"
    redundancy = max(25, int(256 - percent * 2.55))
    block = {1: 4, 2: 4, 3: 4, 4: 5, 5: 5}.get(level, level)
    return f"{int(level * 5 / 9 + 0.5)}{block},{redundancy},{int(redundancy > 192)}"
