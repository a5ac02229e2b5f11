"""Arithmetic of sizes, levels and ratios as Column expressions (whole-stage code, no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1 << 20


def _case(value: Column, table: dict[int, int], default: int | None = None) -> Column:
    out = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(0)))
    return out if default is None else out.otherwise(F.lit(default))


def page_floor(size: Column, page: int = 4096) -> Column:
    """Down to whole pages, one at least."""
    return F.greatest(size - size % page, F.lit(page))


def page_ceil(size: Column, page: int = 4096) -> Column:
    return size + F.pmod(-size, F.lit(page))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole; wholes of 100 and more are divided by 100 as integers first, and 0 counts as 1."""
    small = part * 100.0 / F.when(whole == 0, 1).otherwise(whole)
    return F.when(whole < 100, small).otherwise(part / F.expr("1.0D") / F.floor(whole / 100))


def dictionary_bytes(level: Column) -> Column:
    """LZMA dictionary of a level: 256 KB, 1 MB, 4 MB; 8, 16, 32 MB; 32, 64, 128 MB."""
    return _case(level, {n: 1 << (2 * n + 16 if n < 4 else n + 19 if n < 7 else n + 18) for n in range(1, 10)}, 1 << 24)


def zpaq_block_code(level: Column) -> Column:
    return _case(level, {1: 4, 2: 4, 3: 4, 4: 5, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}, 4)


def zpaq_level(level: Column) -> Column:
    return F.floor(level * 5 / 9 + 0.5).cast("int")


def bzip3_block_bytes(code: Column) -> Column:
    return _case(code, {p: 0x1FF00000 if p == 8 else (2 | p & 1) << p // 2 + 24 for p in range(9)})


def codec_overhead(method: Column, level: Column) -> Column:
    """Bytes a coder of a method and level needs beyond its buffers."""
    lzma = F.floor(dictionary_bytes(level).cast("bigint") * 23 / 2) + 6 * MB + 16384
    state = _case(zpaq_level(level), {1: 128, 2: 450, 3: 450, 4: 550}, 850).cast("bigint")
    zpaq = (F.pow(F.lit(2), zpaq_block_code(level)).cast("bigint") + state) * MB
    bzip3 = bzip3_block_bytes(level - 1).cast("bigint") * 6
    return F.when(method == "lzma", lzma).when(method == "zpaq", zpaq).when(method == "bzip3", bzip3).otherwise(F.lit(0)).cast("bigint")


def dictionary_of_code(code: Column) -> Column:
    """Dictionary size of a stored code 0 to 40."""
    size = (2 + code % 2) * F.pow(F.lit(2), F.floor(code / 2) + 11)
    return F.when(code == 40, F.lit(0xFFFFFFFF)).otherwise(size).cast("bigint")


def lzma_properties(byte: Column) -> tuple[Column, Column, Column]:
    """lc, lp, pb of a property byte."""
    return byte % 9, F.floor(byte / 9) % 5, F.floor(byte / 45)


def delta_distance(code: Column) -> Column:
    return F.when(code <= 16, code).otherwise((code - 15) * 16)


def byte_width(size: Column) -> Column:
    """Bytes that hold ``size``, one at least."""
    return F.ceil(F.length(F.bin(size.cast("bigint"))) / 8).cast("int")


def low_ones(tag: Column) -> Column:
    """How many low bits are ones in a row: ones of tag & ~(tag + 1)."""
    return F.bit_count(tag.bitwiseAND(F.bitwise_not(tag + 1)))


def swapped(value: Column, width: int) -> Column:
    """An unsigned number with its ``width`` bytes turned round."""
    return sum((F.shiftright(value, 8 * i).bitwiseAND(255) * F.lit(1 << 8 * (width - 1 - i)) for i in range(width)), F.lit(0).cast("bigint"))


def little_endian(data: Column, at: Column | int, width: Column, widest: int = 8) -> Column:
    """Unsigned little-endian number of ``width`` bytes that begins at byte ``at`` (from 0)."""
    start = F.lit(at) if isinstance(at, int) else at

    def byte(i: int) -> Column:
        return F.conv(F.hex(F.substring(data, start + i + 1, F.lit(1))), 16, 10).cast("bigint")

    return reduce(lambda a, b: a + b, (F.when(width > i, F.shiftleft(byte(i), 8 * i)).otherwise(F.lit(0)) for i in range(widest)))


def ratio(original: Column, packed: Column) -> Column:
    return F.when(packed > 0, original / packed)


def bits_per_byte(original: Column, packed: Column) -> Column:
    return F.when(original > 0, packed * 8.0 / original)


def mb_per_second(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / (MB * seconds))


def clock(seconds: Column) -> tuple[Column, Column, Column]:
    """Hours, minutes, seconds of a whole number of seconds."""
    return F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60


def packed_name(path: Column, suffix: str = ".lsp", folder: str = "") -> Column:
    """Where a packed file goes: its own name with the suffix, in ``folder`` if given."""
    base = F.element_at(F.split(path, "/"), -1) if folder else path
    return F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), base, F.lit(suffix))


def unpacked_name(path: Column, suffix: str = ".lsp", folder: str = "") -> Column:
    """The name without the suffix; a name without it gets ``.out`` instead."""
    base = F.element_at(F.split(path, "/"), -1) if folder else path
    cut = F.when(F.endswith(base, F.lit(suffix)), F.left(base, F.length(base) - len(suffix))).otherwise(F.concat(base, F.lit(".out")))
    return F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), cut)


def redundancy(compressibility: Column) -> Column:
    """256 - 2.55 * percentage of the gate, 25 at least; 192 and more is taken for text."""
    return F.greatest(F.floor(256 - compressibility * 2.55), F.lit(25)).cast("int")
