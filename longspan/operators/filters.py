"""Reversible byte filters: delta, and branch converters that make call targets absolute.

Fixed-width instruction sets are done in numpy on whole blocks; x86 and ARM Thumb go through the standard
library's own filters (coding with the filter in front of LZMA2 and decoding LZMA2 alone gives the filtered
bytes) if a block has anything like a branch; RISC-V, whose instructions have two widths, is a scan of the places
that can begin one.  Every block starts at address 0.
"""

from __future__ import annotations

import lzma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def _delta(data: bytes, distance: int, back: bool) -> bytes:
    x = np.frombuffer(data, np.uint8)
    if not back:
        out = x.copy()
        out[distance:] -= x[:-distance] if len(x) > distance else x[:0]
        return out.tobytes()
    rows = np.zeros(-(-len(x) // distance) * distance, np.uint8)
    rows[: len(x)] = x
    return np.cumsum(rows.reshape(-1, distance), axis=0, dtype=np.uint8).tobytes()[: len(x)]


def _words(data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, order, len(data) // 4).astype(np.int64)


def _whole(words: np.ndarray, data: bytes, order: str) -> bytes:
    return (words & 0xFFFFFFFF).astype(order).tobytes() + data[len(words) * 4 :]


def _arm(data: bytes, back: bool) -> bytes:
    w = _words(data, "<u4")
    at = np.flatnonzero(w >> 24 == 0xEB)
    shift = (at * 4 + 8) >> 2
    w[at] = 0xEB000000 | (w[at] + (-shift if back else shift)) & 0xFFFFFF
    return _whole(w, data, "<u4")


def _ppc(data: bytes, back: bool) -> bytes:
    w = _words(data, ">u4")
    at = np.flatnonzero(w & 0xFC000003 == 0x48000001)
    w[at] = 0x48000001 | (w[at] - 1 + (-4 * at if back else 4 * at)) & 0x3FFFFFC
    return _whole(w, data, ">u4")


def _sparc(data: bytes, back: bool) -> bytes:
    w = _words(data, ">u4")
    top = w >> 22
    at = np.flatnonzero((top == 0x100) | (top == 0x1FF))
    moved = (((w[at] << 2) + (-4 * at if back else 4 * at)) & 0xFFFFFFFF) >> 2
    negative = moved >> 22 & 1
    w[at] = np.where(negative == 1, 0x7FC00000, 0x40000000) | moved & 0x3FFFFF
    return _whole(w, data, ">u4")


def _arm64(data: bytes, back: bool) -> bytes:
    """BL holds 26 bits of words, ADRP 21 bits of pages; ADRP only within 512 MB either way."""
    w = _words(data, "<u4")
    pc = np.arange(len(w)) * 4
    sign = -1 if back else 1
    call = np.flatnonzero(w >> 26 == 0x25)
    page = np.flatnonzero(w & 0x9F000000 == 0x90000000)
    pages = (w[page] >> 3 & 0x1FFFFC) | w[page] >> 29 & 3
    near = ((pages + 0x20000) & 0x1C0000) == 0
    page, pages = page[near], pages[near]
    new = pages + sign * (pc[page] >> 12)
    new &= 0x1FFFFF
    low = (new & 0x3FFFF) - np.where(new & 0x20000, 0x40000, 0)  # sign-extended from 18 bits
    low &= 0x1FFFFF
    w[call] = 0x94000000 | (w[call] + sign * (pc[call] >> 2)) & 0x3FFFFFF
    w[page] = 0x90000000 | w[page] & 0x1F | (low & 3) << 29 | (low >> 2) << 5
    return _whole(w, data, "<u4")


def _riscv(data: bytes, back: bool) -> bytes:
    """JAL to x1 or x5, and pairs of AUIPC with an instruction that uses its register."""
    b = bytearray(data)
    n = len(b)

    def u32(at: int) -> int:
        return int.from_bytes(b[at : at + 4], "little")

    def put(at: int, value: int) -> None:
        b[at : at + 4] = (value & 0xFFFFFFFF).to_bytes(4, "little")

    def uses(first: int, second: int) -> bool:
        """A load, store, jump or add-immediate whose base is the register that ``first`` sets."""
        return (first << 8 ^ second - 3) & 0xF8003 == 0

    def marks(first: int, register: int) -> bool:
        """A converted pair: x0 or x2 with the real register in the top bits and a valid second opcode."""
        return (first - 0x3117 << 18) & 0xFFFFFFFF < register & 0x1D

    # what is changed lies before the place that is looked at next, so these are all places to look at
    even = np.frombuffer(data, np.uint8)[: max(0, n - 7) : 2]
    i = 0
    for at in (2 * np.flatnonzero((even == 0xEF) | (even & 0x7F == 0x17))).tolist():
        if at < i:
            continue
        i = at
        if b[i] == 0xEF:
            if b[i + 1] & 0x0D:
                i += 2
                continue
            one, two, three = b[i + 1 : i + 4]
            if back:
                target = (one >> 4) << 17 | two << 9 | three << 1
                v = (target - i) & 0x1FFFFF
                word = v >> 20 << 31 | (v >> 1 & 0x3FF) << 21 | (v >> 11 & 1) << 20 | (v >> 12 & 0xFF) << 12
                put(i, word | (one & 15) << 8 | 0xEF)
            else:
                word = u32(i)
                v = word >> 31 << 20 | (word >> 21 & 0x3FF) << 1 | (word >> 20 & 1) << 11 | (word >> 12 & 0xFF) << 12
                target = v + i & 0x1FFFFF
                b[i + 1] = (target >> 17) << 4 & 0xF0 | one & 15
                b[i + 2], b[i + 3] = target >> 9 & 255, target >> 1 & 255
            i += 4
        else:
            word = u32(i)
            if word & 0xE80:  # a register other than x0 and x2
                second = u32(i + 4)
                if not uses(word, second):
                    i += 6
                    continue
                if back:
                    put(i, 0x17 | 2 << 7 | second << 12)
                    put(i + 4, word & 0xFFFFF000 | second >> 20)
                else:
                    target = (word & 0xFFFFF000) + (second >> 20) - (second >> 19 & 0x1000) + i
                    put(i, 0x17 | 2 << 7 | second << 12)
                    b[i + 4 : i + 8] = (target & 0xFFFFFFFF).to_bytes(4, "big")
                i += 8
            else:
                register = word >> 27
                if not marks(word, register):
                    i += 4
                    continue
                if back:
                    target = int.from_bytes(b[i + 4 : i + 8], "big") - i & 0xFFFFFFFF
                    put(i, 0x17 | register << 7 | target + 0x800 & 0xFFFFF000)
                    put(i + 4, word >> 12 | target << 20)
                else:
                    second = u32(i + 4)
                    put(i, 0x17 | register << 7 | second & 0xFFFFF000)
                    put(i + 4, word >> 12 | second << 20)
                i += 8
    return bytes(b)


#: Bit of each of the three slots of an IA-64 bundle that can hold a branch, by the bundle's template.
_SLOTS = np.array([0] * 16 + [4, 4, 6, 6, 0, 0, 7, 7, 4, 4, 0, 0, 4, 4, 0, 0], np.uint8)


def _ia64(data: bytes, back: bool) -> bytes:
    """Slots of 41 bits in bundles of 16 bytes; a branch has opcode 5 and holds 21 bits of bundles."""
    whole = np.frombuffer(data, np.uint8, len(data) // 16 * 16).reshape(-1, 16).copy()
    slots = _SLOTS[whole[:, 0] & 31]
    u = np.uint64
    for slot in range(3):
        byte, shift = divmod(5 + 41 * slot, 8)
        at = np.flatnonzero(slots >> slot & 1)
        words = sum(whole[at, byte + k].astype(u) << u(8 * k) for k in range(6)) if len(at) else np.zeros(0, u)
        own = words >> u(shift)
        calls = np.flatnonzero((own >> u(37) & u(15) == 5) & (own >> u(9) & u(7) == 0))
        if not len(calls):
            continue
        at, words, own = at[calls], words[calls], own[calls]
        source = (own >> u(13) & u(0xFFFFF) | (own >> u(36) & u(1)) << u(20)).astype(np.int64)
        target = (source - at if back else source + at) & 0x1FFFFF  # of bundles
        target = target.astype(u)
        own = own & ~(u(0x8FFFFF) << u(13)) | (target & u(0xFFFFF)) << u(13) | (target >> u(20)) << u(36)
        words = words & u((1 << shift) - 1) | own << u(shift)
        for k in range(6):
            whole[at, byte + k] = (words >> u(8 * k) & u(255)).astype(np.uint8)
    return whole.tobytes() + data[whole.size :]


def _has_branch(name: str, data: bytes) -> bool:
    """False if the x86 or ARM Thumb filter finds nothing to change."""
    if name == "x86":
        return b"\xe8" in data or b"\xe9" in data
    x = np.frombuffer(data, np.uint8)
    return bool(((x[1:-2:2] & 0xF8 == 0xF0) & (x[3::2] & 0xF8 == 0xF8)[: len(x[1:-2:2])]).any())


_STANDARD = {"x86": lzma.FILTER_X86, "armt": lzma.FILTER_ARMTHUMB, "ia64": lzma.FILTER_IA64, "arm": lzma.FILTER_ARM, "ppc": lzma.FILTER_POWERPC, "sparc": lzma.FILTER_SPARC}
_OWN = {"arm": _arm, "ppc": _ppc, "sparc": _sparc, "arm64": _arm64, "riscv": _riscv, "ia64": _ia64}
_PLAIN = {"id": lzma.FILTER_LZMA2, "preset": 0}


def by_library(name: str, data: bytes, back: bool) -> bytes:
    """The standard library's filter of that name on its own."""
    chain = [{"id": _STANDARD[name]}, _PLAIN]
    pack, unpack = ([_PLAIN], chain) if back else (chain, [_PLAIN])
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=pack), lzma.FORMAT_RAW, filters=unpack)


def apply_filter(name: str, data: bytes, delta: int = 0, back: bool = False) -> bytes:
    """Filter a block, or undo it."""
    if name == "none" or not data:
        return data
    if name == "delta":
        return _delta(data, delta, back)
    if name in _OWN:
        return _OWN[name](data, back)
    return by_library(name, data, back) if _has_branch(name, data) else data


def filtered(data: Column, name: str, delta: int = 0, back: bool = False) -> Column:
    """A binary column through ``apply_filter``, an Arrow batch at a time."""
    @F.pandas_udf(BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else apply_filter(name, bytes(x), delta, back))

    return run(data)
