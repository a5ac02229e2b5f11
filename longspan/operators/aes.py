"""AES-128 and AES-256 in CBC mode with ciphertext stealing (CS3), for bytes that are put together inside a task.

Whole columns are better served by ``crypto``; an archive's headers and blocks are small and lie scattered.  They go
through the OpenSSL library that Python's own ``hashlib`` loads.  Where there is none, a block is encrypted by table
look-ups, one after the other as the mode wants it, and decrypted in numpy, all at once: the same bytes, a hundred times slower.
"""

from __future__ import annotations

import ctypes
import struct
from functools import cache

import numpy as np


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _boxes() -> tuple[list[int], list[int]]:
    """The S-box and its inverse, from inverses in GF(2^8) along the powers of 3."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = [0] * 256
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        s = 0
        for k in range(5):
            s ^= (b << k | b >> 8 - k) & 0xFF
        box[v] = s ^ 0x63
    back = [0] * 256
    for v, s in enumerate(box):
        back[s] = v
    return box, back


_BOX, _BACK = _boxes()
_TABLE = [_double(s) << 24 | s << 16 | s << 8 | (s ^ _double(s)) for s in _BOX]
_TABLES = [[(t >> 8 * k | t << 32 - 8 * k) & 0xFFFFFFFF for t in _TABLE] for k in range(4)]


def _times(v: int, n: int) -> int:
    out = 0
    while n:
        out ^= v if n & 1 else 0
        v, n = _double(v), n >> 1
    return out


_BACK_NP = np.array(_BACK, np.uint8)
_TIMES = {n: np.array([_times(v, n) for v in range(256)], np.uint8) for n in (9, 11, 13, 14)}
#: Where each byte of a block (four columns of four) comes from when rows are shifted back.
_SHIFT_BACK = np.array([(4 * ((c - r) % 4) + r) for c in range(4) for r in range(4)])


def round_keys(key: bytes) -> list[int]:
    """The expanded key as 32-bit words."""
    n = len(key) // 4
    if len(key) not in (16, 32):
        raise ValueError("a key has 16 or 32 bytes")
    words, constant = list(struct.unpack(f">{n}I", key)), 1
    sub = lambda w: _BOX[w >> 24] << 24 | _BOX[w >> 16 & 255] << 16 | _BOX[w >> 8 & 255] << 8 | _BOX[w & 255]
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ constant << 24
            constant = _double(constant)
        elif n > 6 and i % n == 4:
            w = sub(w)
        words.append(words[i - n] ^ w)
    return words


def _encrypt_chain(data: bytes, key: bytes, iv: bytes) -> bytes:
    """CBC of whole blocks."""
    k = round_keys(key)
    t0, t1, t2, t3 = _TABLES
    box, rounds, out = _BOX, len(k) // 4 - 1, []
    c0, c1, c2, c3 = struct.unpack(">4I", iv)
    for p0, p1, p2, p3 in struct.iter_unpack(">4I", data):
        a, b, c, d = c0 ^ p0 ^ k[0], c1 ^ p1 ^ k[1], c2 ^ p2 ^ k[2], c3 ^ p3 ^ k[3]
        for i in range(4, 4 * rounds, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[i],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[i + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[i + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[i + 3],
            )
        i = 4 * rounds
        c0 = (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ k[i]
        c1 = (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ k[i + 1]
        c2 = (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ k[i + 2]
        c3 = (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ k[i + 3]
        out += (c0, c1, c2, c3)
    return struct.pack(f">{len(out)}I", *out)


def _decrypt_blocks(data: bytes, key: bytes) -> np.ndarray:
    """Each block on its own, without the chaining (blocks x 16)."""
    k = np.frombuffer(struct.pack(f">{len(w := round_keys(key))}I", *w), np.uint8).reshape(-1, 16)
    x = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ k[-1]
    for i in range(len(k) - 2, -1, -1):
        x = _BACK_NP[x[:, _SHIFT_BACK]] ^ k[i]
        if i:
            s = x.reshape(-1, 4, 4)
            a, b, c, d = (s[:, :, r] for r in range(4))
            x = np.stack(
                [
                    _TIMES[14][p] ^ _TIMES[11][q] ^ _TIMES[13][r] ^ _TIMES[9][t]
                    for p, q, r, t in ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
                ],
                axis=2,
            ).reshape(-1, 16)
    return x


@cache
def _openssl() -> ctypes.CDLL | None:
    """The OpenSSL library of this process, or None."""
    try:
        import _hashlib  # noqa: F401, loads it

        with open("/proc/self/maps") as f:
            path = next(line.split(None, 5)[5].strip() for line in f if "libcrypto" in line)
        found = ctypes.CDLL(path)
        for name, kinds in (("EVP_CIPHER_CTX_new", ""), ("EVP_CIPHER_CTX_free", "p"), ("EVP_aes_128_cbc", ""), ("EVP_aes_256_cbc", ""), ("EVP_CIPHER_CTX_set_padding", "pi"), ("EVP_CipherInit_ex", "pppssi"), ("EVP_CipherUpdate", "pppsi")):
            f = getattr(found, name)
            f.argtypes = [{"p": ctypes.c_void_p, "i": ctypes.c_int, "s": ctypes.c_char_p}[k] for k in kinds]
            f.restype = ctypes.c_int if kinds not in ("", "p") else None if kinds else ctypes.c_void_p
        return found
    except (ImportError, OSError, StopIteration, AttributeError):
        return None


def _cbc(data: bytes, key: bytes, iv: bytes, forward: bool) -> bytes:
    """CBC of whole blocks, there or back."""
    if (lib := _openssl()) is None:
        if forward:
            return _encrypt_chain(data, key, iv)
        return (_decrypt_blocks(data, key) ^ np.frombuffer(iv + data[:-16], np.uint8).reshape(-1, 16)).tobytes()
    if len(key) not in (16, 32):
        raise ValueError("a key has 16 or 32 bytes")
    out, n = ctypes.create_string_buffer(len(data)), ctypes.c_int()
    context = lib.EVP_CIPHER_CTX_new()
    try:
        kind = lib.EVP_aes_128_cbc() if len(key) == 16 else lib.EVP_aes_256_cbc()
        done = lib.EVP_CipherInit_ex(context, kind, None, key, iv, int(forward)) and lib.EVP_CIPHER_CTX_set_padding(context, 0)
        if not (done and lib.EVP_CipherUpdate(context, out, ctypes.byref(n), data, len(data)) and n.value == len(data)):
            raise RuntimeError("OpenSSL refused AES")
    finally:
        lib.EVP_CIPHER_CTX_free(context)
    return out.raw


def encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """CBC-CS3 of 16 bytes or more: the last two blocks change places, and the later one loses what was filled up."""
    if len(data) < 16:
        raise ValueError("ciphertext stealing needs 16 bytes")
    done = _cbc(data + bytes(-len(data) % 16), key, iv, True)
    if len(done) == 16:
        return done
    return (done[:-32] + done[-16:] + done[-32:-16])[: len(data)]


def decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """Undo ``encrypt``."""
    n = len(data)
    if n < 16:
        raise ValueError("ciphertext stealing needs 16 bytes")
    if n > 16:
        rest = (n - 1) % 16 + 1
        front, last, stolen = data[: n - rest - 16], data[n - rest - 16 : n - rest], data[n - rest :]
        filled = stolen + _cbc(last, key, bytes(16), False)[rest:]
        data = front + filled + last
    return _cbc(data, key, iv, False)[:n]
