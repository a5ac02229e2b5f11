"""AES in CBC mode with ciphertext stealing, keys from scrypt and SHAKE, on Spark's own AES functions.

A block cipher is not at hand in Python, so whole binary columns are encrypted by ``aes_encrypt`` in CBC mode
and the stolen tail is put together from its output; decryption makes up the padding block that
``aes_decrypt`` wants.  The last two blocks are swapped, as in the CS3 layout; 16 bytes are plain CBC, and
shorter data, for which there is nothing to steal from, are refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BYTES, SALT_BYTES = 64, 8


def stretch(password: bytes, salt: bytes, cost_exponent: int) -> bytes:
    """64 bytes of scrypt with N = 2 ** cost_exponent, r = 8, p = 1."""
    n = 1 << cost_exponent
    return hashlib.scrypt(password, salt=salt, n=n, r=8, p=1, maxmem=256 * n * 8 + (1 << 20), dklen=HASH_BYTES)


def key_and_iv(stretched: bytes, block_salt: bytes, salted_password: bytes, key_bytes: int) -> tuple[bytes, bytes]:
    """Key and IV of one block: an extendable hash of hash, salt and password, then of the key, salt and password."""
    shake = hashlib.shake_128 if key_bytes == 16 else hashlib.shake_256
    key = shake(stretched + block_salt + salted_password).digest(key_bytes)
    return key, shake(key + block_salt + salted_password).digest(16)


def _cut(data: Column, start: Column | int, length: Column | int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(data, lit(start), lit(length))


def _cbc(data: Column, key: Column, iv: Column) -> Column:
    """CBC with padding, without the IV that Spark puts in front."""
    out = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("DEFAULT"), iv)
    return _cut(out, 17, F.octet_length(out) - 16)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as the variable of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def encrypt(data: Column, key: Column, iv: Column) -> Column:
    """CBC-CS3 of a binary column of 16 bytes or more."""
    size = F.octet_length(data)
    rest = F.pmod(size - 1, F.lit(16)) + 1  # bytes in the last block, 1 to 16
    blocks = size + 16 - rest
    swapped = lambda raw: F.concat(_cut(raw, 1, blocks - 32), _cut(raw, blocks - 15, 16), _cut(raw, blocks - 31, rest))
    done = _let(_cbc(F.concat(data, _zeros(16 - rest)), key, iv), lambda raw: F.when(size == 16, _cut(raw, 1, 16)).otherwise(swapped(raw)))
    return F.when(size < 16, F.raise_error(F.lit("ciphertext stealing needs 16 bytes")).cast("binary")).otherwise(done)


def _xor(a: Column, b: Column, n: int = 16) -> Column:
    """XOR of two binary values of ``n`` <= 16 bytes, eight at a time as numbers."""
    parts = []
    for at in range(1, n + 1, 4):
        x, y = (F.conv(F.hex(_cut(v, at, 4)), 16, 10).cast("bigint") for v in (a, b))
        parts.append(F.lpad(F.hex(x.bitwiseXOR(y)), 8, "0"))
    return F.unhex(F.concat(*parts))


def _opened(data: Column, key: Column, iv: Column) -> Column:
    """CBC decryption of whole blocks, by way of a block of padding put behind them."""
    zero = F.unhex(F.lit("00" * 16))

    def padded(d: Column) -> Column:
        tail = _cut(_cbc(_xor(F.unhex(F.lit("10" * 16)), _cut(d, F.octet_length(d) - 15, 16)), key, zero), 1, 16)
        return F.aes_decrypt(F.concat(iv, d, tail), key, F.lit("CBC"), F.lit("DEFAULT"))

    return _let(data, padded)


def decrypt(data: Column, key: Column, iv: Column) -> Column:
    """Undo ``encrypt``."""
    size = F.octet_length(data)
    rest = F.pmod(size - 1, F.lit(16)) + 1
    front = size - rest - 16  # bytes before the last two blocks
    final = _cut(data, front + 1, 16)
    stolen = _cut(data, front + 17, rest)
    whole = _let(_opened(final, key, F.unhex(F.lit("00" * 16))), lambda o: F.concat(_cut(data, 1, front), stolen, _cut(o, rest + 1, 16 - rest), final))
    done = F.when(size == 16, _opened(data, key, iv)).otherwise(_cut(_opened(whole, key, iv), 1, size))
    return F.when(size < 16, F.raise_error(F.lit("ciphertext stealing needs 16 bytes")).cast("binary")).otherwise(done)
