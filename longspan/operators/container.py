"""The container: header of every version, chunk headers and the linked lists of block headers.

``write_archive`` gives bytes of the current version; ``read_header``, ``block_rows`` and ``unpack`` read them.
Readers work on one archive's bytes in a task; ``archives``, ``blocks`` and ``validate`` apply them to a table of
files, so that the index becomes rows to be queried.

Encrypted archives hold a salt in the place of the size, chunks without their size, and each block header, each
payload and the digest encrypted under a key of its own: header and payload have salts before them.
"""

from __future__ import annotations

import lzma
import os
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..options import CIPHERS, DIGESTS, METHOD_OF_TYPE, METHODS, Options, delta_code, delta_of
from . import aes
from .codecs import decode, dictionary_of, encode_block
from .crypto import SALT_BYTES, key_and_iv, stretch
from .digests import digest_bytes
from .filters import apply_filter
from .parse import Parser, from_streams, rebuild, to_streams

MAGIC = bytes((76, 82, 90, 73))  # the format's tag
HEADER_BYTES = {6: 24, 7: 24, 8: 18, 9: 20, 10: 20, 11: 21, 12: 21, 13: 21, 14: 21}
FILTER_NAMES = {1: "x86", 2: "arm", 3: "armt", 4: "ppc", 5: "sparc", 6: "ia64", 7: "arm64", 8: "riscv"}
EARLY_FILTERS = {1: "x86", 2: "arm", 3: "armt", 4: "ppc", 5: "sparc", 6: "ia64"}
_BY_CODE = {code: (name, size) for name, (code, size) in DIGESTS.items()}


class DamagedArchive(ValueError):
    pass


class Lock:
    """Keys of one archive from its password and salt, whose first byte is the exponent of the stretching cost."""

    def __init__(self, password: bytes, salt: bytes, cipher_code: int):
        self.bytes = next(size for code, size in CIPHERS.values() if code == cipher_code)
        self.salt, self.salted = salt, salt + password
        self.stretched = stretch(self.salted, salt, salt[0])

    def seal(self, data: bytes, salt: bytes) -> bytes:
        return aes.encrypt(data, *key_and_iv(self.stretched, salt, self.salted, self.bytes))

    def open(self, data: bytes, salt: bytes) -> bytes:
        if len(data) < 16:
            raise DamagedArchive("an encrypted part is cut short")
        return aes.decrypt(data, *key_and_iv(self.stretched, salt, self.salted, self.bytes))


def lock_of(h: dict, password: bytes | None) -> Lock | None:
    """The lock of an encrypted archive; without a password it can't be made."""
    if not h["enc_code"]:
        return None
    if password is None:
        raise ValueError("the archive is encrypted")
    if not 1 <= h["salt"][0] <= 24:
        raise DamagedArchive(f"a stretching cost of 2 ** {h['salt'][0]}")
    return Lock(password, h["salt"], h["enc_code"])


def width_of(size: int) -> int:
    return max(1, -(-size.bit_length() // 8))


def _properties(o: Options) -> tuple[int, int]:
    """(codec byte, property byte) of a header."""
    codec = METHODS[o.method][1]
    if codec == 1 and o.dictionary >= 0:
        return 1, o.dictionary
    if codec == 1:
        return 1, next(i for i in range(41) if (1 << (2 * o.level + 16 if o.level < 4 else o.level + 19 if o.level < 7 else o.level + 18)) <= dictionary_of(i))
    if codec == 4:
        level = o.zstd_level or {1: 2, 2: 4, 3: 5, 4: 7, 5: 12, 6: 15, 7: 17, 8: 18, 9: 22}[o.level]
        return 4 | min(9, 1 + level * 8 // 22) << 4, level
    return codec, 0


def write_header(size: int, o: Options, salt: bytes = b"") -> bytes:
    codec, prop = _properties(o)
    kind = 0 if o.filter == "none" else 128 + delta_code(o.delta) if o.filter == "delta" else {v: k for k, v in FILTER_NAMES.items()}[o.filter]
    note = o.comment.encode()
    level = (o.match_level or o.level) << 4 | o.level
    return MAGIC + bytes([0, 14]) + (salt or size.to_bytes(8, "little")) + bytes([DIGESTS[o.digest][0], CIPHERS[o.cipher][0], kind, codec, prop, level, len(note)]) + note


def read_header(data: bytes) -> dict:
    """Fields of a header of version 0.6 to 0.14; ``length`` is where the chunks begin."""
    if data[:4] != MAGIC or len(data) < 6:
        raise DamagedArchive("not an archive")
    major, minor = data[4], data[5]
    if major or minor not in HEADER_BYTES:
        raise DamagedArchive(f"unknown version {major}.{minor}")
    length = HEADER_BYTES[minor]
    if len(data) < length:
        raise DamagedArchive("the header is cut short")
    m = data[:length]
    h = {"major": major, "minor": minor, "filter": 0, "delta": 0, "codec": 0, "codec_prop": 0, "match_level": 0, "level": 0, "comment": ""}
    hash_at, cipher_at = {6: (21, 22), 7: (22, 23)}.get(minor, (14, 15))
    h["hash_code"] = m[hash_at] if 0 < m[hash_at] <= 13 else 0
    h["enc_code"] = m[cipher_at] if 0 < m[cipher_at] <= 2 else 0
    h["orig_size"] = None if h["enc_code"] else int.from_bytes(m[6:14], "little")
    h["salt"] = m[6:14] if h["enc_code"] else b""
    if minor >= 7:
        f = m[16]
        if minor < 12:
            h["filter"] = f & 7
            if f & 7 == 7:
                code = f >> 3
                h["filter"], h["delta"] = 128, code + 1 if code <= 16 else (code - 15) * 16
        elif minor == 12:
            h["filter"], h["delta"] = (128, delta_of(f >> 3)) if f & 0xF8 else (f, 0)
        else:
            h["filter"], h["delta"] = (128, delta_of(f - 128)) if f > 128 else (f, 0)
    if minor in (6, 7):
        h["codec_prop"] = m[16 if minor == 6 else 17]
        h["codec"] = 1 if h["codec_prop"] else 0
    elif minor < 11:
        p = m[17]
        h["codec"] = 1 if 0 < p <= 40 else 3 if p & 0xF0 == 0xF0 else 2 if p & 0x80 else 0
        h["codec_prop"] = p & 0x0F if h["codec"] == 3 else p & 0x7F if h["codec"] == 2 else p
        if minor >= 9:
            h["match_level"], h["level"] = m[18] >> 4, m[18] & 15
    else:
        h["codec"], h["codec_prop"] = m[17], m[18]
        if m[17] & 15 > 4 or m[17] & 15 < 4 and m[17] > 3:
            raise DamagedArchive(f"unknown codec {m[17]}")
        h["match_level"], h["level"] = m[19] >> 4, m[19] & 15
    if minor >= 9:
        n = m[length - 1]
        note = data[length : length + n]
        if len(note) != n:
            raise DamagedArchive("the comment is cut short")
        h["comment"] = note.decode("utf-8", "replace")
        length += n
    h["length"] = length
    return h


def write_archive(data: bytes, o: Options, password: bytes | None = None, random: Callable[[int], bytes] = os.urandom) -> bytes:
    """An archive of ``data``; encrypted if the options name a cipher, with salts from ``random``."""
    lock = None
    if o.cipher != "NONE":
        if not password:
            raise ValueError("an encrypted archive needs a password")
        if DIGESTS[o.digest][1] < 16:
            raise ValueError("an encrypted archive needs a digest of 16 bytes or more")
        lock = Lock(password, bytes([o.cost]) + random(SALT_BYTES - 1), CIPHERS[o.cipher][0])
    out = bytearray(write_header(len(data), o, lock.salt if lock else b""))
    starts = list(range(0, len(data), o.chunk_bytes)) or [0]
    parser = Parser(o.match_level or o.level)
    lead = SALT_BYTES if lock else 0
    for at in starts:
        chunk = data[at : at + o.chunk_bytes]
        width = width_of(len(chunk))
        out += bytes([width, int(at == starts[-1])]) + (b"" if lock else len(chunk).to_bytes(width, "little"))
        base, field = len(out), 8 if lock else width
        heads: list[int] = []

        def header(kind: int, packed: int, plain: int, field: int = field, heads: list[int] = heads) -> bytes:
            heads.append(len(out) + lead)
            return bytes(lead) + bytes([kind]) + packed.to_bytes(field, "little") + plain.to_bytes(field, "little") + bytes(field)

        streams = to_streams(parser.tokens(chunk), chunk, width)
        # a stream can be longer than its chunk's width tells only for tiny chunks; its blocks are cut to fit
        room = min(o.block_bytes, (1 << 8 * width) - 1)
        last = []
        for _ in streams:
            last.append(len(out))
            out += header(METHODS["none"][0], 0, 0)
        parts = [(i, s[a : a + room]) for i, s in enumerate(streams) for a in range(0, len(s), room)]
        for i, part in parts:
            plain = apply_filter(o.filter, part, o.delta) if i else part
            kind, packed = encode_block(plain, o)
            here = len(out)
            if here - base >= 1 << 8 * field:
                raise ValueError("a chunk's index outgrows its offsets")
            link = last[i] + lead + 1 + 2 * field
            out[link : link + field] = (here - base).to_bytes(field, "little")
            last[i] = here
            out += header(kind, len(packed), len(part))
            if lock:
                salt = random(SALT_BYTES)
                packed = salt + lock.seal(packed + random(max(0, 16 - len(packed))), salt)
            out += packed
        for head in heads if lock else ():
            salt = random(SALT_BYTES)
            out[head - lead : head + 25] = salt + lock.seal(bytes(out[head : head + 25]), salt)
    digest = digest_bytes(o.digest, data)
    return bytes(out) + (lock.seal(digest, lock.salt) if lock else digest)


def _digest_size(h: dict) -> int:
    return _BY_CODE[h["hash_code"]][1] if h["hash_code"] or h["minor"] >= 11 else 0


def block_rows(data: bytes, h: dict | None = None, lock: Lock | None = None) -> Iterator[tuple]:
    """(chunk, width, eof, chunk size, stream, block, type, packed, plain, header at, next, payload at) of every
    block, in stored order of each stream.  Offsets that don't grow, or leave the archive, raise; an encrypted chunk's
    size is None."""
    h = h or read_header(data)
    if h["enc_code"] and lock is None:
        raise DamagedArchive("the archive is encrypted")
    tail = len(data) - _digest_size(h)
    lead = SALT_BYTES if lock else 0
    at, chunk, eof = h["length"], 0, False
    while not eof:
        if at + 2 > tail:
            raise DamagedArchive("a chunk header is cut short")
        width, eof = data[at], bool(data[at + 1])
        if not 1 <= width <= 8:
            raise DamagedArchive(f"chunk offsets of {width} bytes")
        field = 8 if lock else width
        size = None if lock else int.from_bytes(data[at + 2 : at + 2 + width], "little")
        base = end = at + 2 + (0 if lock else width)
        step = lead + 1 + 3 * field
        for stream in range(2):
            head, block = base + stream * step, 0
            while True:
                if head + step > tail:
                    raise DamagedArchive("a block header is cut short")
                fields = data[head + lead : head + step]
                if lock:
                    fields = lock.open(fields, data[head : head + lead])
                kind, packed, plain, following = fields[0], *(int.from_bytes(fields[1 + i * field : 1 + (i + 1) * field], "little") for i in range(3))
                if kind not in METHOD_OF_TYPE:
                    raise DamagedArchive("the password is wrong or a block header is damaged" if lock else f"unknown block type {kind}")
                payload = head + step
                stored = packed if not lock or not packed and not plain else lead + max(16, packed)
                if payload + stored > tail:
                    raise DamagedArchive("a block leaves the archive")
                yield chunk, width, eof, size, stream, block, kind, packed, plain, head - base, following, payload
                end = max(end, payload + stored)
                if not following:
                    break
                if base + following <= head:
                    raise DamagedArchive("block offsets go backwards")
                head, block = base + following, block + 1
        at, chunk = end, chunk + 1


def unpack(data: bytes, password: bytes | None = None) -> bytes:
    """What an archive holds; chunk checksums and the digest are both verified, in full."""
    found, error = salvage(data, password)
    if error is not None:
        raise error
    return found


def salvage(data: bytes, password: bytes | None = None) -> tuple[bytes, ValueError | None]:
    """(what can be read, what is wrong): whole chunks up to the first that is damaged."""
    out: list[bytes] = []
    try:
        h = read_header(data)
        lock = lock_of(h, password)
        name = FILTER_NAMES.get(h["filter"], "delta" if h["filter"] == 128 else "none")
        if h["minor"] < 12 and h["filter"] != 128:
            name = EARLY_FILTERS.get(h["filter"], "none")

        def body(row: tuple) -> bytes:
            kind, packed, plain, at = row[6], row[7], row[8], row[11]
            if not plain:
                return b""
            raw = data[at : at + packed]
            if lock:
                raw = lock.open(data[at + SALT_BYTES : at + SALT_BYTES + max(16, packed)], data[at : at + SALT_BYTES])[:packed]
            return decode(METHOD_OF_TYPE[kind], raw, plain)

        def finish(rows: list[tuple]) -> None:
            chunk, width, size = rows[0][0], rows[0][1], rows[0][3]
            parts = [b"".join(apply_filter(name, body(r), h["delta"], back=True) if r[4] else body(r) for r in rows if r[4] == i) for i in (0, 1)]
            tokens, crc = from_streams(parts[0], width)
            whole = rebuild(tokens, parts[1])
            if size is not None and len(whole) != size or digest_bytes("CRC", whole) != crc.to_bytes(4, "little"):
                raise DamagedArchive(f"chunk {chunk} is damaged")
            out.append(whole)

        held: list[tuple] = []
        for row in block_rows(data, h, lock):
            if held and row[0] != held[0][0]:
                finish(held)
                held = []
            held.append(row)
        finish(held)
        found = b"".join(out)
        digest, size = _BY_CODE[h["hash_code"]]
        stored = lock.open(data[-size:], lock.salt) if lock else data[-size:]
        if digest_bytes(digest, found) != stored:
            raise DamagedArchive("the digest differs")
        return found, None
    except ValueError as e:
        return b"".join(out), e
    except (ArithmeticError, EOFError, IndexError, MemoryError, OSError, RuntimeError, zlib.error, lzma.LZMAError) as e:  # of the codecs
        return b"".join(out), DamagedArchive(f"a block can't be decoded: {e}")


ARCHIVES = (
    "archive_id string, major int, minor int, orig_size bigint, archive_size bigint, hash_code int, enc_code int, filter int, "
    "delta int, codec int, codec_prop int, match_level int, level int, comment string, error string"
)
BLOCKS = (
    "archive_id string, chunk_no int, chunk_bytes int, eof boolean, chunk_size bigint, stream_no int, block_no int, c_type int, "
    "c_len bigint, u_len bigint, head_off bigint, next_head bigint, error string"
)


BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def _mapped(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows made from each (archive_id, data), some files' worth at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of(archive.as_py(), data.as_py() or b""):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    return files.select("archive_id", "data").mapInArrow(run, schema)


def archives(files: DataFrame) -> DataFrame:
    """Header fields of each archive; damage is told in ``error``."""
    fields = [x.split()[0] for x in ARCHIVES.split(", ")][1:-1]

    def rows(archive, data):
        try:
            h = read_header(data) | {"archive_size": len(data)}
            yield (archive, *(h[k] for k in fields), None)
        except DamagedArchive as e:
            yield (archive, *([None] * len(fields)), str(e))

    return _mapped(files, ARCHIVES, rows)


def blocks(files: DataFrame, password: bytes | None = None) -> DataFrame:
    """The block index of each archive; an archive whose index is damaged ends with a row that tells so."""

    def rows(archive, data):
        try:
            h = read_header(data)
            for r in block_rows(data, h, lock_of(h, password) if password is not None else None):
                yield (archive, *r[:-1], None)
        except DamagedArchive as e:
            yield (archive, *([None] * 11), str(e))

    return _mapped(files, BLOCKS, rows)


def packed(files: DataFrame, options: Options, password: bytes | None = None, random: Callable[[bytes], Callable[[int], bytes]] | None = None) -> DataFrame:
    """``archive_id, data``: an archive of each file's bytes.

    ``random`` makes the source of an archive's salts from its bytes, where they must be the same each time.
    """

    def rows(archive, data):
        return [(archive, write_archive(data, options, password, random(data) if random else os.urandom))]

    return _mapped(files, "archive_id string, data binary", rows)


def unpacked(files: DataFrame, password: bytes | None = None, keep_broken: bool = False) -> DataFrame:
    """``archive_id, data, error``: what each archive holds, or why it can't be read.

    With ``keep_broken`` what could be read of a damaged archive is given beside the error.
    """

    def rows(archive, data):
        found, error = salvage(data, password)
        yield archive, found if error is None or keep_broken else None, None if error is None else str(error)

    return _mapped(files, "archive_id string, data binary, error string", rows)


LOOKED_AT = "archive_id string, enc_code int, orig_size bigint, data binary, error string, locked string"


def looked_at(files: DataFrame, password: bytes) -> DataFrame:
    """What each archive's header tells, what it holds by the password, and what is said without one: in one pass."""

    def rows(archive, data):
        found, error = salvage(data, password)
        _, locked = salvage(data)
        told = [None if e is None else str(e) for e in (error, locked)]
        try:
            h = read_header(data)
        except DamagedArchive:
            h = {"enc_code": None, "orig_size": None}
        yield (archive, h["enc_code"], h["orig_size"], found if error is None else None, *told)

    return _mapped(files, LOOKED_AT, rows)
