"""LZO1X blocks: a decoder of the public byte format and a greedy encoder of it.

A stream is a row of instructions.  A byte below 16 is a run of literals after no pending ones, else a short match;
from 64 on a match of 3 to 8 bytes within 2 KB, from 32 on any length within 16 KB, from 16 on any length from 16 to
48 KB away.  The low two bits of a match's last byte tell how many literals follow it.  The last instruction is 17, 0, 0.
"""

from __future__ import annotations

import numpy as np

_NEAR, _MIDDLE, _FAR = 0x0800, 0x4000, 0xBFFF


def decompress(data: bytes, size: int) -> bytes:
    """The ``size`` bytes of a stream; damage raises ``ValueError``."""
    out, at, end = bytearray(), 0, len(data)
    pending = 0  # literals of the last instruction: 0, 1 to 3, or 4 for a run
    try:
        if data and data[0] > 17:
            pending = data[0] - 17
            out += data[1 : 1 + pending]
            at = 1 + pending
            pending = min(pending, 4)
        while True:
            t = data[at]
            at += 1
            if t >= 64:
                length, distance = (t >> 5) + 1, 1 + (t >> 2 & 7) + (data[at] << 3)
                at += 1
            elif t >= 16:
                mask = 31 if t >= 32 else 7
                length = 2 + (t & mask)
                if length == 2:
                    length += mask
                    while not data[at]:
                        length += 255
                        at += 1
                    length += data[at]
                    at += 1
                rest = data[at] | data[at + 1] << 8
                at += 2
                distance = rest >> 2
                if t >= 32:
                    distance += 1
                else:
                    distance += (t & 8) << 11
                    if not distance:
                        break
                    distance += _MIDDLE
                t = rest
            elif pending:
                length, distance = (3, 1 + _NEAR) if pending == 4 else (2, 1)
                distance += (t >> 2) + (data[at] << 2)
                at += 1
            else:
                if not t:
                    t = 15
                    while not data[at]:
                        t += 255
                        at += 1
                    t += data[at]
                    at += 1
                out += data[at : at + t + 3]
                at += t + 3
                if at > end or len(out) > size:
                    raise ValueError("an LZO block is damaged")
                pending = 4
                continue
            begin = len(out) - distance
            if begin < 0 or len(out) + length > size:
                raise ValueError("an LZO block is damaged")
            if distance >= length:
                out += out[begin : begin + length]
            else:
                unit = bytes(out[begin:])
                out += (unit * (length // distance + 1))[:length]
            pending = t & 3
            if pending:
                out += data[at : at + pending]
                at += pending
                if at > end or len(out) > size:
                    raise ValueError("an LZO block is damaged")
    except IndexError:
        raise ValueError("an LZO block is cut short") from None
    if len(out) != size or at != end:
        raise ValueError("an LZO block is damaged")
    return bytes(out)


def _extended(value: int, most: int) -> bytes:
    """The rest of a length beyond its field: zeros for 255 each, then what is left, 1 to 255."""
    value -= most
    zeros = (value - 1) // 255
    return bytes(zeros) + bytes([value - 255 * zeros])


def _run(literals: bytes, first: bool) -> bytes:
    n = len(literals)
    if not n:
        return b""
    if first and n <= 238:
        return bytes([17 + n]) + literals
    return (bytes([n - 3]) if n <= 18 else b"\0" + _extended(n - 3, 15)) + literals


def _match(length: int, distance: int, following: int) -> bytes:
    if length <= 8 and distance <= _NEAR:
        return bytes([length - 1 << 5 | (distance - 1 & 7) << 2 | following, distance - 1 >> 3])
    if distance <= _MIDDLE:
        head, back = 32, distance - 1
        size = bytes([head | length - 2]) if length <= 33 else bytes([head]) + _extended(length - 2, 31)
    else:
        back = distance - _MIDDLE
        head = 16 | (back & 0x4000) >> 11
        size = bytes([head | length - 2]) if length <= 9 else bytes([head]) + _extended(length - 2, 7)
    return size + (back << 2 & 0xFFFF | following).to_bytes(2, "little")


def _links(data: bytes) -> tuple[list[int], list[int]]:
    """(the nearest earlier place with the same four bytes, or -1, for each place; places that have one)."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    keys = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    both = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order, keys = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
    same = keys[1:] == keys[:-1]
    links = np.full(len(keys), -1)
    links[order[1:][same]] = order[:-1][same]
    return links.tolist(), np.flatnonzero(links >= 0).tolist()


def compress(data: bytes) -> bytes:
    """A stream of ``data``: greedy, the nearest earlier place with the same four bytes is tried.

    Places are linked before, so only those with an earlier copy are visited; inside a long match but every few count.
    """
    out = bytearray()
    n = len(data)
    last = length = distance = 0  # the match that waits for what follows it

    def put(following: bytes) -> None:
        few = len(following)
        if not length:
            out.extend(_run(following, True))
        elif few > 3:
            out.extend(_match(length, distance, 0))
            out.extend(_run(following, False))
        elif length <= 8 and distance <= _NEAR:
            out.append(length - 1 << 5 | (distance - 1 & 7) << 2 | few)
            out.append(distance - 1 >> 3)
            out.extend(following)
        else:
            out.extend(_match(length, distance, few) + following)

    links, visit = _links(data) if n > 4 else ([], [])
    passed: set[int] = set()  # places inside long matches that are no sources
    for at in visit:
        if at < last:
            continue
        source = links[at]
        while source in passed:
            source = links[source]
        if source < 0 or at - source > _FAR:
            continue
        put(data[last:at])
        distance = at - source
        from_, to = source + 4, at + 4
        while data[from_ : from_ + 8] == data[to : to + 8] and to + 8 <= n:
            from_, to = from_ + 8, to + 8
        while to < n and data[from_] == data[to]:
            from_, to = from_ + 1, to + 1
        length, last = to - at, to
        step = length // 16
        if step > 1:
            passed.update(i for i in range(at + 1, min(last, n - 3)) if (i - at - 1) % step)
    put(data[last:])
    return bytes(out) + b"\x11\0\0"
