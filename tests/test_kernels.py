import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longspan.functions.tags import SPAN, TAG_TABLE, rolling_tags
from longspan.operators import aes, codecs, container, digests, filters
from longspan.operators.parse import Parser, from_streams, rebuild, to_streams
from longspan.options import DELTAS, DIGESTS, FILTERS, MINIMUM_MATCH, SUPPORTED, Options, delta_code, delta_of
from longspan.sources import config

RND = random.Random(5)
NOISE = RND.randbytes(1 << 17)
FIXTURES = {
    "empty": b"",
    **{f"tiny_{n}": NOISE[:n] for n in (1, 30, 31, 32, 63, 64)},
    "zeros": bytes(200_000),
    "period_3": b"abc" * 60_000,
    "long_match": NOISE[:70_000] * 2,
    "long_literal": NOISE[:70_000],
    "far_copy": NOISE + NOISE[:50_000],
    "permuted": NOISE[:31] + bytes(40) + bytes(sorted(NOISE[:31])),
    "match_at_0": NOISE[:200] + b"-" * 50 + NOISE[:200],
    "tail_repeat": NOISE[:500] + NOISE[100:200],
    **{f"width_{n}": NOISE[:n] for n in (255, 256, 65_535, 65_536)},
    "text": b"the quick brown fox jumps over the lazy dog. " * 300 + NOISE[:100] + b"the quick brown fox " * 50,
}


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("level", (1, 6, 9))
def test_parse_and_rebuild(name, level):
    data = FIXTURES[name]
    tokens = Parser(level).tokens(data)
    at = 0
    for kind, pos, length, distance in tokens:
        assert pos == at and length > 0
        assert (length >= MINIMUM_MATCH and 0 < distance <= pos) if kind else distance == 0
        at += length
    assert at == len(data)
    control, literals = to_streams(tokens, data, 8)
    again, crc = from_streams(control, 8)
    assert all(t[2] <= 0xFFFF for t in again)
    assert rebuild(again, literals) == data and crc == zlib.crc32(data)


def test_last_span_stays_literal():
    data = NOISE[:500] + NOISE[:500]
    kind, pos, length, _ = Parser(9).tokens(data)[-1]
    assert kind == 0 and pos + length == len(data) and length >= MINIMUM_MATCH


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", NOISE[:40], NOISE[40:90], NOISE[:90]]), max_size=40), st.integers(1, 9))
def test_parse_property(parts, level):
    data = b"".join(parts)
    tokens = Parser(level).tokens(data)
    control, literals = to_streams(tokens, data, 4)
    assert rebuild(from_streams(control, 4)[0], literals) == data


def test_rolling_tags_by_definition():
    data = NOISE[:200]
    tags = rolling_tags(data)
    assert len(tags) == len(data) - SPAN + 1
    for i in range(len(tags)):
        x = 0
        for b in data[i : i + SPAN]:
            x ^= TAG_TABLE[b]
        assert x == tags[i]
    assert len(rolling_tags(data[: SPAN - 1])) == 0


def branches(name: str, size: int) -> bytes:
    b = bytearray(RND.randbytes(size))
    for i in range(0, len(b) - 8, 4):
        if RND.random() < 0.5:
            if name == "x86":
                b[i], b[i + 4] = 0xE8, RND.choice((0, 255))
            elif name == "arm":
                b[i + 3] = 0xEB
            elif name == "ppc":
                b[i], b[i + 3] = 0x48 | b[i] & 3, b[i + 3] & 0xFC | 1
            elif name == "sparc":
                b[i] = RND.choice((0x40, 0x7F))
                b[i + 1] = b[i + 1] & 0x3F if b[i] == 0x40 else b[i + 1] | 0xC0
            elif name == "arm64":
                b[i + 3], b[i + 2] = RND.choice((0x94, 0x97, 0x90, 0xB0)), RND.choice((0, 255, b[i + 2]))
            elif name == "riscv":
                b[i], b[i + 1] = RND.choice((0xEF, 0x17, 0x97)), b[i + 1] & RND.choice((0xF0, 0xFF))
    return bytes(b)


@pytest.mark.parametrize("name", [f for f in FILTERS if f not in ("none", "delta")])
def test_branch_filters_reverse(name):
    changed = 0
    for size in [*range(0, 40), *(RND.randint(40, 700) for _ in range(150))]:
        data = branches(name, size)
        there = filters.apply_filter(name, data)
        changed += there != data
        assert len(there) == len(data) and filters.apply_filter(name, there, back=True) == data
    assert changed


@pytest.mark.parametrize("name", ("arm", "ppc", "sparc"))
def test_own_filters_agree_with_the_library(name):
    for size in (0, 3, 4, 5, 64, 401):
        data = branches(name, size)
        assert filters.apply_filter(name, data) == filters.by_library(name, data, False)


def test_delta_by_definition():
    data = np.frombuffer(NOISE[:1000], np.uint8)
    for d in (1, 4, 16, 32, 256):
        want = np.array([(int(x) - (int(data[i - d]) if i >= d else 0)) % 256 for i, x in enumerate(data)], np.uint8).tobytes()
        assert filters.apply_filter("delta", data.tobytes(), d) == want
        assert filters.apply_filter("delta", want, d, back=True) == data.tobytes()
    assert [delta_of(delta_code(d)) for d in DELTAS] == list(DELTAS)


@pytest.mark.parametrize("method", SUPPORTED)
def test_codecs(method):
    for data in FIXTURES.values():
        assert codecs.decode(method, codecs.encode(method, data), len(data)) == data


def test_unsupported_codecs_say_so():
    for method in ("zpaq", "bzip3"):
        with pytest.raises(codecs.UnsupportedCodec):
            codecs.encode(method, b"x" * 100)
    assert codecs.method_string("zpaq", 7, 50) == "47,128,0"


def test_gate():
    assert codecs.compressibility(os.urandom(10_000)) == 0
    assert 1 <= codecs.compressibility(bytes(10_000)) <= 5
    assert codecs.compressibility(b"") == 0
    text = FIXTURES["text"]
    percent = codecs.compressibility(text)
    assert percent and codecs.compressibility(text, percent) in (0, percent)
    assert codecs.encode_block(b"a" * 63, Options())[0] == 3 and codecs.encode_block(b"a" * 64, Options())[0] == 6
    assert codecs.encode_block(NOISE[:5000], Options(method="gzip"))[0] == 3


@pytest.mark.parametrize("name", DIGESTS)
def test_digests(name):
    whole = digests.digest_bytes(name, NOISE)
    assert len(whole) == DIGESTS[name][1]
    parts = digests.running(name)
    for i in range(0, len(NOISE), 10_000):
        parts.update(NOISE[i : i + 10_000])
    assert parts.digest() == whole


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("options", (Options(), Options(method="zstd", filter="delta", delta=4), Options(method="bzip2", chunk_bytes=20_000, block_bytes=3000, comment="né", digest="SHAKE256_64")))
def test_archives(name, options):
    data = FIXTURES[name]
    archive = container.write_archive(data, options)
    assert container.unpack(archive) == data
    h = container.read_header(archive)
    assert (h["minor"], h["orig_size"], h["comment"]) == (14, len(data), options.comment)
    index = list(container.block_rows(archive))
    assert sum(r[8] for r in index if r[4] == 1) >= 0 and {r[4] for r in index} == {0, 1}


def header(minor: int, body: dict[int, int], note: bytes = b"") -> bytes:
    b = bytearray(container.HEADER_BYTES[minor])
    b[:6] = container.MAGIC + bytes([0, minor])
    b[6:14] = (1234).to_bytes(8, "little")
    for k, v in body.items():
        b[k] = v
    return bytes(b) + note


def test_headers_of_all_versions():
    read = container.read_header
    h = read(header(6, {16: 93, 21: 1}))
    assert (h["codec"], h["hash_code"], h["orig_size"], h["length"]) == (1, 1, 1234, 24)
    h = read(header(7, {16: 7 | 3 << 3, 17: 93, 22: 3, 23: 1}))
    assert (h["filter"], h["delta"], h["enc_code"], h["orig_size"]) == (128, 4, 1, None)
    h = read(header(8, {14: 1, 17: 0xF3}))
    assert (h["codec"], h["codec_prop"]) == (3, 3)
    h = read(header(9, {17: 0x80 | 5 << 4 | 7, 18: 0x79, 19: 2}, b"hi"))
    assert (h["codec"], h["match_level"], h["level"], h["comment"], h["length"]) == (2, 7, 9, "hi", 22)
    assert read(header(10, {17: 24}))["codec"] == 1
    assert read(header(11, {16: 2, 17: 1, 18: 20, 19: 0x77}))["filter"] == 2
    h = read(header(12, {16: 5 << 3}))
    assert (h["filter"], h["delta"]) == (128, 5)
    h = read(header(13, {16: 128 + 17, 17: 0x54, 18: 12}))
    assert (h["filter"], h["delta"], h["codec"]) == (128, 32, 0x54)
    assert read(header(14, {15: 2, 16: 8}))["salt"] == (1234).to_bytes(8, "little")


def test_damage_is_found():
    good = bytearray(container.write_archive(FIXTURES["text"], Options(method="gzip")))
    base = 21 + 2 + good[21]
    for at, value in ((0, 0), (5, 99), (21, 0), (21, 9), (base, 77), (len(good) - 1, good[-1] ^ 1)):
        bad = bytearray(good)
        bad[at] = value
        with pytest.raises(ValueError):
            container.unpack(bytes(bad))
    for cut in (3, 15, 22, 40, len(good) // 2):
        with pytest.raises(ValueError):
            container.unpack(bytes(good[:cut]))
    back = bytearray(good)
    width = good[21]
    back[base + 1 + 2 * width : base + 1 + 3 * width] = bytes(width - 1) + b"\xff" if width > 1 else b"\xff"
    with pytest.raises(ValueError):
        list(container.block_rows(bytes(back)))


def test_config_and_options():
    text = "# note\nCOMPRESSIONMETHOD = zstd # here\ncompressionlevel=5\nDelta = 32\nHashCode = sha256\nNONSENSE = 1\n"
    o = config.options_from(config.parse_config(text))
    assert (o.method, o.level, o.filter, o.delta, o.digest, o.gated) == ("zstd", 5, "delta", 32, "SHA256", False)
    for wrong in ({"level": 0}, {"method": "x"}, {"filter": "delta", "delta": 17}, {"comment": "x" * 65}, {"output": "a", "output_dir": "b"}):
        with pytest.raises(ValueError):
            Options(**wrong)


@pytest.mark.parametrize("size", (16, 32))
def test_aes_by_library_and_by_tables(monkeypatch, size):
    """OpenSSL's bytes are those of the tables; without the library the tables do it."""
    key, iv = NOISE[:size], NOISE[50:66]
    texts = [NOISE[100 : 100 + n] for n in (*range(16, 50), 1000, 4112)]
    assert aes._openssl() is not None
    fast = [aes.encrypt(x, key, iv) for x in texts]
    assert [aes.decrypt(x, key, iv) for x in fast] == texts
    monkeypatch.setattr(aes, "_openssl", lambda: None)
    assert [aes.encrypt(x, key, iv) for x in texts] == fast and [aes.decrypt(x, key, iv) for x in fast] == texts
    with pytest.raises(ValueError):
        aes.encrypt(texts[0], key[:15], iv)


@pytest.mark.parametrize("name", ("ia64", "x86", "armt"))
def test_branch_filters_against_the_library(monkeypatch, name):
    """Our IA-64 and the blocks without branches are as the library has them; these ask it for nothing."""
    blocks = [NOISE[:n] for n in range(0, 40)] + [NOISE, b"plain words, nothing like a branch " * 90, "é à ü ".encode() * 200]
    blocks += [bytes(RND.choices([0xE8, 0xE9, 0, 255, 0xF0, 0xF8, 0x12, 0x16, 5, 0xA0], k=n)) for n in range(0, 400, 7)]
    for back in (False, True):
        assert [filters.apply_filter(name, x, back=back) for x in blocks] == [filters.by_library(name, x, back) if x else x for x in blocks]
    monkeypatch.setattr(filters, "by_library", None)
    for x in (blocks[-60], "é à ü ".encode() * 200, b"plain words " * 500):
        filters.apply_filter(name, x if name == "ia64" else bytes(c & 0x7F for c in x))


@pytest.mark.parametrize("size", (0, 3_000, 78_999, 79_000, 100_000, 131_072))
def test_sizes_by_level_code_alike_levels_once(monkeypatch, size):
    data = (NOISE[: size // 2] + b"abcd" * size)[:size]
    for method in ("bzip2", "lzma", "gzip", "lzo"):
        assert codecs.sizes_by_level(method, data) == [len(codecs.encode(method, data, n)) for n in range(1, 10)]
    asked = []
    of = codecs.encode
    monkeypatch.setattr(codecs, "encode", lambda m, x, n=7: asked.append(n) or of(m, x, n))
    codecs.sizes_by_level("lzma", data), codecs.sizes_by_level("bzip2", data)
    assert len(asked) <= 3 + (1 if size < 79_000 else 2)


@pytest.mark.parametrize("name", FIXTURES)
def test_bzip2_is_that_of_its_level(name):
    import bz2

    assert all(codecs.encode("bzip2", FIXTURES[name], n) == bz2.compress(FIXTURES[name], n) for n in (1, 2, 7, 9))
