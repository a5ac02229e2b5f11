import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from longspan import __main__ as command
from longspan import api
from longspan.operators import aes, chunks, codecs, container, crypto, digests, filters, lzo, matches, suffixes
from longspan.options import Options
from longspan.sources import config, shared

RND = random.Random(4)


def texts(n=5):
    words = [f"word{i}" for i in range(50)]
    return [(" ".join(RND.choice(words) for _ in range(RND.randint(0, 3_000)))).encode() for _ in range(n)] + [b"", b"x"]


def test_aes_vectors():
    """FIPS-197, appendix C, and the standard's CBC example."""
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert aes.encrypt(plain, bytes(range(size)), bytes(16)).hex() == want
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    two = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    assert aes.encrypt(two, key, iv).hex() == "5086cb9b507219ee95db113a917678b2" + "7649abac8119b246cee98e9b12e9197d"  # the last two change places


def test_aes_is_that_of_columns(spark):
    rows = [(i, os.urandom(16 + i * 7), os.urandom(32 if i % 2 else 16), os.urandom(16)) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, data binary, key binary, iv binary")
    got = {r.i: (bytes(r.c), bytes(r.d)) for r in df.withColumn("c", crypto.encrypt(F.col("data"), F.col("key"), F.col("iv"))).withColumn("d", crypto.decrypt(F.col("c"), F.col("key"), F.col("iv"))).collect()}
    for i, data, key, iv in rows:
        sealed = aes.encrypt(data, key, iv)
        assert got[i] == (sealed, data) and aes.decrypt(sealed, key, iv) == data
    with pytest.raises(ValueError):
        aes.encrypt(b"short", bytes(16), bytes(16))


def test_lzo_round_trip_and_vectors():
    assert lzo.decompress(bytes([17 + 5]) + b"hello" + b"\x11\0\0", 5) == b"hello"
    # a run of four, a match of 4 at distance 1 in the 2 KB form, the end
    assert lzo.decompress(b"\x15aaaa" + bytes([3 << 5, 0]) + b"\x11\0\0", 8) == b"a" * 8
    for n in (0, 1, 3, 4, 18, 19, 238, 239, 700, 70_000):
        for data in (os.urandom(n), b"ab" * (n // 2), os.urandom(n // 2 + 1) * 2):
            assert lzo.decompress(lzo.compress(data), len(data)) == data
    far = os.urandom(500) + bytes(40_000) + os.urandom(9)
    far += far[:400]
    packed = lzo.compress(far)
    assert lzo.decompress(packed, len(far)) == far and len(packed) < 1_500
    for damaged in (packed[:-1], packed[:50], packed + b"\0", b"", b"\x40\0\x11\0\0"):
        with pytest.raises(ValueError):
            lzo.decompress(damaged, len(far))


@pytest.mark.parametrize("cipher", ("AES128", "AES256"))
@pytest.mark.parametrize("method", ("none", "lzo", "lzma", "zstd"))
def test_encrypted_archives(method, cipher):
    o = Options(method=method, cipher=cipher, cost=3, chunk_bytes=6_000, block_bytes=900, digest="SHA512", filter="delta" if method == "zstd" else "none", delta=4 if method == "zstd" else 0)
    for data in texts():
        sealed = container.write_archive(data, o, b"secret")
        h = container.read_header(sealed)
        assert h["enc_code"] == {"AES128": 1, "AES256": 2}[cipher] and h["orig_size"] is None and h["salt"][0] == 3
        assert container.unpack(sealed, b"secret") == data
        assert data[:40] not in sealed or len(data) < 4
        for password, error in ((None, "encrypted"), (b"wrong", "")):
            found, e = container.salvage(sealed, password)
            assert found != data or not data
            assert error in str(e)
        plain = list(container.block_rows(sealed, h, container.lock_of(h, b"secret")))
        assert sum(r[8] for r in plain if r[4] == 1) <= len(data)
    with pytest.raises(ValueError):
        container.write_archive(b"x", o)
    with pytest.raises(ValueError):
        container.write_archive(b"x", Options(cipher="AES128", digest="CRC"), b"secret")


def test_what_is_kept_of_damaged_archives():
    data = b"".join(texts(20))
    o = Options(method="gzip", chunk_bytes=5_000, digest="SHA256")
    good = container.write_archive(data, o)
    for _ in range(60):
        bad = bytearray(good)
        bad[RND.randrange(30, len(bad))] ^= 1 << RND.randrange(8)
        found, error = container.salvage(bytes(bad))
        assert error is None and found == data or error is not None and (data.startswith(found) or len(found) % 5_000 == 0)
    found, error = container.salvage(good[: len(good) // 2])
    assert error is not None and data.startswith(found)
    with pytest.raises(container.DamagedArchive):
        container.unpack(good[:-1])


def test_runs_over_a_folder(spark, tmp_path):
    source, packed, out = tmp_path / "in", tmp_path / "packed", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    files = {f"a{i}.txt": x for i, x in enumerate(texts(4))}
    for k, (name, data) in enumerate(files.items()):
        path = source / ("sub" if k == 1 else "") / name
        path.write_bytes(data)
        os.chmod(path, 0o640)
        os.utime(path, (1_000_000_000, 1_100_000_000))
    o = Options(method="zstd", level=3, chunk_bytes=4_000)
    done = api.compress(spark, str(source), str(packed), o, check=True).collect()
    assert sorted(os.listdir(packed)) == sorted(f"{n}.lsp" for n in files) and {r.orig_size for r in done} == {len(x) for x in files.values()}
    assert all(os.stat(packed / f"{n}.lsp").st_mtime == 1_100_000_000 and os.stat(packed / f"{n}.lsp").st_mode & 0o777 == 0o640 for n in files)
    assert all(r.ok and r.size == len(files[os.path.basename(r.archive_id)[:-4]]) for r in api.test(spark, str(packed), o).collect())
    assert {r.orig_size for r in api.info(spark, str(packed), o).collect()} == {len(x) for x in files.values()}
    with pytest.raises(Exception, match="(?i)exists"):
        (packed / "a0.txt.lsp").write_bytes(b"other")
        api.compress(spark, str(source), str(packed), o).collect()
    back = {r.archive_id.rsplit("/", 1)[1]: r for r in api.decompress(spark, str(packed), str(out), o).collect()}
    assert back["a0.txt.lsp"].error == "not an archive" and not (out / "a0.txt").exists()
    assert all((out / n).read_bytes() == x for n, x in files.items() if n != "a0.txt")
    cut = (packed / "a1.txt.lsp").read_bytes()[:-1]
    (packed / "a1.txt.lsp").write_bytes(cut)
    broken = tmp_path / "broken"
    kept = {r.archive_id.rsplit("/", 1)[1]: r for r in api.decompress(spark, str(packed), str(broken), Options(keep_broken=True)).collect()}
    assert kept["a1.txt.lsp"].error and files["a1.txt"].startswith((broken / "a1.txt").read_bytes())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("LONGSPAN", "NOCONFIG")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_bytes(b"one text " * 300)
    run = lambda *a: command.main([str(x) for x in a], spark)
    assert run(tmp_path / "in", "-O", tmp_path / "p", "-m", "gzip", "-L", 5, "-e", "--password", "pw", "-H", "SHA256", "-c", "-D") == 0
    assert not (tmp_path / "in" / "one.txt").exists()
    assert run("-t", tmp_path / "p", "--password", "pw") == 0 and "ok=True" in capsys.readouterr().out
    assert run("-t", tmp_path / "p") == 1 and run("-i", tmp_path / "p") == 0
    assert "enc_code=1" in capsys.readouterr().out
    assert run("-d", tmp_path / "p", "-O", tmp_path / "o", "--password", "pw") == 0
    assert (tmp_path / "o" / "one.txt").read_bytes() == b"one text " * 300


def test_folders_through_tar(tmp_path):
    (tmp_path / "tree" / "deep").mkdir(parents=True)
    (tmp_path / "tree" / "deep" / "f").write_bytes(b"f" * 5_000)
    (tmp_path / "tree" / "empty").write_bytes(b"")
    whole = api.compress_folder(str(tmp_path / "tree"), Options(method="zstd"))
    assert "tree/deep/f" in api.extract_folder(whole, str(tmp_path / "again"))
    assert (tmp_path / "again" / "tree" / "deep" / "f").read_bytes() == b"f" * 5_000


def test_option_files():
    read = lambda text: config.options_from(config.parse_config(text))
    o = read("HASH = 5\nencrypt = yes\nCOSTFACTOR=9 # log2\nhashcheck = YES\nwindow = 20\nprocessors = 4\nnice=10\nkeepbroken=yes\nmatchlevel=3\ncompressionmethod=lzo\ndictionarysize=20\n")
    assert (o.digest, o.cipher, o.cost, o.check, o.chunk_bytes, o.keep_broken, o.match_level, o.method, o.dictionary) == ("SHA512", "AES128", 9, True, 2_000_000_000, True, 3, "lzo", 20)
    assert read("unlimited=yes\nwindow=3").chunk_bytes == config.UNLIMITED == read("window=3\nunlimited=yes").chunk_bytes
    assert read("hash=yes\nencrypt=2").digest == "MD5" and read("encrypt=2").cipher == "AES256" and read("encrypt=no\nhash=no").cipher == "NONE"
    assert read("lzotest=no").threshold == 0 and read("compressionmethod=matches").method == "none"
    for wrong in ("dictionarysize=41", "compressionlevel=0", "hash=99", "processors=many"):
        with pytest.raises(ValueError):
            read(wrong)


def test_own_codecs(spark):
    codecs.register("reversed", lambda data, level: data[::-1], lambda data, size: data[::-1])
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "data binary")
    coded = df.select(codecs.coded(F.col("data"), "reversed").alias("c"))
    assert [r.c and bytes(r.c) for r in coded.collect()] == [b"cba", None]
    assert codecs.decode("reversed", b"cba", 3) == b"abc" and codecs.registered("reversed")
    with pytest.raises(ValueError):
        codecs.register("gzip", None, None)
    with pytest.raises(codecs.UnsupportedCodec):
        codecs.coded(F.col("data"), "zpaq")


def test_suffixes_by_definition():
    for k in range(200):
        data = bytes(RND.choice(b"ab") if k % 2 else RND.randrange(256) for _ in range(RND.randrange(50)))
        assert suffixes.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        coded, index = suffixes.bwt(data)
        rotations = sorted([*range(len(data) + 1)], key=lambda i: data[i:])
        assert coded == bytes(data[i - 1] for i in rotations if i) and rotations[index] == 0 or not data
        assert suffixes.unbwt(coded, index) == data
    assert suffixes.bwt(b"banana") == (b"annbaa", 4)
    with pytest.raises(ValueError):
        suffixes.unbwt(b"abc", 4)


def test_digest_tree_by_definition(spark):
    data = [os.urandom(RND.randrange(20)) for _ in range(70)]
    rows = spark.createDataFrame([("a", i, bytearray(x)) for i, x in enumerate(data)], "archive_id string, chunk_no int, data binary")
    # three levels of four, and the root over what is left
    assert digests.digest_tree(rows, fan=4).first()["digest"] == hashlib.md5("".join(_three(data)).encode()).hexdigest()
    assert digests.digest_tree(rows.where("false")).count() == 0


def _three(data):
    level = [hashlib.md5(x).hexdigest() for x in data]
    for _ in range(3):
        level = [hashlib.md5("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    return level


def test_copies_of_a_hot_block(spark):
    rows = spark.createDataFrame([(str(i).zfill(4), 0, bytearray(b"same" if i % 3 else bytes([i % 7]))) for i in range(900)], "archive_id string, chunk_no int, data binary")
    got = chunks.numbered_copies(rows, F.md5("data"), ["archive_id", "chunk_no"]).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: (r.archive_id, r.chunk_no)):
        seen.setdefault(r.digest, []).append((r.copy_no, r.copies))
    assert len(got) == 900 and len(seen) == 8
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) and {c for _, c in v} == {len(v)} for v in seen.values())


def test_shared_folder_is_asked_for(spark):
    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_global_matches_with_and_without_the_bitmap(spark, monkeypatch):
    passage = "a passage of more than thirty-one characters that both sides hold"
    left = spark.createDataFrame([(1, "x" * 50 + passage), (2, "nothing"), (3, None), (None, passage)], "doc_id bigint, text string")
    right = spark.createDataFrame([(9, passage + " and more"), (8, "else" * 20)], "doc_id bigint, text string")
    run = lambda: sorted(map(tuple, matches.anchor_matches(left, right, bits=0).collect()))
    once = run()
    assert once == [(1, 9, len(passage) - 30)]
    monkeypatch.setattr(matches, "bitmap_of", lambda grams: None)
    assert run() == once


def test_branch_filters_encode_as_published():
    """Branch targets become absolute: words worked out by hand from the instruction formats."""
    # ARM64: BL +0x1000 at offset 8 -> target (8 + 0x1000) >> 2 in the low 26 bits
    nop, bl = (0xD503201F).to_bytes(4, "little"), (0x94000000 | 0x1000 >> 2).to_bytes(4, "little")
    coded = filters.apply_filter("arm64", nop * 2 + bl + nop * 8)
    assert int.from_bytes(coded[8:12], "little") == 0x94000000 | (8 + 0x1000) >> 2
    # ARM: BL at offset 4; the word's offset counts from two instructions on
    bl = (0xEB000000 | 0x40).to_bytes(4, "little")
    coded = filters.apply_filter("arm", bytes(4) + bl + bytes(24))
    assert int.from_bytes(coded[4:8], "little") == 0xEB000000 | (0x40 * 4 + 4 + 8) >> 2
    # RISC-V: JAL ra, +8 at offset 0 keeps its opcode byte and its length
    jal = (0x008000EF).to_bytes(4, "little")
    coded = filters.apply_filter("riscv", jal + (0x13).to_bytes(4, "little") * 8)
    assert len(coded) == 36 and coded[0] == 0xEF and filters.apply_filter("riscv", coded, back=True)[:4] == jal
