import io
import os

import pytest
from pyspark.sql import functions as F

from longspan.functions import scalars as S
from longspan.operators import chunks, codecs, container, crypto, digests, filters, matches, parse, report
from longspan.options import Options
from longspan.sources import config, files
from longspan.streaming.chunks import chunk_stream, running_totals


def bin_rows(spark, *data):
    return spark.createDataFrame([(str(i), bytearray(x) if x is not None else None) for i, x in enumerate(data)], "archive_id string, data binary")


def test_chunks_of_edge_sizes(spark):
    got = {(r.archive_id, r.chunk_no): r for r in chunks.cut(bin_rows(spark, b"", b"x" * 10, b"x" * 11, None), 10).collect()}
    assert set(got) == {("0", 0), ("1", 0), ("2", 0), ("2", 1)}
    assert got["0", 0].eof and got["1", 0].eof and not got["2", 0].eof and got["2", 1].chunk_size == 1


def test_empty_tables(spark):
    none = bin_rows(spark, b"x").where("false")
    cut = chunks.cut(none, 10)
    for df in (cut, parse.parse_chunks(cut), parse.parse_stats(cut), container.archives(none), container.blocks(none), container.unpacked(none), digests.digest_of_chunks(cut)):
        assert df.count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert matches.coverage(docs).count() == matches.match_runs(docs).count() == 0


def brute_coverage(rows, width=31):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        covered = set()
        for i in range(len(text) - width + 1):
            if (g := text[i : i + width]) in seen:
                covered.update(range(i, i + width))
            seen.add(g)
        if covered:
            out[key] = len(covered)
    return out


def test_coverage_against_brute_force(spark):
    a = "abcdefghij" * 9
    rows = [(1, a[:60] + "é" * 40), (2, "x" + a[3:50] + "yz" + "é" * 33), (3, "short"), (4, ""), (5, "z" * 200), (6, a[:60] + "é" * 40)]
    df = spark.createDataFrame([*rows, (7, None), (None, a)], "doc_id bigint, text string")
    assert {r.doc_id: r.covered_chars for r in matches.coverage(df).collect()} == brute_coverage(rows)


def test_runs_are_maximal_and_true(spark):
    rows = {1: "0123456789" * 5 + "A" + "qwertyuiopasdfghjklzxcvbnm" * 2, 2: "--" + "0123456789" * 5 + "B" + "qwertyuiopasdfghjklzxcvbnm" * 2}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    found = matches.match_runs(df).collect()
    assert found
    for r in found:
        a = rows[r.doc_id][r.pos - 1 : r.pos - 1 + r.length]
        assert len(a) == r.length and a == rows[r.source_doc][r.source_pos - 1 : r.source_pos - 1 + r.length]


def test_sampled_anchor_matches_find_shared_passages(spark):
    shared = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(400))
    left = spark.createDataFrame([(1, "left " + shared), (2, "nothing of the kind here at all, nothing whatever")], "doc_id bigint, text string")
    right = spark.createDataFrame([(9, shared + " right")], "doc_id bigint, text string")
    assert {(r.doc_id, r.source_doc) for r in matches.anchor_matches(left, right).collect()} == {(1, 9)}


def test_column_codecs_and_filters(spark):
    df = bin_rows(spark, b"", b"abc" * 100, os.urandom(500), None)
    for method in ("bzip2", "gzip", "lzma", "zstd"):
        again = codecs.decoded(codecs.coded(F.col("data"), method), F.octet_length("data"), method)
        assert df.where("data IS NOT NULL").select((again == F.col("data")).alias("same")).where("NOT same").count() == 0
    for name in ("delta", "arm64", "x86"):
        again = filters.filtered(filters.filtered(F.col("data"), name, 3), name, 3, back=True)
        assert df.where(again != F.col("data")).count() == 0
    with pytest.raises(codecs.UnsupportedCodec):
        codecs.coded(F.col("data"), "zpaq")


def test_aes_of_all_lengths(spark):
    df = bin_rows(spark, *(os.urandom(n) for n in (*range(16, 50), 64, 1000)))
    for size in (16, 32):
        key, iv = F.lit(bytearray(os.urandom(size))), F.lit(bytearray(os.urandom(16)))
        rows = df.select("data", crypto.encrypt(F.col("data"), key, iv).alias("c")).select("data", "c", crypto.decrypt(F.col("c"), key, iv).alias("again")).collect()
        assert all(r.data == r.again and len(r.c) == len(r.data) and r.c != r.data for r in rows)


def test_key_schedule():
    hashed = crypto.stretch(b"password", b"saltsalt", 10)
    assert len(hashed) == 64 and hashed != crypto.stretch(b"password", b"saltsalu", 10)
    for size in (16, 32):
        key, iv = crypto.key_and_iv(hashed, b"blocksal", b"saltsaltpassword", size)
        assert (len(key), len(iv)) == (size, 16)
        assert crypto.key_and_iv(hashed, b"blocksam", b"saltsaltpassword", size)[0] != key


def test_archive_tables(spark):
    df = bin_rows(spark, b"", b"hello " * 5000, os.urandom(3000))
    packed = container.packed(df, Options(method="gzip", chunk_bytes=9000, block_bytes=2000))
    same = container.unpacked(packed).withColumnRenamed("data", "again").join(df, "archive_id")
    assert same.where("again = data AND error IS NULL").count() == 3
    broken = packed.withColumn("data", F.substring("data", F.lit(1), F.lit(30)))
    assert container.unpacked(broken).where("error IS NOT NULL").count() == 3
    assert container.blocks(broken).where("error IS NOT NULL").count() == 3
    summary = {r.archive_id: r for r in report.archive_summary(container.blocks(packed)).collect()}
    assert summary["1"].original == 30_000 and summary["1"].n_chunks == 4 and summary["1"].ratio > 5
    assert report.misordered(container.blocks(packed)).count() == 0


def test_block_copies_and_digests(spark):
    cut = chunks.cut(bin_rows(spark, b"a" * 30, b"a" * 10 + b"b" * 5), 10)
    copies = chunks.numbered_copies(cut, F.md5("data"), ["archive_id", "chunk_no"]).collect()
    assert sorted((r.copies, r.copy_no) for r in copies) == [(1, 1), (4, 1), (4, 2), (4, 3), (4, 4)]
    whole = {r.archive_id: r.digest for r in digests.digest_of_chunks(cut, "SHA3_256").collect()}
    assert whole["0"] == digests.digest_bytes("SHA3_256", b"a" * 30).hex()


def test_little_endian(spark):
    df = bin_rows(spark, bytes([1, 2, 0, 255, 7, 0, 0, 0, 0]))
    r = df.select(S.little_endian(F.col("data"), 0, F.lit(2)).alias("a"), S.little_endian(F.col("data"), 3, F.lit(3)).alias("b"), S.little_endian(F.col("data"), 0, F.lit(8)).alias("c")).first()
    assert (r.a, r.b, r.c) == (513, 255 + 7 * 256, int.from_bytes(bytes([1, 2, 0, 255, 7, 0, 0, 0]), "little"))


def test_files_round_trip(spark, tmp_path):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    (source / "a.txt").write_bytes(b"hello " * 1000)
    (tmp_path / "in" / "b.bin").write_bytes(os.urandom(500))
    o = Options(method="gzip", output_dir=str(tmp_path / "out"))
    rows = files.binary_files(spark, str(tmp_path / "in"))
    assert rows.count() == 2
    written = files.write_files(container.packed(rows, o), str(tmp_path / "out"), o).collect()
    assert sorted(os.path.basename(r.path) for r in written) == ["a.txt.lsp", "b.bin.lsp"]
    back = container.unpacked(files.binary_files(spark, str(tmp_path / "out")))
    files.write_files(back, str(tmp_path / "again"), Options(), unpack=True).collect()
    assert (tmp_path / "again" / "a.txt").read_bytes() == b"hello " * 1000
    (tmp_path / "again" / "a.txt").write_bytes(b"other")
    with pytest.raises(Exception, match="FileExistsError"):
        files.write_files(back, str(tmp_path / "again"), Options(), unpack=True).collect()
    out = io.BytesIO()
    assert files.to_stdout(chunks.cut(bin_rows(spark, b"abcdefghij" * 3), 7), out) == 30 and out.getvalue() == b"abcdefghij" * 3
    with pytest.raises(ValueError):
        files.target_name("x.lsp", Options())


def test_config_table_and_csv(spark, tmp_path):
    path = tmp_path / "c.conf"
    path.write_text("# c\nSUFFIX = .x # y\nTHRESHOLD=90\n")
    assert {r.key: r.value for r in config.config_rows(spark, str(path)).collect()} == {"suffix": ".x", "threshold": "90"}
    runs = spark.createDataFrame([("a", 1, 100, 50, 1.0, 0.5), ("b", 1, 100, 25, 4.0, 0.5)], "method string, level int, input_size bigint, packed_size bigint, pack_s double, unpack_s double")
    files.write_csv(report.speed_rows(runs), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert [round(r.overall_index, 3) for r in report.ranked(runs).orderBy("method").collect()] == [62.5, 75.0]


def test_stream_of_files_equals_batch(spark, tmp_path):
    source = tmp_path / "stream"
    for part in range(3):
        bin_rows(spark, *(bytes([part]) * n for n in (0, 5, 23))).withColumn("archive_id", F.concat(F.lit(f"{part}-"), "archive_id")).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = chunk_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 10)
    query = stream.writeStream.format("memory").queryName("chunks_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = chunk_stream(spark.read.parquet(str(source)), 10)
    assert sorted(map(tuple, spark.table("chunks_seen").collect())) == sorted(map(tuple, batch.collect()))
    totals = running_totals(stream).writeStream.format("memory").queryName("totals_seen").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination()
    assert {(r.archive_id, r.n_bytes) for r in spark.table("totals_seen").collect()} == {(f"{p}-{i}", n) for p in range(3) for i, n in enumerate((0, 5, 23))}
