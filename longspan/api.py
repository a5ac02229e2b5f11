"""Whole runs over files: compress, decompress, test and list archives, as tables of what was done.

Each call takes a path, a folder (walked) or a pattern, works on every regular file in a task of its own and returns one
row a file.  ``python -m longspan`` is the same from a command line.
"""

from __future__ import annotations

import os
import tarfile
from dataclasses import replace
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import container, digests
from .options import Options
from .sources.files import binary_files, copy_attributes, remove_sources, write_files
from .sources.shared import materialise


def _archives(spark: SparkSession, path: str, options: Options) -> DataFrame:
    pattern = f"*{options.suffix}" if os.path.isdir(path) else None
    return binary_files(spark, path, pattern=pattern)


def compress(spark: SparkSession, path: str, folder: str, options: Options | None = None, password: bytes | None = None, check: bool = False) -> DataFrame:
    """``archive_id, path, size, orig_size``: an archive in ``folder`` of every file, with its mode, owner and times.

    ``check`` reads each archive back after it was written and compares its digest with the source's.  Sources go if the
    options say so and everything else went well.
    """
    options = options or Options()
    files = binary_files(spark, path).where(~F.col("archive_id").endswith(options.suffix))
    sizes = files.select("archive_id", F.col("size").alias("orig_size"))
    written = materialise(write_files(container.packed(files, options, password), folder, options).join(sizes, "archive_id"), "written")
    if check or options.check:
        wrong = verify(spark, written, password).where("NOT same").head(1)
        if wrong:
            raise container.DamagedArchive(f"{wrong[0]['path']} doesn't hold what was packed")
    copy_attributes(written)
    if options.delete:
        remove_sources(written, options)
    return written


def verify(spark: SparkSession, written: DataFrame, password: bytes | None = None) -> DataFrame:
    """``archive_id, path, same``: whether each archive of ``compress``, read back, has the digest of its source."""
    digest = digests.digest(F.col("data"), "SHA256")
    folder = os.path.dirname(written.head()["path"]) if written.head(1) else None
    if folder is None:
        return written.select("archive_id", "path", F.lit(True).alias("same"))
    back = container.unpacked(binary_files(spark, folder, recursive=False), password)
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    back = back.select(plain("archive_id").alias("path"), digest.alias("found"))
    sources = [r["archive_id"] for r in written.select("archive_id").distinct().limit(2).collect()]
    root = os.path.commonpath([os.path.dirname(x.split(":", 1)[-1]) for x in sources])
    own = binary_files(spark, root).select("archive_id", digest.alias("wanted")).join(written.select("archive_id"), "archive_id", "left_semi")
    joined = written.select("archive_id", plain("path").alias("path")).join(own, "archive_id").join(back, "path", "left")
    return joined.select("archive_id", "path", F.coalesce(F.col("found") == F.col("wanted"), F.lit(False)).alias("same"))


def decompress(spark: SparkSession, path: str, folder: str, options: Options | None = None, password: bytes | None = None) -> DataFrame:
    """``archive_id, path, size, error``: the files of every archive, in ``folder``.

    A damaged archive leaves no file, unless ``keep_broken``: then what could be read of it.
    """
    options = options or Options()
    found = materialise(container.unpacked(_archives(spark, path, options), password, options.keep_broken), "unpacked")
    written = materialise(write_files(found.where("data IS NOT NULL"), folder, options, unpack=True), "written")
    copy_attributes(written)
    if options.delete:
        remove_sources(written.join(found.where("error IS NULL").select("archive_id"), "archive_id", "left_semi"), options)
    return found.select("archive_id", "error").join(written, "archive_id", "left").select("archive_id", "path", "size", "error")


def test(spark: SparkSession, path: str, options: Options | None = None, password: bytes | None = None) -> DataFrame:
    """``archive_id, size, ok, error``: whether each archive can be read in full, without writing anything."""
    found = container.unpacked(_archives(spark, path, options or Options()), password)
    return found.select("archive_id", F.octet_length("data").cast("bigint").alias("size"), F.col("error").isNull().alias("ok"), "error")


def info(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """The header of each archive with its ratio."""
    rows = container.archives(_archives(spark, path, options or Options()))
    return rows.withColumn("ratio", F.col("orig_size") / F.nullif("archive_size", F.lit(0)))


def compress_folder(folder: str, options: Options | None = None, password: bytes | None = None) -> bytes:
    """One archive of a folder, its files in a tar in between, for folders that fit a task."""
    out = BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        tar.add(folder, os.path.basename(os.path.normpath(folder)))
    return container.write_archive(out.getvalue(), options or Options(), password)


def extract_folder(archive: bytes, folder: str, password: bytes | None = None) -> list[str]:
    """The names of what a folder's archive was unpacked to; nothing outside ``folder`` is written."""
    with tarfile.open(fileobj=BytesIO(container.unpack(archive, password))) as tar:
        tar.extractall(folder, filter="data")
        return tar.getnames()


def with_defaults(settings: dict[str, str], **more) -> Options:
    """Options of an option file with some of them replaced; see ``sources.config``."""
    from .sources.config import options_from

    return replace(options_from(settings), **more)
