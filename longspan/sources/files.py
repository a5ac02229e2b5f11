"""Files in and out: whole-file sources, folders, packed and unpacked sinks, and CSV tables of timed runs."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from datetime import datetime
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options


def spread(df: DataFrame) -> DataFrame:
    """Small inputs that came as fewer splits than there are cores are dealt out; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES = "archive_id string, size bigint, modified timestamp, data binary"


def binary_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """``archive_id`` (the path), ``size``, ``modified``, ``data``: one row a regular file, folders walked through.

    The file source leaves out files without bytes; these come from the same listing and are added.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    full = reader.load(path).select(F.col("path").alias("archive_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("data"))
    empty = [(name, 0, when, bytearray()) for name, when in _empty_files(spark, path, recursive) if not pattern or fnmatch(os.path.basename(name), pattern)]
    return full.where("size > 0").unionAll(spark.createDataFrame(empty, FILES))


def _empty_files(spark: SparkSession, path: str, recursive: bool) -> Iterator[tuple[str, datetime]]:
    """Names and times of files of no bytes below a path or pattern; hidden ones are passed over, as by Spark."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(root) or ():
        files = fs.listFiles(found.getPath(), recursive)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if not f.getLen() and name[0] not in "._":
                yield f.getPath().toString(), datetime.fromtimestamp(f.getModificationTime() / 1000)


def as_files(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A text column taken for files: ``archive_id, data``; null texts are empty files."""
    return docs.select(F.col(key).cast("string").alias("archive_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))


def target_name(path: str, options: Options, unpack: bool = False) -> str:
    """Where the result of ``path`` goes, by the options' name, folder and suffix."""
    if options.output:
        return options.output
    name = path
    if unpack:
        name = name[: -len(options.suffix)] if name.endswith(options.suffix) else name + ".out"
    else:
        if name.endswith(options.suffix):
            raise ValueError(f"{path} has the suffix already")
        name += options.suffix
    return os.path.join(options.output_dir, os.path.basename(name)) if options.output_dir else name


def write_files(rows: DataFrame, folder: str, options: Options, unpack: bool = False) -> DataFrame:
    """Write each (archive_id, data) to ``folder`` from the tasks; returns ``archive_id, path, size``.

    A file appears under its name only when it is whole: it is written beside it first, so a lost task that runs
    again leaves nothing half done.  The folder must be one that all executors share.  Names that exist are
    refused unless ``options.replace``.
    """
    import pyarrow as pa

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                key, data = key.as_py(), data.as_py() or b""
                if os.path.realpath(_local(key)) == os.path.realpath(os.path.join(folder, os.path.basename(target_name(key, options, unpack)))):
                    raise ValueError(f"{key} would be its own result")
                path = os.path.join(folder, os.path.basename(target_name(key, options, unpack)))
                if os.path.exists(path) and not options.replace:
                    with open(path, "rb") as f:
                        if f.read() != data:  # the same bytes are an earlier attempt of this task
                            raise FileExistsError(path)
                temporary = f"{path}.{os.getpid()}.part"
                with open(temporary, "wb") as f:
                    f.write(data)
                os.replace(temporary, path)
                out.append((key, path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["archive_id", "path", "size"])

    return rows.select("archive_id", "data").mapInArrow(run, "archive_id string, path string, size bigint")


def to_stdout(rows: DataFrame, out) -> int:
    """Write ``data`` of each row, in order of ``archive_id`` and ``chunk_no`` if there, to a binary stream.

    Rows come a partition at a time, so the driver never holds all."""
    order = [c for c in ("archive_id", "chunk_no") if c in rows.columns]
    total = 0
    for r in rows.orderBy(*order).select("data").toLocalIterator():
        total += out.write(bytes(r["data"] or b""))
    return total


def write_csv(runs: DataFrame, path: str) -> None:
    """A table of timed runs as CSV with a header."""
    runs.write.mode("overwrite").option("header", True).csv(path)


def _local(path: str) -> str:
    return path.removeprefix("file:") if path.startswith("file:") else path


def copy_attributes(written: DataFrame) -> None:
    """Give results (``archive_id``, ``path``) the mode, owner where allowed, and times of their sources, from the tasks."""

    def run(rows):
        for r in rows:
            source, result = _local(r["archive_id"]), _local(r["path"])
            if os.path.isfile(source) and os.path.isfile(result):
                shutil.copystat(source, result)
                try:
                    was = os.stat(source)
                    os.chown(result, was.st_uid, was.st_gid)
                except PermissionError:  # only a privileged user gives files away
                    pass

    written.select("archive_id", "path").foreachPartition(run)


def remove_sources(written: DataFrame, options: Options) -> None:
    """Delete inputs (``archive_id``) whose results (``path``) exist, if asked to; folders and results are never deleted."""
    if not options.delete:
        return

    def run(rows):
        for r in rows:
            source, result = _local(r["archive_id"]), _local(r["path"])
            if os.path.isfile(result) and os.path.isfile(source) and not os.path.samefile(source, result):
                os.unlink(source)

    written.select("archive_id", "path").foreachPartition(run)
