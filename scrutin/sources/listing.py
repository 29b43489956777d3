"""Files listed and read by tasks: folders level by level, contents in blocks, so that neither the driver nor a task holds a
listing or a file.

Tasks open files through Arrow's file systems (a mounted folder, hdfs, s3, gs, abfs). What only Spark's own readers can
open (`in_tasks` says so) goes through `files.pdf_files`, whose contents are limited to 2 GB a file."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: Bytes that a task reads at once; bytes of files that a task gets, about.
BLOCK, BATCH = 1 << 20, 4 << 30


def file_system(path: str):
    """The file system of a path and the path there: a URI, or a local path with or without file:."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)
    return fs.LocalFileSystem(), local


def in_tasks(path: str) -> bool:
    """Whether tasks can open the path."""
    try:
        file_system(path)
        return True
    except (ValueError, OSError, NotImplementedError):
        return False


def _named(folder: str) -> str:
    """A folder as the prefix of its files' paths: local ones begin with file:/."""
    return folder.rstrip("/") if "://" in folder and not folder.startswith("file:") else f"file:{file_system(folder)[1].rstrip('/')}"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What folders hold, a level deep. Links to folders are not followed, so a loop of links ends."""
    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])

    def local(at: str) -> Iterator[tuple]:
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, 0, True
                elif e.is_file():
                    yield e.name, e.stat().st_size, False

    def remote(system, at: str) -> Iterator[tuple]:
        for e in system.get_file_info(fs.FileSelector(at)):
            yield e.base_name, e.size or 0, e.type == fs.FileType.Directory

    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, at = file_system(folder)
            rows: list[tuple] = []
            for name, length, is_folder in local(at) if isinstance(system, fs.LocalFileSystem) else remote(system, at):
                rows.append((f"{folder}/{name}", length, is_folder))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def list_files(spark: SparkSession, folder: str, *, recursive: bool = True, suffix: str = ".pdf") -> DataFrame:
    """(path, filename, length) of the files whose names end so, in any ASCII case; empty files and hidden ones too.

    A level of folders is a job whose tasks list them; the driver sees whether there is another level. An empty folder has
    no rows; one that is absent is an error."""
    level, found = spark.createDataFrame([(_named(folder),)], "folder string"), None
    while True:
        spread = level.repartition(spark.sparkContext.defaultParallelism)
        entries = written(spread.mapInArrow(_entries, "path string, length long, is_folder boolean"), "entries")
        found = entries if found is None else found.unionByName(entries)
        level = entries.where("is_folder").select(F.col("path").alias("folder"))
        if not recursive or level.isEmpty():
            break
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~F.col("is_folder") & F.lower(name).endswith(suffix.lower())).select("path", name.alias("filename"), "length")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            sha, size, head = hashlib.sha256(), 0, b""
            try:
                system, at = file_system(path)
                with system.open_input_stream(at) as f:
                    while block := f.read(BLOCK):
                        sha.update(block)
                        head = head if size else block[:4]
                        size += len(block)
                rows.append((path, sha.hexdigest(), size, head, None))
            except OSError as e:
                rows.append((path, None, size, None, str(e)[:200]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()))], names=["path", "sha256", "bytes_read", "head", "error"])


def hashed_paths(files: DataFrame) -> DataFrame:
    """files(path, length?) -> (path, sha256, bytes_read, head, error): only these files are opened, each read once in blocks,
    whatever its size. head is its first four bytes. A file that can't be read has an error and no hash. Repeated paths are
    read once; a null path has no row."""
    sizes = files.where("path is not null").groupBy("path").agg(F.max("length" if "length" in files.columns else F.lit(0)).alias("length"))
    sizes = written(sizes, "paths")
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(files.sparkSession.sparkContext.defaultParallelism, total // BATCH)
    return sizes.select("path").repartition(n, "path").mapInArrow(_hashes, "path string, sha256 string, bytes_read long, head binary, error string")


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, read by a task in blocks; what progress is valid for."""
    if not in_tasks(path):
        return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    row = hashed_paths(spark.createDataFrame([(path,)], "path string")).first()
    if row["error"]:
        raise OSError(row["error"])
    return row["sha256"]


def heads(paths: DataFrame, n: int) -> DataFrame:
    """paths(path, percent-encoded as _metadata has it) -> (path, head): the first n bytes, of which no more is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, at = file_system(unquote(path))
                with system.open_input_stream(at, buffer_size=None) as f:
                    found.append(f.read(n))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.binary())], names=["path", "head"])

    return paths.mapInArrow(read, "path string, head binary")
