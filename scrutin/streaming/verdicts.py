"""Verdicts over files as they arrive, against an index that has versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators import integrity
from ..operators.history import _exists
from ..sources import files, listing

_FILE = "path string, modificationTime timestamp, length long, content binary"


def newest_version(spark: SparkSession, index: str) -> str:
    """The last folder version=... of an index by name; each holds the tables that sources.index.normalize writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(index)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return max(n.removeprefix("version=") for n in names if n.startswith("version=") and _exists(spark, f"{index}/{n}/ix_dif/_SUCCESS"))


def tables(spark: SparkSession, index: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ix_hash with one owner for each hash, ix_file, ix_dif."""
    hashes, names, known = (spark.read.parquet(f"{index}/version={version}/{t}") for t in ("ix_hash", "ix_file", "ix_dif"))
    return hashes.groupBy("sha256").agg(F.min("filename").alias("filename")), names, known


def classified(spark: SparkSession, found: DataFrame, index: str, version: str) -> DataFrame:
    """found(path, length) -> path, filename, sha256, status, note, index_version: read by tasks in blocks, then classified."""
    hashed = listing.hashed_paths(found).where("sha256 is not null").select("path", file_name(F.col("path")).alias("filename"), "sha256")
    return integrity.classify(hashed, *tables(spark, index, version)).withColumn("index_version", F.lit(version))


def verify_arriving(spark: SparkSession, folder: str, index: str, out: str, checkpoint: str) -> None:
    """Classifies the PDF files that have arrived since the last run, and stops: out/batch=N holds a run's verdicts.

    The checkpoint is what has been seen. A batch notes its index version before it begins, so that one that is repeated
    after a failure is classified by the same version, and overwrites its own folder: nothing is there twice. The stream
    carries paths and sizes; contents are read by tasks in blocks, once. Empty files, which the stream's source leaves out,
    are listed at the end of each run and are out/batch=empty."""

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        noted = f"{out}_versions/batch={number}"
        if not _exists(s, f"{noted}/_SUCCESS"):
            s.createDataFrame([(newest_version(s, index),)], "version string").coalesce(1).write.mode("overwrite").parquet(noted)
        version = s.read.parquet(noted).first()["version"]
        classified(s, batch.select("path", "length"), index, version).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arriving = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[Pp][Dd][Ff]").load(folder)
    arriving.select("path", "length").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    empty = listing.list_files(spark, folder).where("length = 0").select("path", "length") if listing.in_tasks(folder) else files.empty_pdf_files(spark, folder).select("path", "length")
    classified(spark, empty, index, newest_version(spark, index)).write.mode("overwrite").parquet(f"{out}/batch=empty")


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
