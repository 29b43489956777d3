"""Binary files and other captured inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name
from . import listing

# The start of a PDF file; SHA-256 of no bytes.
MAGIC = "25504446"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

RESULT_SCHEMA = "nuip string, clasificacion string, vigencia_raw string, codigo string, fecha_consulta string, http_status int, error string, timestamp_consulta string, archivo_origen string, linea_origen int"


def pdf_files(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """The binaryFile schema plus filename. Only the columns that are selected are read, so sizes cost no content.
    Zero-byte files, which that source leaves out, are in empty_pdf_files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[Pp][Dd][Ff]").load(folder)
    return found.withColumn("filename", file_name(F.col("path")))


def empty_pdf_files(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """(path, length, filename) of zero-byte files: a listing on the driver through Hadoop's file system, of which only
    the empty files are kept. For folders that only Spark can open; listing.list_files lists others in tasks."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    it = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, recursive)
    rows = []
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0 and f.getPath().getName().lower().endswith(".pdf"):
            rows.append((f.getPath().toString(), 0, f.getPath().getName()))
    return spark.createDataFrame(rows, "path string, length bigint, filename string")


def hashed(files: DataFrame) -> DataFrame:
    """(path, filename, length, sha256)."""
    return files.select("path", "filename", "length", F.sha2("content", 256).alias("sha256"))


def hashed_folder(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """(path, filename, length, sha256) of a folder's PDF files, empty ones too: listed and read in blocks by tasks, or where
    only Spark can open the folder by its own reader, and empty files by a listing on the driver."""
    if listing.in_tasks(folder):
        read = listing.hashed_paths(listing.list_files(spark, folder, recursive=recursive))
        return read.select("path", file_name(F.col("path")).alias("filename"), F.col("bytes_read").alias("length"), "sha256")
    empty = empty_pdf_files(spark, folder, recursive=recursive).withColumn("sha256", F.lit(EMPTY_SHA256))
    return hashed(pdf_files(spark, folder, recursive=recursive)).unionByName(empty.select("path", "filename", "length", "sha256"))


def is_pdf(content) -> F.Column:
    return F.substring(content, 1, 4) == F.unhex(F.lit(MAGIC))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The record of a move -> (filename, original, organized)."""
    files = "map<string,struct<original:string,organized:string>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.files"), files)).alias("filename", "e"))
    return doc.select("filename", "e.original", "e.organized")


def read_jury_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("departamento string, municipio string, ruta string, url string, local_path string").json(path, multiLine=True)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots laid out by snapshot_date=...; a filter on the date prunes folders."""
    return spark.read.option("basePath", path).parquet(path)
