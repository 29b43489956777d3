"""ID lists: text or CSV files to rows (archivo_origen, linea_origen, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_token, strip
from . import listing
from .scratch import written

#: A byte order mark in hex; splits are sent to all executors up to this many.
BOM, MOST_SENT = "EFBBBF", 50_000
# Recognised header names.
COLUMN_NAMES = ("nuip", "cedula", "documento", "cc", "identificacion")


def lines(content: DataFrame, text: str, *keep: str) -> DataFrame:
    """Rows (keep..., linea_origen from 1, line) of whole texts."""
    return content.select(*keep, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("linea_origen"), "line")


def tokens(rows: DataFrame) -> DataFrame:
    """Drops blank and # lines, keeps the first token of the others."""
    s = strip(F.col("line"))
    return rows.where((s != "") & ~s.startswith("#")).withColumn("token", first_token(F.col("line"))).drop("line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archivo_origen, linea_origen from 1, line, has_bom) of text files, a large one read by many tasks.

    A first pass counts the lines of each split of a file, and the sums over the splits before give each split its first
    number; no line is moved for that. Line ends are \\r\\n, \\r and \\n. A byte order mark is left out by the reader;
    has_bom says that line 1 began with one."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("archivo_origen"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    splits = rows.groupBy("archivo_origen", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("archivo_origen").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "splits")
    marked = splits.where("_before = 0").select("archivo_origen").distinct()
    if listing.in_tasks(path):
        marked = listing.heads(marked.select(F.col("archivo_origen").alias("path")), 3).select(F.col("path").alias("archivo_origen"), F.hex("head").alias("head"))
    else:
        marked = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("archivo_origen"), F.hex(F.substring("content", 1, 3)).alias("head"))
    splits = splits.join(marked.select("archivo_origen", (F.col("head") == BOM).alias("has_bom")), "archivo_origen")
    few = splits.count() <= MOST_SENT
    joined = rows.join(F.broadcast(splits) if few else splits, ["archivo_origen", "_start"])
    return joined.select("archivo_origen", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias("linea_origen"), "line", "has_bom")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A byte order mark stays, so the first ID of such a file is not numeric; `has_bom` warns of it."""
    rows = numbered_lines(spark, path)
    mark = F.when(F.col("has_bom") & (F.col("linea_origen") == 1), F.lit("\ufeff")).otherwise("")
    return tokens(rows.select("archivo_origen", "has_bom", "linea_origen", F.concat(mark, "line").alias("line")))


def header_column(cells: Column) -> Column:
    """The 0-based place of the first recognised name, or null."""
    at = F.array_position(F.transform(cells, lambda c: F.lower(strip(c)).isin(*COLUMN_NAMES)), True)
    return F.when(at > 0, at - 1)


# A field: quoted from its start (what follows the closing quote is kept), or plain, where quotes are ordinary.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_QUOTED}"?+[^,\r\n]*+|[^,\r\n]*+)'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r\n|\r|\n|\z)"


def csv_records(text: Column) -> Column:
    """The records of a CSV text, line breaks within quotes kept; blank lines are empty records."""
    return F.regexp_extract_all(text, F.lit(_RECORD), 1)


def csv_cells(record: Column) -> Column:
    plain = lambda c: F.concat(F.replace(F.regexp_extract(c, rf'^"([^"]*+(?:""[^"]*+)*+)"?', 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, rf"^{_QUOTED}\"([^,\r\n]*)$", 1))
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), 1), lambda c: F.when(c.startswith('"'), plain(c)).otherwise(c))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma only, a byte order mark is removed. Without a recognised header the first column counts and the first record
    is data; a short record falls back to its first cell; empty ones are skipped but numbered. linea_origen numbers
    records, not lines. A file is one row until its records are told apart, so it has to fit a task's memory."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("archivo_origen"), "value")
    return csv_tokens(files)


def csv_tokens(files: DataFrame, name: str = "archivo_origen", value: str = "value") -> DataFrame:
    """(name, linea_origen, token) of whole CSV texts."""
    files = files.select(name, csv_records(F.regexp_replace(value, "^\ufeff", "")).alias("records"))
    files = files.withColumn("place", header_column(csv_cells(F.get("records", F.lit(0)))))
    rows = files.select(name, "place", F.posexplode("records").alias("at", "record")).withColumn("linea_origen", F.col("at") + 1)
    rows = rows.where("record <> '' and not (linea_origen = 1 and place is not null)").withColumn("c", csv_cells(F.col("record")))
    return rows.select(name, "linea_origen", F.coalesce(F.get("c", F.coalesce("place", F.lit(0))), F.get("c", F.lit(0))).alias("token"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return (read_csv if path.lower().endswith(".csv") else read_text)(spark, path)
