"""Sinks: result logs, derived tables, progress, extracted tables as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stem, strip
from ..operators.ids import as_text
from ..operators.tables import clean_rows, table_csv
from ..sources.listing import file_system


def write_results(rows: DataFrame, path: str, *, append: bool = True) -> None:
    """All columns as text with a header and CRLF line ends."""
    as_text(rows).write.mode("append" if append else "overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').csv(path)


def rebuild_slice(results: DataFrame, path: str, value: str = "FALLECIDO") -> int:
    """Overwrites a derived table with one class and returns its rows, counted from what was written."""
    results.where(F.col("clasificacion") == value).write.mode("overwrite").parquet(path)
    return results.sparkSession.read.parquet(path).count()


def save_progress(rows: DataFrame, path: str) -> None:
    """(mode, key, bucket, input_sha256, updated_at): only the modes in `rows` are replaced, atomically per partition."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(path)


def drop_progress(spark: SparkSession, path: str, mode: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mode={mode}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_table_files(tables: DataFrame, path: str) -> None:
    """tables(stem, n, rows): one text file per table under stem=.../n=.... Rows of a table are one row here, so each
    file is written by one task."""
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).where(F.size("rows") > 0)
    t.select("stem", "n", table_csv(F.col("rows")).alias("value")).write.mode("overwrite").partitionBy("stem", "n").text(path)


def write_named(files: DataFrame, folder: str) -> None:
    """files(name, text): one UTF-8 file under `folder` for each row, by exactly that name (folders in it are made), each
    written by the task that has the row: aside first and then renamed, so no file is ever half there, and a repeated task
    writes the same again. Names that would leave the folder are refused."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = file_system(folder)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if not name or name.startswith("/") or {"", ".", ".."} & set(name.split("/")):
                    raise ValueError(f"not a name within the folder: {name!r}")
                path = f"{base}/{name}"
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    to.create_dir(parent, recursive=True)
                    made.add(parent)
                aside = f"{parent}/.{uuid.uuid4().hex}"
                with to.open_output_stream(aside) as out:
                    out.write(text.encode("utf-8"))
                to.move(aside, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["files"])

    files.select("name", "text").mapInArrow(put, "files long").write.format("noop").mode("overwrite").save()


def write_csv_files(tables: DataFrame, folder: str, doc: str = "doc") -> None:
    """tables(doc, page, ord, rows): each meaningful table as {doc's stem}/tabla{N}.csv, numbered over the document."""
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).where(F.size("rows") > 0)
    t = t.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("page", "ord")))
    write_named(t.select(F.format_string("%s/tabla%d.csv", stem(F.col(doc)), "n").alias("name"), F.concat(table_csv(F.col("rows")), F.lit("\n")).alias("text")), folder)


def write_markdown(texts: DataFrame, sections: DataFrame, folder: str, doc: str = "doc") -> None:
    """texts(doc, text) with the sections(doc, section) of their tables as {doc's stem}.md; a blank text gives no file."""
    t = texts.join(sections.select(doc, "section"), doc, "left").where(strip(F.coalesce("text", F.lit(""))) != "")
    write_named(t.select(F.concat(stem(F.col(doc)), F.lit(".md")).alias("name"), F.concat("text", F.coalesce("section", F.lit(""))).alias("text")), folder)


def write_progress_sets(progress: DataFrame, path: str, bucket: str = "bucket", member: str = "member") -> None:
    """(bucket, member) rows as text, a folder for each bucket, its members in order."""
    p = progress.select(bucket, F.col(member).cast("string").alias("value"))
    p.repartitionByRange(bucket, "value").sortWithinPartitions(bucket, "value").write.mode("overwrite").partitionBy(bucket).text(path)


def write_by_place(rows: DataFrame, path: str) -> None:
    """Results by round, copy and department, so that later reads prune folders."""
    rows.repartition("round", "copy", "dept").write.mode("overwrite").partitionBy("round", "copy", "dept").parquet(path)
