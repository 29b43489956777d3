"""The history of an index that is captured again and again: each entry with the dates between which it read so.

The table is two folders: open/as_of=D holds the entries as of the capture of D with the date they are valid from, and
closed/valid_to=D those that the capture of D ended. A merge reads one capture and one folder of open rows, whatever the
history holds; closed rows are never read or written again. Readers go by the newest complete open folder, so a merge that
is cut short changes nothing, and one that is repeated writes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def captures(spark: SparkSession, path: str) -> list[str]:
    """Dates of the open folders that are complete: the last capture's, and at most the one before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/open")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removeprefix("as_of=") for n in names if n.startswith("as_of=") and _exists(spark, f"{path}/open/{n}/_SUCCESS"))


def _one_each(capture: DataFrame, key: str) -> DataFrame:
    """A row for each key: of a key that is repeated the least values. A null key is left out."""
    values = [c for c in capture.columns if c != key]
    return capture.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("v")).select(key, "v.*")


def merge(path: str, capture: DataFrame, key: str, date: str) -> None:
    """Adds the capture(key, values...) of a date, which must be after all before (or the last again) in text order.

    An entry whose values changed ends and begins anew, one that is gone ends, one that comes back begins anew. Nulls are
    values. Columns must stay as they are."""
    spark = capture.sparkSession
    done = captures(spark, path)
    if done and date < done[-1]:
        raise ValueError(f"{date} is before {done[-1]}")
    before = [d for d in done if d < date]
    new = _one_each(capture, key)
    values = [c for c in new.columns if c != key]
    if not before:
        new.withColumn("valid_from", F.lit(date)).write.mode("overwrite").parquet(f"{path}/open/as_of={date}")
        return
    schema = new.withColumn("valid_from", F.lit(date)).schema
    old = spark.read.schema(schema).parquet(f"{path}/open/as_of={before[-1]}").select(key, F.struct(*values).alias("old"), "valid_from")
    both = old.join(new.select(key, F.struct(*values).alias("new")), key, "full")
    same = F.col("old").eqNullSafe(F.col("new"))
    closed = both.where(F.col("old").isNotNull() & ~same)
    closed.select(key, "old.*", "valid_from").write.mode("overwrite").parquet(f"{path}/closed/valid_to={date}")
    open_ = both.where(F.col("new").isNotNull()).select(key, "new.*", F.when(same, F.col("valid_from")).otherwise(F.lit(date)).alias("valid_from"))
    open_.write.mode("overwrite").parquet(f"{path}/open/as_of={date}")
    for d in before[:-1]:  # the one before the last stays for a merge that is repeated
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/open/as_of={d}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def history(spark: SparkSession, path: str, on: str | None = None) -> DataFrame:
    """(key, values..., valid_from, valid_to): all entries, valid_to null for those that still are; with a date only those
    that were valid on it. The date prunes the folders of entries that had ended by then."""
    last = captures(spark, path)[-1]
    rows = spark.read.parquet(f"{path}/open/as_of={last}").withColumn("valid_to", F.lit(None).cast("string"))
    if _exists(spark, f"{path}/closed"):
        # the folder's name is text, whatever it looks like
        closed = spark.read.schema(rows.schema).option("basePath", f"{path}/closed").parquet(f"{path}/closed").where(F.col("valid_to") <= last)
        rows = rows.unionByName(closed if on is None else closed.where(F.col("valid_to") > on))
    return rows if on is None else rows.where(F.col("valid_from") <= on)


def rebuilt(captured: DataFrame, key: str, date: str = "date") -> DataFrame:
    """The same from all captures(date, key, values...) at once. A key's captures, at most one a date, are ordered by one task."""
    values = [c for c in captured.columns if c not in (key, date)]
    days = captured.select(date).distinct()
    places = days.select(F.col(date).alias("_day"), F.row_number().over(Window.orderBy(date)).alias("place"), F.lead(date).over(Window.orderBy(date)).alias("following"))  # a row for each date
    one = captured.where(F.col(key).isNotNull()).groupBy(key, date).agg(F.min(F.struct(*values)).alias("v"))
    rows = one.join(F.broadcast(places), F.col(date) == F.col("_day"))
    w = Window.partitionBy(key).orderBy("place")
    begins = ~(F.lag("v").over(w).eqNullSafe(F.col("v")) & F.lag("place").over(w).eqNullSafe(F.col("place") - 1))
    rows = rows.withColumn("begins", F.when(begins, 1).otherwise(0)).withColumn("run", F.sum("begins").over(w))
    spans = rows.groupBy(key, "run").agg(F.first("v").alias("v"), F.min(date).alias("valid_from"), F.max_by("following", "place").alias("valid_to"))
    return spans.select(key, "v.*", "valid_from", "valid_to")
