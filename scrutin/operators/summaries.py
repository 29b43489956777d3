"""Counts and shares for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status_summary(rows: DataFrame, status: Column, order: tuple[str, ...] = (), missing: str = "DESCONOCIDO") -> DataFrame:
    """(status, n, pct, place): counts with the share of all, known classes first in their order, then by name. The
    window runs over the counts, a row for each status."""
    counts = rows.groupBy(F.coalesce(status, F.lit(missing)).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("status")) if order else F.lit(0)
    place = F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(F.lit(1 << 30)), "status"))
    return counts.select("status", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("pct"), place.alias("place"))


def bucket_counts(rows: DataFrame, status: Column, named: tuple[str, ...], rest: str = "ERROR") -> DataFrame:
    """(bucket, n): each named status, and all others, null too, in one remainder bucket."""
    bucket = F.when(F.coalesce(status.isin(*named), F.lit(False)), status).otherwise(rest)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def class_rows(rows: DataFrame, status: str, *classes: str) -> DataFrame:
    """The rows of some classes."""
    return rows.where(F.col(status).isin(*classes))


def rollup_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by key prefixes and in all; level 0 is the finest."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def coverage(rows: DataFrame, by: str, covered: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("covered"), F.round(F.avg(covered.cast("double")), 6).alias("share"))


def conversion_totals(rows: DataFrame, outcome: str = "outcome", started: str | None = None, ended: str | None = None) -> DataFrame:
    """One row of counts and sums; with the times of each conversion also the seconds from the first start to the last end."""
    o = F.col(outcome)
    counts = [F.count(F.lit(1)).alias("total"), *[F.count_if(o == x).alias(x) for x in ("ok", "empty", "fail")]]
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("embedded", "csv_files")]
    elapsed = [F.coalesce(F.unix_seconds(F.max(ended)) - F.unix_seconds(F.min(started)), F.lit(0)).alias("elapsed_s")] if started and ended else []
    return rows.agg(*counts, *sums, *elapsed)
