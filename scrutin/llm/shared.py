"""What several operators of this package need: the shared folder, cut lineage, joins with hot keys, running sums over an
order, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import join_hot

__all__ = ["connected_components", "drop", "intermediates", "join_hot", "running", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where it is unset and all runs in one process
    (tests), a temporary one is made: executors elsewhere could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _open.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


#: The lists of the context that runs: threads, and so pipelines in several, don't see each other's.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the tables that written() made within it and that are still in the list it gives: take out what
    is to stay. Operators' results are lazy and read such tables, so write a result before the end."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)
        drop(spark, *made)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables that written() made and nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df plus for each name the sum of its column over all rows before, in an order without ties.

    Rows are sorted in range partitions and summed within each; what goes before a partition is added from a table with a
    row for each partition, the only one that a single task orders."""
    parts = df.withColumns(sums).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts, _ = written(parts, "parts")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(k).alias(k) for k in sums])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_ahead_{k}") for k in sums])
    within = parts.withColumns({k: F.coalesce(F.sum(k).over(before), F.lit(0)) for k in sums}).join(F.broadcast(totals), "_part")
    return within.withColumns({k: F.col(k) + F.col(f"_ahead_{k}") for k in sums}).select(*df.columns, *sums)


def connected_components(edges: DataFrame, most_rounds: int = 80) -> DataFrame:
    """Components of an undirected graph: edges(u long, v long) -> (node long, component long), component the smallest node.

    Alternating large-star and small-star (Kiveris et al. 2014): each round is joins and groupings over all edges, so
    no component is ever gathered in a task, and the rounds grow with the logarithm of the components' diameter. The
    edges of a hub are never brought together: its least neighbour goes to them (join_hot). Each round's edges are
    written to the shared folder, the round before is removed. Self-loops and nulls are ignored; nodes without an edge
    to another node are not returned."""
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def with_least(df: DataFrame, total: int) -> DataFrame:
        least = df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return join_hot(df, least, "u", "n", total)

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = written(e, "edges")
    seen = mark(e)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large, between = written(large, "large")
        small = with_least(large, 2 * seen[0]).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        new, at = written(small.distinct(), "edges")
        drop(spark, path, between)
        e, path, before, seen = new, at, seen, mark(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
