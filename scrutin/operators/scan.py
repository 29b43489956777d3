"""Running totals in an order, over keys of any size.

A window over a key puts all rows of the key into one task. Here rows are sorted into range partitions, so a key with many
rows lies in several; each partition is summed by itself, and what goes before a partition is known from one row for each
partition in which its first key continues."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: An aggregate, and how the total of what goes before is joined to that of the rows here.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda before, here: F.coalesce(before + here, before, here)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
    "xor": (F.bit_xor, lambda before, here: F.coalesce(before.bitwiseXOR(here), before, here)),
}


#: A key that more than one in so many rows has is hot. There are fewer than this many hot keys, whatever the table.
HOT_KEYS = 20_000
#: A key with fewer rows than this is never hot.
LEAST_HOT = 256


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def running(rows: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, Column]], write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows plus for each name the running total of (kind, column) within the key, up to and with the row.

    order: ascending, nulls first, without ties within a key; of rows that tie, which comes first is undefined. key: null is
    a key like any other; [] is one order over all rows. Nulls add nothing; the total is null until there is a value.
    No task holds more than its range partition, however many rows a key has."""
    key_columns = [F.col(k) for k in key]
    values = {f"_{name}": column for name, (_, column) in totals.items()}
    sort = [*key, *order]
    parts = rows.withColumns(values).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    parts = write(parts, "parts")
    within = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = parts.withColumns({f"_{name}": KINDS[kind][0](f"_{name}").over(within) for name, (kind, _) in totals.items()})
    # What each partition has of its first key, and of the keys that begin a later one: at most two rows for each partition.
    each = parts.groupBy("_part", *key).agg(*[KINDS[kind][0](f"_{name}").alias(f"_{name}") for name, (kind, _) in totals.items()])
    if key:
        first = parts.groupBy("_part").agg(F.min(F.struct(*key_columns)).alias("k")).select(*[F.col(f"k.{k}").alias(f"_{k}_") for k in key]).distinct()
        each = each.join(F.broadcast(first), all_of([F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in key]), "left_semi")
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_{k}_") for k in key], *[KINDS[kind][0](f"_{name}").over(before).alias(f"_before_{name}") for name, (kind, _) in totals.items()])
    on = all_of([F.col("_part") == F.col("_of"), *[F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in key]])
    joined = here.join(F.broadcast(carried), on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[KINDS[kind][1](F.col(f"_before_{name}"), F.col(f"_{name}")).alias(name) for name, (kind, _) in totals.items()])


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with by_key, which has a row for each key (never null) and in column n how many of the `total` rows have it.

    Hot keys are fewer than HOT_KEYS by counting, so their rows of by_key are sent to every executor and the many rows of
    each stay where they are; only the others are shuffled. n is left out of the result."""
    hot = F.col(n) > max(LEAST_HOT, total // HOT_KEYS)
    sent = F.broadcast(by_key.where(hot).drop(n))
    own = by_key.where(hot).select(F.col(key).alias("_hot"))
    others = rows.join(F.broadcast(own), F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(sent, key).unionByName(others.join(by_key.where(~hot).drop(n), key))
