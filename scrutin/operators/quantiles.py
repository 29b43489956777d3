"""Exact medians and percentiles of groups of any size.

The built-in exact aggregates keep all values of a group in one buffer. Here equal values are counted first, the counts
are summed along a distributed order of (group, value), and the few values whose ranks are asked for are picked from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scan import join_hot, running


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a double for each name): the exact quantile at each share, linear between neighbours, as `percentile` has it.

    Nulls are no values; a group with none has n 0 and null quantiles; NaN is the largest value. A null group is a group.
    Empty table: no rows."""
    counted = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("times"))
    counted = written(counted.withColumn("times", F.when(F.col("v").isNotNull(), F.col("times")).otherwise(0).cast("long")), "counted")
    groups = counted.groupBy("g").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("distinct"))
    groups = groups.withColumn("key", F.struct("g"))  # a struct is never null
    upto = running(counted, ["g"], ["v"], {"upto": ("sum", F.col("times"))}).withColumn("key", F.struct("g"))
    total = groups.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    ranked = join_hot(upto, groups.select("key", "n", "distinct"), "key", "distinct", total)
    at = {name: (F.col("n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    holds = lambda rank: (rank >= F.col("upto") - F.col("times")) & (rank < F.col("upto"))
    ends = {f"{name}_{side}": F.max(F.when(holds(f(x)), F.col("v"))) for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = ranked.groupBy("key").agg(F.max("n").alias("n"), *[c.alias(name) for name, c in ends.items()])

    def between(name: str, x) -> F.Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name)

    return found.select(F.col("key.g").alias(group), "n", *[between(name, x) for name, x in at.items()])
