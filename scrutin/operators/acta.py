"""Rules over tally sheets that are specified in prose only (no implementation exists to compare with)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .quantiles import quantiles
from .scan import join_hot

# The largest difference that counts as a genuine signal; the certainty below which a digit is open.
MOST_GENUINE = 30
CERTAIN = 0.70


def arithmetic(sheets: DataFrame, most: float = MOST_GENUINE) -> DataFrame:
    """sheets(total, parts, urna?, habilitados?, least?) plus diff and signal.

    An empty urn is tested first, since it differs from the sum as well. Burnt ballots are not part of `parts`."""
    has = lambda c: F.col(c) if c in sheets.columns else F.lit(None).cast("double")
    diff, urn, voters = F.col("total") - F.col("parts"), has("urna"), has("habilitados")
    signal = (
        F.when(has("least") < 0, "genuina")
        .when(urn == 0, "lectura")
        .when((F.abs(diff) > most) | (F.abs(urn - F.col("parts")) > most) | (urn - voters > most), "lectura")
        .when((diff != 0) | (urn != F.col("parts")) | (urn > voters), "genuina")
        .otherwise("sin alerta")
    )
    return sheets.withColumns({"diff": diff, "signal": signal})


def traffic_light(sheets: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """arithmetic() with the state of reviews(key, review: en revisión / revisada); a reviewed sheet is clean if it adds up."""
    r = sheets.join(reviews, key, "left")
    light = F.coalesce("review", F.when(F.col("signal") == "sin alerta", "sin alerta").otherwise("alerta"))
    return r.withColumns({"light": light, "outcome": F.when(light == "revisada", F.when(F.col("diff") == 0, "Mesa Limpia").otherwise("Posible Fraude"))})


def ratio_vs_peers(rows: DataFrame, group: str, value: Column, statistic: str = "median") -> DataFrame:
    """Each row's value against its group's median (or mean). No task holds a group: medians come from a distributed order,
    and the statistics of groups with many rows are sent to the rows. Rows without a group are left out, as by a join."""
    r = rows.withColumn("value", value).where(F.col(group).isNotNull())
    sizes = r.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.avg("value").alias("peer"))
    if statistic == "median":
        sizes = sizes.drop("peer").join(quantiles(r, group, "value", {"peer": 0.5}).drop("n"), group)
    sizes = written(sizes, "peers")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return join_hot(r, sizes, group, "size", total).withColumn("ratio", F.round(F.try_divide("value", "peer"), 6))


def dispersion(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n rows, deviation, iqr), the quartiles exact and from a distributed order."""
    spread = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp(value), 6).alias("deviation"))
    q = quantiles(rows, group, value, {"q1": 0.25, "q3": 0.75}).select(F.col(group).alias("_group"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))
    return spread.join(q, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def correlation(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(x, y), 6).alias("correlation"))


def geo_rate(rows: DataFrame, *levels: str, flagged: Column) -> DataFrame:
    out = rows.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"), F.grouping_id().cast("long").alias("level"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("n"), 6))


def undesignated(signatories: DataFrame, designated: DataFrame, keys: list[str]) -> DataFrame:
    """Signatories of sheets that no resolution designates as jurors there."""
    return signatories.join(designated.select(*keys).distinct(), keys, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer by key: nueva, retirada, cambiada or igual, with the variation in percent where it is a number."""
    r = before.select(key, F.col(value).alias("a")).join(after.select(key, F.col(value).alias("b")), key, "full")
    change = F.when(F.col("a").isNull(), "nueva").when(F.col("b").isNull(), "retirada").when(F.col("a") == F.col("b"), "igual").otherwise("cambiada")
    return r.withColumns({"change": change, "variation_pct": F.round(F.try_divide((F.col("b") - F.col("a")) * 100.0, F.col("a")), 6)})


def compare_copies(first: DataFrame, second: DataFrame, third: DataFrame, key: str, value: str) -> DataFrame:
    """Three copies of a sheet. The first copy's divergence weighs most."""
    r = first.select(key, F.col(value).alias("c")).join(second.select(key, F.col(value).alias("t")), key, "full").join(third.select(key, F.col(value).alias("d")), key, "full")
    present = sum((F.when(F.col(x).isNotNull(), 1).otherwise(0) for x in "ctd"), F.lit(0))
    verdict = (
        F.when(present < 3, "incompleta")
        .when((F.col("c") == F.col("t")) & (F.col("c") == F.col("d")), "iguales")
        .when(F.col("t") == F.col("d"), "difiere_c")
        .when(F.col("c") == F.col("d"), "difiere_t")
        .when(F.col("c") == F.col("t"), "difiere_d")
        .otherwise("todas_difieren")
    )
    return r.withColumn("verdict", verdict)


def directional_bias(deltas: DataFrame, zone: str, delta: str, least: int = 2) -> DataFrame:
    """Zones in which differences repeatedly favour the same side."""
    g = deltas.where(F.col(delta) != 0).groupBy(zone).agg(F.count_if(F.col(delta) > 0).alias("up"), F.count_if(F.col(delta) < 0).alias("down"))
    return g.withColumn("bias", F.col("up") - F.col("down")).where((F.abs("bias") == F.col("up") + F.col("down")) & (F.abs("bias") >= least))


def version_reversions(rows: DataFrame, key: str, order: list[str], version: str) -> DataFrame:
    """Rows whose version is below the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"before": F.lag(version).over(w), "highest": F.max(version).over(w.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col(version) < F.col("before"))


def top_k(rows: DataFrame, group: list[str], order: list, k: int = 3) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def settled_digit(candidates: Column, human: Column | None = None, other: Column | None = None, certain: float = CERTAIN) -> Column:
    """struct(digit, source, open) of array<struct<digit, conf>>: a person's reading, else the model's best if certain,
    else a second reader's; otherwise the three best stay open."""
    best = F.slice(F.sort_array(F.transform(candidates, lambda c: F.struct(c["conf"].alias("conf"), c["digit"].alias("digit"))), False), 1, 3)
    sure = F.get(best, F.lit(0))["conf"] >= certain
    human = F.lit(None).cast("string") if human is None else human
    other = F.lit(None).cast("string") if other is None else other
    pick = F.coalesce(human, F.when(sure, F.get(best, F.lit(0))["digit"]), other)
    source = F.when(human.isNotNull(), "persona").when(sure, "modelo").when(other.isNotNull(), "segundo")
    return F.struct(pick.alias("digit"), source.alias("source"), F.when(pick.isNull(), F.transform(best, lambda b: b["digit"])).alias("open"))


def weighted_score(parts: dict[str, float]) -> Column:
    """A weighted sum of score columns; the weights are the caller's."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
