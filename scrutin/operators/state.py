"""Resumable state: what is pending, the latest result per key, progress buckets, failure runs, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import automaton

# Failures in a row that trip the breaker; calls between two tries of the first transport; the codes of
# departments.
TRIP = 3
REPROBE = 50
DEPARTMENTS = {
    "01": "ANTIOQUIA", "03": "ATLANTICO", "05": "BOLIVAR", "07": "BOYACA", "09": "CALDAS", "11": "CAUCA", "12": "CESAR", "13": "CORDOBA",
    "15": "CUNDINAMARCA", "16": "BOGOTA D.C.", "17": "CHOCO", "19": "HUILA", "21": "MAGDALENA", "23": "NARINO", "24": "RISARALDA", "25": "NORTE DE SAN",
    "26": "QUINDIO", "27": "SANTANDER", "28": "SUCRE", "29": "TOLIMA", "31": "VALLE", "40": "ARAUCA", "44": "CAQUETA", "46": "CASANARE",
    "48": "LA GUAJIRA", "50": "GUAINIA", "52": "META", "54": "GUAVIARE", "56": "SAN ANDRES", "60": "AMAZONAS", "64": "PUTUMAYO", "68": "VAUPES",
    "72": "VICHADA", "88": "CONSULADOS",
}


def pending(rows: DataFrame, progress: DataFrame, key: str, done: tuple[str, ...] = ("ok", "invalid", "dif"), modes: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key has no done bucket; errors are tried again. With modes, progress counts for its own mode only, and
    what comes back is a row for each mode in which the key is pending."""
    on = ["mode", key] if modes else [key]
    rows = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))) if modes else rows
    return rows.join(progress.where(F.col("bucket").isin(*done)).select(*on).distinct(), on, "left_anti")


def valid_progress(progress: DataFrame, fingerprint: str) -> DataFrame:
    """Progress counts only for the input it was made from."""
    return progress.where(F.col("input_sha256") == fingerprint)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key. max_by with partial aggregation keeps one row per key and task before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*key, "r.*").select(*rows.columns)


def progress_rows(rows: DataFrame, bucket: str, member: str) -> DataFrame:
    """Progress as distinct (bucket, member) rows, however many members a bucket has. The sink sorts them."""
    return rows.select(bucket, member).distinct()


def moved_between(rows: DataFrame, bucket: str, member: str, order: list[str]) -> DataFrame:
    """(bucket, member) after all events: a member is in the bucket of its last one only."""
    return progress_rows(latest(rows.select(bucket, member, *order), [member], order), bucket, member)


def every_nth(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The rows at which a checkpoint is due, counted within each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") % n == 0)


def failure_runs(rows: DataFrame, key: str, order: list[str], failed: Column, trip: int = TRIP) -> DataFrame:
    """Runs of failures per key: (key, run_start, run_length, trips); run_start is the last of `order` in the run's first
    row. The counter begins anew after each trip, so a run trips once for each `trip` failures."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("failed", F.coalesce(failed, F.lit(False)))
    r = r.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.where("failed").groupBy(key, "island").agg(F.min_by(order[-1], F.struct(*order)).alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    return runs.withColumn("trips", F.floor(F.col("run_length") / trip).cast("long")).drop("island")


def changes(rows: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Rows whose status differs from the one before of their key, with it and their place in the poll."""
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumns({"place": F.row_number().over(w), "before": F.lag(status).over(w)})
    return r.where(F.col("before").isNotNull() & (F.col("before") != F.col(status)))


def decode(rows: DataFrame, code: str, names: dict[str, str] | None = None, into: str = "dept_name") -> DataFrame:
    """The name of a code by a literal map (some dozens of entries), null for an unknown one."""
    names = names or DEPARTMENTS
    return rows.withColumn(into, F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(code)))


def decode_counts(rows: DataFrame, code: str, names: dict[str, str] | None = None) -> DataFrame:
    """One row: how many rows have a code with a name, and how many have none and are skipped."""
    name = F.col("_name")
    return decode(rows.select(code), code, names, "_name").agg(F.count(name).alias("matched"), F.count_if(name.isNull()).alias("unmatched"))


def plan_moves(files: DataFrame, present: DataFrame) -> DataFrame:
    """files(path, base, dept_name, mpio, zona, puesto, filename) -> outcome and organized path. Nothing is moved.

    sin_patron: no place or an unknown department; en_sitio: already there; conflicto: the path is taken, by a file that
    is present or by one of this plan; movida. Files are taken in the order of their paths' parts, so of several for one
    place the first is moved. A file's place follows from its name, so what is at a place stays there."""
    dest = F.when(F.col("dept_name").isNotNull() & F.col("puesto").isNotNull(), F.concat_ws("/", "base", "dept_name", "mpio", "zona", "puesto", "filename"))
    parts = F.split("path", "/")
    r = files.withColumn("organized", dest).join(present.select(F.col("path").alias("organized"), F.lit(True).alias("taken")).distinct(), "organized", "left")
    first = r.where("organized is not null and organized <> path and taken is null").groupBy("organized").agg(F.min(F.struct(parts, "path"))["path"].alias("first"))
    r = r.join(first, "organized", "left")
    outcome = F.when(F.col("organized").isNull(), "sin_patron").when(F.col("organized") == F.col("path"), "en_sitio")
    return r.withColumn("outcome", outcome.when(F.col("taken") | (F.col("path") != F.col("first")), "conflicto").otherwise("movida")).drop("taken", "first")


def move_counts(plan: DataFrame) -> DataFrame:
    """One row: files moved, without a pattern, in conflict, and already in place."""
    names = {"moved": "movida", "no_pattern": "sin_patron", "conflict": "conflicto", "in_place": "en_sitio"}
    return plan.agg(*[F.count_if(F.col("outcome") == v).alias(k) for k, v in names.items()])


def revert_plan(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """manifest(filename, original, organized) -> source, target, outcome: revertida, or error if it isn't there."""
    r = manifest.join(present.select(F.col("path").alias("organized"), F.lit(True).alias("there")).distinct(), "organized", "left")
    return r.select("filename", F.col("organized").alias("source"), F.col("original").alias("target"), F.when(F.col("there"), "revertida").otherwise("error").alias("outcome"))


def transports(rows: DataFrame, key: list[str], order: list[str], primary_failed: str, trip: int = TRIP, reprobe: int = REPROBE) -> DataFrame:
    """Which transport each captured call of a session would have gone through: rows plus `transport`.

    After `trip` failures in a row calls go to the fallback; there every `reprobe`-th call tries the primary first, and
    returns to it if that succeeds. primary_failed: whether the primary fails at that call (null: it does). key: sessions of
    their own, one for all rows if empty. States are the failures so far, or the calls since the last try: a session's
    calls are read in order by many tasks."""

    def step(state: int, failed: int) -> int:
        """So many failures on the primary up to `trip`, above it so many calls on the fallback, in turns of `reprobe`."""
        if state < trip:
            return state + 1 if failed else 0
        calls = (state - trip) % reprobe + 1
        return 0 if calls == reprobe and not failed else trip + calls

    table = automaton.table_of(trip + 1 + reprobe, 2, step)
    r = automaton.walked(rows, key, order, F.coalesce(F.col(primary_failed).cast("int"), F.lit(1)), table)
    return r.withColumn("transport", F.when(F.col("state") > trip, "fallback").otherwise("primary")).drop("state")
