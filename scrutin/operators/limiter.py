"""The rate limiter of a captured session: one counter of failures over all requests, its pauses and its schedule.

A counter that every request reads and writes looks like a loop in one task. But what a request finds depends only on how
many failures came since the last request that reset it, so all of it is running totals, over range partitions of one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running
from .state import TRIP

# Seconds before each request; seconds of a pause; the status that pauses at once; the first server error.
DELAY, COOLDOWN = 1.0, 60.0
LIMITED_STATUS, SERVER_ERROR = 429, 500


def transport_failed(status: Column, error: Column) -> Column:
    """Whether a request counts as a failure: an error of the transport, no answer, or an error of the server."""
    status = F.coalesce(status, F.lit(0))
    return (F.coalesce(error, F.lit("")) != "") | (status == 0) | (status >= SERVER_ERROR)


def limiter(requests: DataFrame, order: list[str], failed: Column, limited: Column, *, key: list[str] | None = None, trip: int = TRIP, delay: float = DELAY, cooldown: float = COOLDOWN) -> DataFrame:
    """requests plus: run (how many requests before it reset the counter), place (its place after the last of those), fails
    (the counter once it is answered), pause_before, pause_after, sent_s (seconds slept before it is sent, in all).

    Before a request the limiter sleeps `delay`, then `cooldown` if the counter has reached `trip`, which resets it. An
    answer resets it too; a failure adds one; a limited request pauses at once and resets it. So a run of failures that ends
    the session trips without a pause. order: without ties; key: sessions of their own, one session for all if empty.
    Nulls in failed and limited count as false."""
    key = key or []
    bad, now = F.coalesce(failed, F.lit(False)), F.coalesce(limited, F.lit(False))
    r = requests.withColumns({"_limited": now, "_failed": bad & ~now})
    resets = F.when(F.col("_failed"), 0).otherwise(1).cast("long")
    r = running(r, key, order, {"run": ("sum", resets)}).withColumn("run", F.col("run") - resets)
    r = running(r, [*key, "run"], order, {"place": ("sum", F.lit(1).cast("long"))})
    before = (F.col("place") > 1) & ((F.col("place") - 1) % trip == 0)
    r = r.withColumns({"fails": F.when(F.col("_failed"), (F.col("place") - 1) % trip + 1).otherwise(0), "pause_before": before, "pause_after": F.col("_limited")})
    slept = F.lit(float(delay)) + F.when(F.col("pause_before"), float(cooldown)).otherwise(0.0) + F.when(F.col("pause_after"), float(cooldown)).otherwise(0.0)
    r = running(r, key, order, {"sent_s": ("sum", slept)})
    return r.withColumn("sent_s", F.col("sent_s") - F.when(F.col("pause_after"), float(cooldown)).otherwise(0.0)).drop("_limited", "_failed")


def pauses(limited: DataFrame, *, cooldown: float = COOLDOWN) -> DataFrame:
    """limiter()'s rows -> a row for each pause: the request's columns, kind (fallos before it, limite after it), starts_s and
    ends_s in seconds slept; such columns of the request's own give way."""
    before, after = F.struct(F.lit("fallos").alias("kind"), (F.col("sent_s") - cooldown).alias("starts_s")), F.struct(F.lit("limite").alias("kind"), F.col("sent_s").alias("starts_s"))
    each = F.filter(F.array(F.when(F.col("pause_before"), before), F.when(F.col("pause_after"), after)), lambda p: p.isNotNull())
    kept = [c for c in limited.columns if c not in ("run", "place", "fails", "pause_before", "pause_after", "sent_s", "kind", "starts_s", "ends_s")]
    return limited.select(*kept, F.explode(each).alias("p")).select(*kept, "p.kind", "p.starts_s", (F.col("p.starts_s") + cooldown).alias("ends_s"))


def runs(limited: DataFrame, key: list[str] | None = None, at: str = "sent_s") -> DataFrame:
    """limiter()'s rows -> runs of failures: (key, run, run_start, run_length, trips), run_start the least of `at`."""
    failed = limited.where(F.col("fails") > 0)
    return failed.groupBy(*(key or []), "run").agg(F.min(at).alias("run_start"), F.count(F.lit(1)).alias("run_length"), F.count_if(F.col("fails") == TRIP).alias("trips"))
