"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import TRIP


def event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """With a watermark; a time without a zone is read in the session's (set it to UTC), which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling_counts(events: DataFrame, by: str = "event_type", column: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by status and window; a batch frame gives the same rows."""
    e = event_time(events, column, late) if events.isStreaming else events.withColumn(column, F.col(column).cast("timestamp"))
    return e.groupBy(F.window(column, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(events: DataFrame, key: str, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row per key in order of arrival, state bounded by the watermark."""
    return event_time(events, column, late).dropDuplicatesWithinWatermark([key])


def failure_trips(events: DataFrame, key: str, order: list[str], failed: str, trip: int = TRIP) -> DataFrame:
    """(key, trips, run_length) as of each micro-batch: rows with a boolean `failed` are counted in order within a key.

    The state is one number per key. Order holds within a micro-batch and between them, not for rows that arrive late."""
    key_type = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, trips = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for bad in rows[failed].fillna(False):
            run = run + 1 if bad else 0
            trips += bool(bad) and run % trip == 0
        state.update((int(run), int(trips)))
        yield pd.DataFrame({key: [k[0]], "trips": [int(trips)], "run_length": [int(run)]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, trips long, run_length long", "run long, trips long", "update", GroupStateTimeout.NoTimeout)


def incremental(reader: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what has arrived since the last run and stops; the checkpoint is the durable progress."""
    reader.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
