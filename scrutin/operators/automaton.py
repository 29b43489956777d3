"""A small state machine over an order of any length.

What a row finds depends on all rows before it, yet the machine has few states, so a stretch of rows is a map from each
state at its beginning to the one at its end. Rows are sorted into range partitions; each gives the maps of its first and
last key, a row for each partition is put together in order, and then each partition is walked from its own beginning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def table_of(states: int, symbols: int, step: Callable[[int, int], int]) -> np.ndarray:
    """The next state by symbol and state."""
    return np.array([[step(state, symbol) for state in range(states)] for symbol in range(symbols)], np.int32)


def walked(rows: DataFrame, key: list[str], order: list[str], symbol: Column, table: np.ndarray, start: int = 0) -> DataFrame:
    """rows plus `state`, the machine's state after the row: it begins at `start` for each key ([]: one for all rows), and
    table[symbol][state] is the next.

    order: ascending, nulls first, without ties within a key. symbol: never null. What the driver sees is a row of two maps
    for each partition; no task holds more than its partition."""
    spark = rows.sparkSession
    sort = [*key, *order]
    named = F.to_json(F.struct(*[F.col(k) for k in key]), {"ignoreNullFields": "false"}) if key else F.lit("")
    parts = rows.withColumn("_symbol", symbol.cast("int")).repartitionByRange(*sort).sortWithinPartitions(*sort)
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "parts")
    # In each task whole partitions, each in order.
    laid = parts.withColumn("_key", named).repartition("_part").sortWithinPartitions("_part", *sort)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, name, here = None, None, None
        for b in batches:
            for part, k, s in zip(b.column("_part").to_pylist(), b.column("_key").to_pylist(), b.column("_symbol").to_pylist()):
                if part != at:
                    if at is not None:
                        out[-1] += (name, here.tolist())
                    at, name, here = part, k, np.arange(table.shape[1])
                    out.append((part, k))
                elif k != name:
                    if len(out[-1]) == 2:
                        out[-1] += (here.tolist(),)
                    name, here = k, np.arange(table.shape[1])
                here = table[s][here]
        if at is not None:
            out[-1] += (name, here.tolist())
        out = [o if len(o) == 5 else (*o[:2], o[3], *o[2:]) for o in out]  # of a single key: its map is first and last
        if out:
            kinds = (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "first", "first_map", "last", "last_map"])

    begun, carried, state = {}, None, start
    found = laid.select("_part", "_key", "_symbol").mapInArrow(maps, "part int, first string, first_map array<long>, last string, last_map array<long>")
    for r in sorted(found.collect()):  # a row for each partition
        begun[r["part"]] = begin = state if carried == r["first"] else start
        state = r["first_map"][begin] if r["first"] == r["last"] else r["last_map"][start]
        carried = r["last"]
    sent, names = spark.sparkContext.broadcast(begun), rows.columns
    lists = [row.tolist() for row in table]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name, state = None, None, start
        for b in batches:
            after = []
            for part, k, s in zip(b.column("_part").to_pylist(), b.column("_key").to_pylist(), b.column("_symbol").to_pylist()):
                if part != at:
                    at, name, state = part, k, sent.value[part]
                elif k != name:
                    name, state = k, start
                state = lists[s][state]
                after.append(state)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(after, pa.int32())], names=[*names, "state"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return laid.select(*[F.col(f"`{c}`") for c in names], "_part", "_key", "_symbol").mapInArrow(walk, f"{fields}, state int")
