"""The first row of each key in file order, from a stream that brings rows in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import event_time


def first_in_order(rows: DataFrame, key: str, order: list[str], *, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, order..., revision, final) in update mode: a row when a key first comes, and again, with the next revision, when
    a row comes that is before the one given. The last revision of a key is that of a batch run over the same rows.

    The state is one place in the order and two numbers for each key, however many rows it has; once the watermark is `late`
    beyond the key's last row it is given with final = true and forgotten, and rows of that key that come later still begin
    anew. order: columns without nulls that compare as they are (numbers, text). Rows without a key are left out."""
    rows = event_time(rows, column, late).where(F.col(key).isNotNull())
    wait = pd.Timedelta(late).value // 1_000_000
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [key, *order]}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def given(place: tuple, revision: int, final: bool) -> pd.DataFrame:
            return pd.DataFrame({key: [k[0]], **{c: [v] for c, v in zip(order, place)}, "revision": [revision], "final": [final]})

        if state.hasTimedOut:
            *place, revision, _ = state.get
            state.remove()
            yield given(place, revision, True)
            return
        best, revision, last = None, 0, 0
        if state.exists:
            *best, revision, last = state.get
            best = tuple(best)
        before = best
        for batch in batches:
            own = min(batch[order].itertuples(index=False, name=None))
            best = own if best is None or own < best else best
            last = max(last, int(batch[column].max().timestamp() * 1000))
        if best != before:
            revision += 1
            yield given(best, revision, False)
        state.update((*best, revision, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    state = ", ".join([*(f"{c} {kinds[c]}" for c in order), "revision long, last long"])
    return rows.groupBy(key).applyInPandasWithState(step, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "revision long, final boolean"]), state, "update", GroupStateTimeout.EventTimeTimeout)


def settled(revisions: DataFrame, key: str) -> DataFrame:
    """The last revision of each key of what the stream gave."""
    others = [c for c in revisions.columns if c != key]
    return revisions.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("revision", "final")).alias("r")).select(key, "r.*")
