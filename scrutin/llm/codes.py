"""Vector code compression: product codes by Lloyd's rounds under Hamerly's bounds.

Vectors are integers cut into equal parts, and each part position has a codebook of its own. A row keeps for each of its
parts the entry it is assigned to, an upper bound on the distance to it and one lower bound on the distance to the second
nearest. After a round the bounds are moved by as much as the entries moved. Only where the upper bound is not strictly
below the lower one is the exact distance to the own entry taken, and only if that fails too are all entries scanned in
integers; so a tie is always scanned, and the lower index wins it as in a plain scan. A round is a map over the rows and a
sum of a fixed number of integers a task."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, join_hot, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def _above(squared: np.ndarray) -> np.ndarray:
    """At least the square roots of integers."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 + 2.0**-50), np.inf)


def _below(squared: np.ndarray) -> np.ndarray:
    """At most the square roots of integers."""
    return np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50)


class Codebook:
    """Integer entries (parts, entries, width), how far each moved in the last update, and half the distance from each to
    the nearest other one."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, n, _ = entries.shape
        self.moved = _above(((entries - before) ** 2).sum(axis=2)) if before is not None else np.zeros((parts, n))
        self.half = np.full((parts, n), np.inf)
        if n > 1:
            apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)
            apart[:, np.arange(n), np.arange(n)] = np.iinfo(np.int64).max
            self.half = _below(apart.min(axis=2)) / 2

    def moved_by_others(self) -> np.ndarray:
        """The farthest that any other entry of the part moved (parts, entries)."""
        parts, n = self.moved.shape
        if n == 1:
            return np.zeros((parts, 1))
        order = np.sort(self.moved, axis=1)
        first, second = order[:, -1:], order[:, -2:-1]
        return np.where(np.arange(n) == self.moved.argmax(axis=1)[:, None], second, first)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of one part: the nearest entry, ties to the lower index, its squared distance and that of the second nearest."""
    squared = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    code = squared.argmin(axis=1)
    at = np.arange(len(x))
    least = squared[at, code]
    squared[at, code] = np.iinfo(np.int64).max
    return code, least, squared.min(axis=1)


def assign(x: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> None:
    """Assigns parts x (rows, parts, width) anew. code, upper and lower (rows, parts) hold what the round before left and
    are changed in place; scans (rows) grows by each full scan."""
    others = book.moved_by_others()
    for p, entries in enumerate(book.entries):
        own = code[:, p]
        upper[:, p] = np.nextafter(upper[:, p] + book.moved[p, own], np.inf)
        lower[:, p] = np.nextafter(lower[:, p] - others[p, own], -np.inf)
        bound = np.maximum(lower[:, p], book.half[p, own])
        open_ = np.nonzero(~(upper[:, p] < bound))[0]
        if not len(open_):
            continue
        upper[open_, p] = _above(((x[open_, p] - entries[own[open_]]) ** 2).sum(axis=1))
        open_ = open_[~(upper[open_, p] < bound[open_])]
        if len(open_):
            scans[open_] += 1
            code[open_, p], least, second = scan(x[open_, p], entries)
            upper[open_, p] = _above(least)
            lower[open_, p] = _below(second) if len(entries) > 1 else np.inf


def updated(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry the floor of its parts' mean; unused ones stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], entries)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(batch: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = len(values), math.prod(values.shape[1:])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, max(width, 1))[: rows + 1], pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id_col, keep..., code array<int>, error long, scans long), a row for each vector, and the final codebooks (parts, entries, width).

    scans counts the full scans that a row's parts took in all. Vectors that are null or hold a null or non-finite
    component are left out. The first codebooks are the parts of the vectors with the smallest ids (null ids last, of a
    repeated id all rows by their components), fewer than `entries` if there are fewer. Repeated rows each get their row.
    Empty table: no rows, no codebooks. All vectors must have the same length, a multiple of `parts`, and components whose
    squared distances fit a long; others are refused with an error, since no code could be right."""
    spark = vectors.sparkSession
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate((id_col, *keep))]
    names = [f"k{i}" for i in range(len(own))]
    ints = vectors.select(*own, integers(F.col(f"`{vector_col}`"), scale).alias("x")).where("x is not null")
    ints, at = written(ints, "ints")
    rows, shortest, longest, largest = ints.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    head = [f for f in ints.schema.fields if f.name in names]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head)
    final = [F.col("k0").alias(id_col), *[F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)], "code", "error", "scans"]
    if not rows:
        drop(spark, at)
        return spark.createDataFrame([], f"{kinds}, code array<int>, error long, scans long").select(*final), np.zeros((parts, 0, 0), np.int64)
    if shortest != longest or not longest or longest % parts:
        raise ValueError(f"vectors of {shortest} to {longest} components can't be cut into {parts} equal parts")
    if longest * (2 * (largest or 0) + 1) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of components up to {largest} don't fit a long")
    width = longest // parts
    first = ints.orderBy(F.col("k0").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most `entries` rows
    book = Codebook(np.array([r["x"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy())
    state_schema = f"{kinds}, x array<long>, code array<int>, upper array<double>, lower array<double>, scans long"

    def assigned(book: Codebook, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, scans = _matrix(b, "x", parts, width), b.column("scans").to_numpy().copy()
                code, upper, lower = (_matrix(b, k, parts).copy() for k in ("code", "upper", "lower"))
                for a in range(0, len(x), 1024):  # a scan holds 1024 * entries * width integers
                    assign(*(m[a : a + 1024] if isinstance(m, np.ndarray) else m for m in (x, book, code, upper, lower, scans)))
                kept, out = [b.column(n) for n in names], [_lists(code, pa.int32()), pa.array(scans)]
                if last:
                    nearest = book.entries[np.arange(parts), code]
                    yield pa.RecordBatch.from_arrays([*kept, *out, pa.array(((x - nearest) ** 2).sum(axis=(1, 2)))], names=[*names, "code", "scans", "error"])
                else:
                    bounds = [_lists(upper, pa.float64()), _lists(lower, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*kept, *out, b.column("x"), *bounds], names=[*names, "code", "scans", "x", "upper", "lower"])

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums and counts by part and entry: of fixed size, whatever the task holds."""
        total = np.zeros((parts, n_entries, width + 1), np.int64)
        for b in batches:
            x, code = _matrix(b, "x", parts, width), _matrix(b, "code", parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["cell", "n"])

    n_entries = book.entries.shape[1]
    fill = lambda v, kind: F.array_repeat(F.lit(v).cast(kind), parts)
    state = ints.select(*names, fill(0, "int").alias("code"), F.lit(0).cast("long").alias("scans"), "x", fill("Infinity", "double").alias("upper"), fill("-Infinity", "double").alias("lower"))
    for _ in range(rounds):
        state, new = written(state.mapInArrow(assigned(book, False), f"{kinds}, code array<int>, scans long, x array<long>, upper array<double>, lower array<double>"), "assigned")
        drop(spark, at)
        at, total = new, np.zeros((parts, n_entries, width + 1), np.int64)
        for row in state.select("x", "code").mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # parts * entries * (width + 1)
            total.reshape(-1)[row["cell"]] = row["n"]
        book = Codebook(updated(book.entries, total[:, :, :-1], total[:, :, -1]), book.entries)
    out, _ = written(state.mapInArrow(assigned(book, True), f"{kinds}, code array<int>, scans long, error long"), "codes")
    drop(spark, at)
    return out.select(*final), book.entries


def hex_code(code: Column) -> Column:
    """Two lowercase hex digits for each index."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def label_errors(rows: DataFrame) -> DataFrame:
    """rows(label, error) plus label_error, error summed over equal labels, nulls together. Labels that many rows have are
    joined where the rows are."""
    key = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = rows.withColumn("label_key", key)
    by_label = keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    by_label, _ = written(by_label, "by_label")
    return join_hot(keyed, by_label, "label_key", "n", rows.count()).drop("label_key")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, entries = compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    sha = hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()
    return label_errors(rows).select("vec_id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds: every part against every entry, each round."""
    squared = "list_sum([(a.q[i] - c.q[i]) * (a.q[i] - c.q[i]) for i in range(1, len(a.q) + 1)])"
    steps = [
        "ints AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM ints)",
        f"parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, q FROM parts WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT a.r, a.p, min((d, e)) AS best FROM (SELECT a.r, a.p, c.e, {squared} AS d FROM parts a JOIN c{k} c USING (p)) a GROUP BY a.r, a.p)".replace("min((d, e))", "min({'d': d, 'e': e})"))
        if k < ROUNDS:
            cells = f"SELECT p, a.best.e AS e, i, sum(q[i]) AS s, count(*) AS n FROM a{k} a JOIN parts USING (r, p), range(1, len(q) + 1) AS t(i) GROUP BY ALL"
            steps.append(f"u{k} AS MATERIALIZED (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM ({cells}) GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.q, c.q) AS q FROM c{k} c LEFT JOIN u{k} u USING (p, e))")
    steps.append(f"codes AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    sha = f"(SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) FROM c{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {sha} AS codebooks_sha256 FROM kept JOIN codes USING (r)"


OP11_SQL = _sql()
