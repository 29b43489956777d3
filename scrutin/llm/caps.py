"""Near-duplicate vectors by spherical-cap filters.

A filter direction is the concatenation of two codewords, one for each half of a randomly rotated space; with k codewords
a half there are k * k directions in each of a few rotations, and k follows the number of vectors, so that unlike vectors
seldom share a filter. Each vector is list-decoded to all directions whose inner product with it exceeds a bound, from the
scores of the codewords alone. Vectors meet in the filters that they share, and each pair that meets is verified in double
precision. What is shuffled for every filter is ids; vectors go only where they meet others, once for all filters that
hold the same vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, drop, join_hot, table, written
from .simhash import spanning

COSINE = 0.9
#: Independent rotations, each with its own codes. CODEWORDS for each half at least, and the square root of PER_VECTOR times
#: the vectors. A vector has LEAST filters in each rotation, some more with more codewords; the filters that exceed what
#: that share of random directions does are all its own.
ROTATIONS = 4
CODEWORDS = 600
PER_VECTOR = 120
LEAST = 12
#: What share of pairs at the least cosine must share a filter, in any number of dimensions; there are at least
#: FEWEST codewords.
RECALL, FEWEST = 0.998, 8
SEED = 20240229
#: Vectors per block of a large filter; a task compares two blocks at a time.
BLOCK = 512


def codewords_for(n_vectors: int, dim: int) -> int:
    """Codewords for so many vectors of a length: as many as the vectors ask for, or the most, by fours, with which pairs at
    the least cosine still meet. In few dimensions many directions lie between two vectors that are alike."""
    most, k = max(CODEWORDS, math.isqrt(PER_VECTOR * n_vectors) + 1), FEWEST
    while k < most and tried(dim, k)[1] <= 8 * ROTATIONS * least_for(k) and tried(dim, min(most, 4 * k))[0] >= RECALL:
        k = min(most, 4 * k)
    return k


@lru_cache(maxsize=64)
def tried(dim: int, codewords: int, pairs: int = 500, seed: int = SEED) -> tuple[float, float]:
    """Of made pairs at exactly COSINE: the share that share a filter, and how many filters a vector has (in very few
    dimensions codewords repeat each other, and with them filters)."""
    rng = np.random.default_rng([seed, dim, codewords])
    x, y = rng.standard_normal((2, pairs, max(dim, 2)))[:, :, :dim]
    if dim < 2:
        return 1.0, math.inf
    x = units_of(x)
    y = units_of(y - (y * x).sum(axis=1, keepdims=True) * x)
    y = COSINE * x + math.sqrt(1 - COSINE**2) * y
    step, met, held = max(8, 600_000 // codewords), 0, 0
    for k in range(0, pairs, step):
        for a, b in zip(decode(x[k : k + step], codewords), decode(y[k : k + step], codewords)):
            met, held = met + (len(np.intersect1d(a, b)) > 0), held + len(a)
    return met / pairs, held / pairs


def least_for(codewords: int) -> int:
    """Filters of a vector in a rotation: with more directions two like vectors share a given one more seldom."""
    return max(LEAST, round(LEAST * (codewords / CODEWORDS) ** 0.25))


@lru_cache(maxsize=8)
def directions(dim: int, rotation: int, codewords: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and both of its codes for vectors of a length: from the seed alone, so every task has the same."""
    rng = np.random.default_rng([seed, dim, rotation])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    codes = []
    for width in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((codewords, width)).astype(np.float32)
        codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / np.float32(math.sqrt(2)))
    return turn, codes[0], codes[1]


def decode(units: np.ndarray, codewords: int = CODEWORDS) -> list[np.ndarray]:
    """For each unit vector (row) the ascending numbers of all filters that exceed its bound: in each rotation what a share
    of least / codewords^2 of random directions exceeds, or what its `least` best filters reach, if that is lower."""
    n, dim = units.shape
    half, found, least = dim - dim // 2, [], min(least_for(codewords), codewords)
    bound = NormalDist().inv_cdf(1 - least / codewords**2) / math.sqrt(dim)
    for rotation in range(ROTATIONS):
        turn, first, second = directions(dim, rotation, codewords)
        turned, base = units.astype(np.float32) @ turn, rotation * codewords * codewords
        a, b = turned[:, :half] @ first.T, turned[:, half:] @ second.T
        top_a, top_b = (np.partition(x, codewords - least, axis=1)[:, codewords - least :] for x in (a, b))
        sums = (top_a[:, :, None] + top_b[:, None, :]).reshape(n, -1)  # the `least` best sums are among these
        reached = np.minimum(bound, np.partition(sums, -least, axis=1)[:, -least]) - 1e-6
        least_a, least_b = reached - top_b.max(axis=1), reached - top_a.max(axis=1)
        own = []
        for i in range(n):
            x, y = np.nonzero(a[i] >= least_a[i])[0], np.nonzero(b[i] >= least_b[i])[0]  # others exceed with no codeword of the other half
            at_x, at_y = np.nonzero(a[i, x][:, None] + b[i, y] >= reached[i])
            own.append(np.sort(x[at_x] * codewords + y[at_y] + base))
        found.append(own)
    return [np.concatenate(x) for x in zip(*found)]


def units_of(values: np.ndarray) -> np.ndarray:
    scale = np.abs(values).max(axis=1, keepdims=True)  # else squares of very large or small components over- or underflow
    values = values / scale
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def filters_of(vector: Column, codewords: dict[int, int]) -> Column:
    """codewords: by length of the vector."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def filters(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(i)
        for length, at in by_length.items():
            many = max(8, 600_000 // codewords[length])
            for k in range(0, len(at), many):
                some = at[k : k + many]
                for i, f in zip(some, decode(units_of(np.array([vectors.iloc[i] for i in some], np.float64)), codewords[length])):
                    out[i] = f
        return pd.Series(out)

    return filters.asNondeterministic()(vector)  # its cost, not its value: it is never run twice for a row


def _share_earlier(lists: list[np.ndarray], below: int) -> np.ndarray:
    """Which pairs share a filter with a number under `below`: those are counted there and not here."""
    kept = [x[x < below] for x in lists]
    rows = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    _, cols, often = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
    common = often[cols] > 1
    rows, cols = rows[common], cols[common]
    at, cols = np.unique(cols, return_inverse=True)
    has = np.zeros((len(kept), len(at)), np.float32)
    has[rows, cols] = 1
    return has @ has.T > 0


def _verify(cosine: float):
    """Rows of two blocks of a filter -> for each vector its links counted here, and edges that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, tos = [], [], []
            members = batch.column("members")
            ends = members.offsets.to_numpy()
            flat = members.values
            node, many, side = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("node", "many", "side"))
            vector, lists = flat.field("vector"), flat.field("filters")
            v_at, v_all = vector.offsets.to_numpy(), vector.values.to_numpy(zero_copy_only=False)
            f_at, f_all = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for number, a, b in zip(batch.column("filter").to_pylist(), ends[:-1], ends[1:]):
                at = a + np.argsort(side[a:b], kind="stable")
                n, cross = len(at), bool(side[a:b].any())
                left = int((side[at] == 0).sum()) if cross else n
                units = units_of(np.stack([v_all[v_at[k] : v_at[k + 1]] for k in at]).astype(np.float64))
                near = (units[:left] @ (units[left:] if cross else units).T) >= cosine
                if not cross:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                linked = near
                if cross:
                    linked = np.zeros((n, n), bool)
                    linked[:left, left:] = near
                    linked |= linked.T
                some = np.nonzero(linked.any(axis=1))[0]
                linked, at = linked[np.ix_(some, some)], at[some]
                here = linked & ~_share_earlier([f_all[f_at[k] : f_at[k + 1]] for k in at], number)
                links, to = here @ many[at], np.full(len(at), -1)
                u, v = spanning(linked)
                to[u] = v
                nodes.append(node[at])
                counts.append(links)
                tos.append(np.where(to >= 0, node[at][to], node[at]))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes, counts, tos)], names=["node", "links", "to"])

    return run


def usable(vector) -> F.Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vectors -> (id_col, n_links long, component_id, kept), a row for each row of the input.

    Pairs with cosine of at least `cosine`, in double precision, are links. Null, empty and zero vectors, those
    with null or non-finite components and those with a null id link with nothing: n_links 0, a component of their own.
    Vectors of different lengths don't link. Exact copies (repeated rows too) are one class that is joined once and
    counted by its size. Filters that hold the same vectors count as one of them. A filter of over `block` classes is
    dealt into blocks, and each two blocks meet in a row of their own; a pair that shares several filters is counted in the
    first. No pair is emitted: rows carry counts and forests."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    good = usable(F.col("vector")) & F.col("id").isNotNull()
    plain = F.transform("vector", lambda x: x + F.lit(0))  # -0.0 becomes 0.0
    vector = F.when(good, plain)
    rows, _ = written(v.select("id", vector.alias("vector"), F.sha2(F.to_json(F.struct(vector.cast("array<double>").alias("x"))), 256).alias("key")), "vectors")
    classes = rows.where("vector is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"), F.any_value("vector").alias("vector"))
    # Classes are nodes by a number of their own: rows of one id may hold several vectors.
    classes, at_classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("vector").alias("length")).count().collect()  # a row for each length of vectors
    codewords = {r["length"]: codewords_for(r["count"], r["length"]) for r in sizes}
    coded, at_coded = written(classes.select("node", "many", "vector", filters_of(F.col("vector"), codewords).alias("filters")), "coded")
    # Classes of a length meet only among themselves.
    met = coded.select("node", F.size("vector").alias("length"), F.explode("filters").alias("filter")).select("node", F.struct("length", "filter").alias("place"))
    met, at_met = written(met, "met")
    places = met.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places, at_places = written(places.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "places")
    held = join_hot(met, places, "place", "n", places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    small = held.where("blocks = 1").groupBy("place").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # at most `block`
    small = small.groupBy("nodes").agg(F.min("place").alias("place")).select(F.explode("nodes").alias("node"), "place", F.lit(1).alias("blocks"))
    held, at_held = written(small.unionByName(held.where("blocks > 1").select("node", "place", "blocks")), "held")
    carried = held.groupBy("node").agg(F.array_sort(F.collect_list("place.filter")).alias("filters")).join(coded.drop("filters"), "node")
    dealt = held.join(carried, "node").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))
    member = F.struct("node", "many", (F.col("mine") != F.col("i")).cast("int").alias("side"), "vector", "filters")
    together = dealt.groupBy("place", "i", "j").agg(F.collect_list(member).alias("members"))
    found = together.where(F.size("members") > 1).select(F.col("place.filter").alias("filter"), "members").mapInArrow(_verify(cosine), "node long, links long, to long")
    found, at_found = written(found, "found")
    drop(spark, at_coded, at_met, at_places, at_held)
    components = connected_components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.select("key", "node", "many", "least").join(links, "node", "left").join(components, "node", "left")
    by_class = by_class.select("key", "many", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("of"))
    by_class, at_joined = written(by_class, "joined")
    named = by_class.groupBy("of").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("classes"))
    by_class, _ = written(join_hot(by_class, named, "of", "classes", by_class.count()).select("key", "many", "n_links", "component"), "by_class")
    drop(spark, at_classes, at_found, at_joined)
    total = by_class.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    out = rows.where("vector is not null").select("id", "key")
    out = join_hot(out, by_class, "key", "many", total)
    out = out.select("id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links,
       r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""
