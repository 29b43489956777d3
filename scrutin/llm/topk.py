"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into shards. In each dimension a component is quantised to one of LEVELS, and the ids of a level are a
posting segment. For a query a component's impact is its distance from the dimension's worst value (the lowest for a
positive weight, the highest for a negative one), so a segment adds at least its quantised impact times the weight to the
score of its ids. Segments of all dimensions are processed by descending quantised impact times weight. At any point a
vector's score lies between its accumulator and that plus what the segments that are left and the quantising can add; a
query stops only when this proves that few vectors can still be among its k best, and those are scored exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table, written

SCALE = 256
EVERY = 50
K = 5
#: Levels of a dimension; vectors per shard of the index; queries per block at most and at least (between them, blocks
#: are as many as it takes to keep the cluster busy).
LEVELS = 32
SHARD = 32_768
QUERY_BLOCK, LEAST_BLOCK = 16_384, 128
#: The proof is tried whenever another such share of a query's postings has been summed; so few possible members end the
#: query.
TRIES = 16
RESCORE = 512
#: Sums of products below this are exact in doubles; shards and queries beyond it are scored in whole numbers of any size.
EXACT = 1 << 53


class ImpactIndex:
    """Posting segments of one shard. values: int64, a row for each vector."""

    def __init__(self, values: np.ndarray):
        n, dims = values.shape
        self.values, self.low, self.high = values, values.min(axis=0), values.max(axis=0)
        self.step = (self.high - self.low) // LEVELS + 1
        level = (values - self.low) // self.step
        key = (level + np.arange(dims) * LEVELS).T.ravel()
        order = np.argsort(key, kind="stable")
        self.postings = order % n  # ids by dimension and level
        self.ends = np.searchsorted(key[order], np.arange(dims * LEVELS + 1))

    def impacts(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """What each segment (dimension, level) adds at least, and how much more all dimensions can add by quantising."""
        weight, at = np.abs(query), np.arange(LEVELS)
        up = at * self.step[:, None]
        down = np.maximum(0, (self.high - self.low)[:, None] + 1 - (at + 1) * self.step[:, None])
        return weight[:, None] * np.where(query[:, None] > 0, up, down), int(weight @ (self.step - 1))

    def search(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions that may be among the query's k best, other than those in `own`, and their exact scores: all of
        the k best are among them."""
        n = len(self.values)
        impact, slack = self.impacts(query)
        used = np.nonzero((impact.ravel() > 0) & (np.diff(self.ends) > 0))[0]
        used = used[np.argsort(-impact.ravel()[used], kind="stable")]
        lengths = self.ends[used + 1] - self.ends[used]
        done = np.searchsorted(np.cumsum(lengths), np.arange(1, TRIES + 1) / TRIES * lengths.sum(), side="right") if len(used) else np.zeros(TRIES, int)
        done[-1], gained, left = len(used), np.zeros(n), np.zeros(impact.size, impact.dtype)
        left[used] = impact.ravel()[used]
        for begin, end in zip([0, *done[:-1].tolist()], done.tolist()):
            some = used[begin:end]
            if len(some):
                ids = np.concatenate([self.postings[self.ends[s] : self.ends[s + 1]] for s in some.tolist()])
                gained += np.bincount(ids, np.repeat(left[some].astype(float), lengths[begin:end]), n)
                left[some] = 0
            rest = slack + int(left.reshape(impact.shape).max(axis=1).sum())
            open_ = gained.copy()
            open_[own] = -np.inf
            best = np.partition(open_, n - k)[n - k] if n > k else -np.inf
            possible = np.nonzero((open_ > -np.inf) & (open_ + rest >= best))[0]
            if len(possible) <= max(RESCORE, 2 * k) or end == len(used):
                break
        return possible, self.values[possible] @ query


class Plain:
    """A shard whose sums of products may not fit a double: every vector is scored, in Python's integers."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(object)

    def search(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.setdiff1d(np.arange(len(self.values)), own)
        score = self.values[at] @ query.astype(object)
        if len(at) and max(score.max(), -score.min()) >= 1 << 63:
            raise ValueError(f"a score of {max(score.max(), -score.min())} doesn't fit a long")
        return at, score.astype(np.int64)


def _search(k: int):
    def vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("id").to_numpy(), rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        if len(candidates) and len(asked):
            (ids, values), (queries, weights) = vectors(candidates), vectors(asked)
            largest = [max(int(x.max()), -int(x.min())) for x in (values, weights)]
            index = ImpactIndex(values) if values.shape[1] * (largest[0] + 1) * 2 * (largest[1] + 1) < EXACT else Plain(values)
            where = {x: i for i, x in enumerate(ids.tolist())}
            for qid, query in zip(queries.tolist(), weights):
                own = where.get(qid)
                at, score = index.search(query, k, np.array([] if own is None else [own], np.int64))
                top = np.lexsort((ids[at], -score))[:k]
                found.append((np.full(len(top), qid), ids[at[top]], score[top]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """candidates(id long, vector array<long>), queries(id, vector) -> (query_id, rank, vec_id, score), exact.

    A query's own id is no candidate; ties go to the smaller id; fewer than k candidates are all returned. Vectors meet
    only those of their length. Null ids, null and empty vectors and those with nulls take no part; rows that repeat an id
    are one candidate or query, that with the least vector by its components, whatever the order of rows. Scores are exact
    whatever the components; one that doesn't fit a long is an error. Each shard of candidates meets each block of queries in a task of bounded size that builds the shard's
    index and returns k rows for each query; blocks grow with the queries, so that candidates are sent to few of them."""
    whole = F.col("id").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    c, q = (df.where(whole).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("length", F.size("vector")) for df in (candidates, queries))
    n_queries, shards = q.count(), max(1, -(-c.count() // SHARD))
    busy = -(-2 * c.sparkSession.sparkContext.defaultParallelism // shards)
    blocks = max(1, -(-n_queries // QUERY_BLOCK), min(-(-n_queries // LEAST_BLOCK), busy))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    c = c.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "block": every(blocks)})
    q = q.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "shard": every(shards)})
    together = ["length", "shard", "block"]
    found = c.groupBy(*together).cogroup(q.groupBy(*together)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row whose vec_id is divisible by EVERY against all others, by components floor(SCALE * x).

    Vectors null, empty or with null or non-finite components and rows with a null id take no part, neither as queries nor
    as candidates; zero vectors do, with score 0. Of rows that repeat an id that with the
    least vector takes part. A component beyond a long is an error. Other columns are not read."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(*integers(e))


def integers(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries of (id, vector): finite vectors as integers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    beyond = F.raise_error(F.lit("a component doesn't fit a long")).cast("long")
    scaled = lambda x: x.cast("double") * SCALE
    ints = F.transform("vector", lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(beyond))
    e, _ = written(e.where(finite).select("id", ints.alias("vector")), "ints")
    return e, e.where(F.col("id") % EVERY == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
