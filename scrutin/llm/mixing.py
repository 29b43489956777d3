"""Mixing sources to target weights.

Tokens are summed per source, repetition rates follow from the targets, and each document is emitted floor(rate) times
plus one copy drawn by a seeded hash of its id with probability equal to its source's fraction.

A few long documents can hold much of a source, and one seed's draws could then miss its target by far. So each source
has a seed of its own: of SEEDS seeds, whose draws are independent, the one whose draws come nearest its target. Every
document of a source is drawn at the same fraction by the same seed. With seeds=1 nothing is chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, join_hot, running, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
SEED = "mix-1"
#: Seeds that a source chooses from.
SEEDS = 32
#: Rates of up to so many sources (some MB) go to every executor; of more, only those of hot sources do.
BROADCAST_SOURCES = 50_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_rates(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sized(source, size, ...) -> (source, n_docs, source_size, target, rate), one row per source.

    Sources in code point order, null last, take the weights in turn. Together they share all words; a target stops at
    `most` times its source's size, and the excess is shared again by weight until none is above. In closed form: with
    sources in ascending order of most * size / weight, those before the first whose level holds stop, and the rest
    share what is left by weight. Documents are summed by partial sums, so a source with a third of all rows is no hot
    key, and both orders of sources are range partitions, so any number of sources will do."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], {"nth": F.lit(1).cast("long")})
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights)))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    per = running(per, by_level, {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    words, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(words) - F.col("cap_before")).cast("double") / (F.lit(weight) - F.col("weight_before"))
    holds = per.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    first = holds.agg(F.min(F.struct(F.col("cap") / F.col("weight"), "level"))["level"]).first()[0]
    target = F.lit(0.0) if first is None else F.least(F.col("cap").cast("double"), F.lit(first) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "n_docs", "source_size", "target", rate.alias("rate"))


def key_of(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def with_rates(rows: DataFrame, rates: DataFrame, n_docs: int) -> DataFrame:
    """rows(key, ...) with the columns of rates(key, n_docs, ...): a hot source's rows are not brought together."""
    rates, _ = written(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates.drop("n_docs")), "key")
    return join_hot(rows, rates, "key", "n_docs", n_docs)


def digest(key: Column, seed: str, group: Column | int) -> Column:
    """Four draws' bits that depend on the key, the seed and the group of seeds alone: reruns and retried tasks agree."""
    number = F.lit(group) if isinstance(group, int) else group
    return F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def draw(bits: Column, place: Column | int) -> Column:
    """A number in [0, 1): one of the four of a digest."""
    part = F.substring(bits, F.lit(1) + 8 * (F.lit(place) if isinstance(place, int) else place), F.lit(8))
    return F.conv(part, 16, 10).cast("double") / F.lit(4294967296.0)


def with_seeds(sized: DataFrame, rates: DataFrame, n_docs: int, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """rates plus seed_no: of all seeds the one whose draws come nearest what the fraction asks for (ties: the first).
    sized(key, size, id) is summed once, for all seeds side by side, with partial sums."""
    met = with_rates(sized, rates.select("key", "n_docs", "fraction"), n_docs)
    met = met.select("key", "size", "fraction", *[digest(F.col("id"), seed, g).alias(f"bits{g}") for g in range(-(-seeds // 4))])
    taken = [F.sum(F.when(draw(F.col(f"bits{k // 4}"), k % 4) < F.col("fraction"), F.col("size")).otherwise(F.lit(0))) for k in range(seeds)]
    sums = met.groupBy("key").agg(*[t.alias(f"t{k}") for k, t in enumerate(taken)]).join(rates, "key")
    off = lambda k: F.abs(F.col(f"t{k}") - (F.col("target") - F.floor("rate") * F.col("source_size")))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("seed_no")) for k in range(seeds)]))
    return sums.select(*rates.columns, best["seed_no"].alias("seed_no"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """A row of struct `row` (the document, all its columns) with size, source_size, target and copies.

    Null text: size 0, and like any empty text it is copied at its source's rate without adding words. Null source: a
    source of its own, after the others. Null id: drawn as the key "null". Repeated rows draw alike. Empty table: no
    rows. A source without words: target 0, copies 0. No document has more than `most` copies."""
    source = F.col(f"`{source_col}`")
    sized, path = written(docs.select(source.alias("source"), key_of(source).alias("key"), words_of(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{id_col}`").cast("string").alias("id")), "sized")
    rates = source_rates(sized, weights, most).withColumns({"key": key_of(F.col("source")), "fraction": F.col("rate") - F.floor("rate")}).drop("source")
    rates, _ = written(rates, "rates")
    n_docs = rates.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    seeded = with_seeds(sized, rates, n_docs, seed, seeds)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", key_of(F.col(f"row.`{source_col}`")).alias("key"), words_of(F.col(f"row.`{text_col}`")).alias("size"))
    met = with_rates(d, seeded, n_docs)
    drop(docs.sparkSession, path)
    once_more = draw(digest(F.col(f"row.`{id_col}`"), seed, F.floor(F.col("seed_no") / 4)), F.col("seed_no") % 4) < F.col("fraction")
    copies = F.least(F.floor("rate") + once_more.cast("long"), F.lit(most)).cast("long")
    return met.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each document's row once per copy, columns as in docs."""
    return mix(docs, **how).where("copies > 0").withColumn("_", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM per
), one AS (
  SELECT arg_min(lev, cap / weight) AS lev FROM levels WHERE lev * weight <= cap
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, one.lev * weight) AS target FROM levels, one
), rates AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), draws AS (
  SELECT doc_id, source, size, k AS seed_no, ('0x' || substr(md5('mix-1:' || k // 4 || ':' || coalesce(doc_id::VARCHAR, 'null')), 1 + 8 * (k % 4), 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized, range(32) AS seed(k)
), seeds AS (
  SELECT source, arg_min(seed_no, (off, seed_no)) AS seed_no FROM (
    SELECT r.source, seed_no, abs(coalesce(sum(size) FILTER (u < rate - floor(rate)), 0)::BIGINT - any_value(target - floor(rate) * source_size)) AS off
    FROM draws s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source GROUP BY r.source, seed_no
  ) GROUP BY source
), copies AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, least(3, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS copies
  FROM draws s JOIN seeds ON s.source IS NOT DISTINCT FROM seeds.source AND s.seed_no = seeds.seed_no JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copies
"""
