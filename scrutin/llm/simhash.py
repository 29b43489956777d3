"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and the bit count of each segment is a coordinate. Two
fingerprints that differ in d bits are at most d apart in Manhattan distance over these coordinates, so that distance is
a lower bound. The range join "Manhattan distance at most 3" runs on a grid over each half of the coordinates, whose cells
are the counts of its 16 segments: of a pair within distance 3, one half is within distance 1, so it meets where each
fingerprint looks into its own cell and the cells one step up in each half. What meets is pruned by the distance over all
coordinates, and the exact count of differing bits decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, drop, join_hot, table, written

SEED = 42
SHINGLE = 3
MOST_BITS = 3
#: Two-bit segments in each half: with a distance of at most MOST_BITS, at most one of it falls on one of the two halves.
HALF = 16
#: Fingerprints per block of a large cell; a task compares two blocks at a time.
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Words are runs without ASCII white space, A-Z lowered; each run of `shingle` words (fewer: all of them) is hashed
    by XXH64, and a bit of the fingerprint is set if over half of the hashes set it. Null, empty or blank: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    starts, ends = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, 32768):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 32768], ends[at : at + 32768])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


fingerprints = _fingerprints.asNondeterministic()  # its cost, not its value: it is never run twice for a row


def _counts(fp) -> F.Column:
    """The embedding: 32 bit counts of 0 to 2, each in its own two bits of a long."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def _cells(fp) -> F.Column:
    """For each half the own cell, then the cells that are one step up in one coordinate (null where it is at its top)."""
    out = []
    for half in (0, 1):
        counts = F.shiftrightunsigned(_counts(fp), 2 * HALF * half).bitwiseAND(F.lit((1 << 2 * HALF) - 1))
        own = counts + F.lit(half << 2 * HALF)
        up = [F.when(F.shiftrightunsigned(counts, 2 * k).bitwiseAND(F.lit(3)) < 2, own + F.lit(1 << 2 * k)) for k in range(HALF)]
        out += [own, *up]
    return F.array(*out)


def _embedded(fps: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits[:, 0::2] + bits[:, 1::2]).astype(np.int8)


def _linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of a are within `most` bits of which of b: by the lower bound first, exactly for what it leaves."""
    out = np.zeros((len(a), len(b)), bool)
    ea, eb = _embedded(a), _embedded(b)
    for i in range(0, len(a), 64):
        near = np.abs(ea[i : i + 64, None, :] - eb[None, :, :]).sum(axis=2, dtype=np.int16) <= most
        x, y = np.nonzero(near)
        out[i + x, y] = np.bitwise_count(a[i + x] ^ b[y]) <= most
    return out


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects what the symmetric matrix connects, at most one for each row."""
    free, us, vs = linked.any(axis=1), [], []
    while free.any():
        root = int(np.argmax(free))
        free[root], frontier = False, np.array([root])
        while len(frontier):
            frontier = np.nonzero(linked[frontier].any(axis=0) & free)[0]
            free[frontier] = False
            us.append(frontier)
            vs.append(np.full(len(frontier), root))
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def _edges(most: int):
    """Rows of two blocks of a cell (the second empty: one block with itself) -> edges that connect what is linked. Those
    that only look into the cell don't meet each other."""

    def met(own: np.ndarray, looking: np.ndarray, other: np.ndarray, others_looking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, n = np.concatenate([own, looking, other, others_looking]), len(own) + len(looking)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        if n == len(nodes):
            linked[: len(own)] = _linked(own, nodes, most)
        else:
            linked[: len(own), n:] = _linked(own, nodes[n:], most)
            linked[len(own) : n, n : n + len(other)] = _linked(looking, other, most)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        i, j = spanning(linked)
        return nodes[i].view(np.int64), nodes[j].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in ("own", "looking", "other", "others_looking"):
                lists = batch.column(name)
                columns.append((lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            found = [met(*[flat[ends[k] : ends[k + 1]] for ends, flat in columns]) for k in range(len(batch))]
            if found:
                u, v = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def fingerprint_links(distinct: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """distinct(fp long) -> edges (u, v) of fingerprints that connect all pairs within `most` bits and no others.

    Cells that no fingerprint has as its own are left out first. A cell of over `block` fingerprints is dealt into blocks
    by hash, and each two of them meet in a row of their own: a hot cell becomes many bounded tasks. Each row gives a
    spanning forest, not its pairs."""
    if most > MOST_BITS:
        raise ValueError(f"the grid's cells are complete for at most {MOST_BITS} bits")
    cells = distinct.select("fp", F.posexplode(_cells(F.col("fp"))).alias("at", "cell")).where("cell is not null")
    cells = cells.select("fp", "cell", (F.col("at") % (HALF + 1) == 0).alias("in_it"))
    useful = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_it").alias("members")).where("members > 0 and n > 1")
    useful, _ = written(useful.select("cell", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "useful")
    total = useful.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = join_hot(cells, useful, "cell", "n", total)
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.select("fp", "cell", "in_it", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("fp", "cell", "in_it", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine")
    first = F.col("mine") == F.col("i")
    sides = {"own": first & F.col("in_it"), "looking": first & ~F.col("in_it"), "other": ~first & F.col("in_it"), "others_looking": ~first & ~F.col("in_it")}
    together = dealt.groupBy("cell", "i", "j").agg(*[F.collect_list(F.when(is_, F.col("fp"))).alias(k) for k, is_ in sides.items()])
    together = together.where(F.size("own") + F.size("other") > 0).where(sum((F.size(k) for k in sides), F.lit(0)) > 1)
    return together.select(*sides).mapInArrow(_edges(most), "u long, v long")


def components(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """distinct(fp long) -> (fp, component), a row for each; a component is known by a fingerprint in it."""
    distinct, _ = written(distinct, "distinct")
    edges, path = written(fingerprint_links(distinct, most), "links")
    nodes = connected_components(edges)
    drop(distinct.sparkSession, path)
    return distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """docs -> (id_col, fp long, component_id), a row for each row of docs; component_id is the smallest id reachable.

    Copies share a fingerprint, so only distinct fingerprints are joined, however large a group of copies is, and the rows
    of a large group are not brought together (join_hot). Null,
    empty and blank texts have fingerprint zero and link like any other. A null id gets a component but never names one
    (null, if its component has no other). Repeated rows stay, each with its component. Other columns are not read."""
    prints, _ = written(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprints(F.col(f"`{text_col}`")).alias("fp")), "prints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    labelled = classes.join(components(classes.select("fp"), most), "fp")
    names = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.min("least").alias("component_id"))
    total = labelled.count()
    named = join_hot(labelled.select("component", "fp", "n"), names, "component", "classes", total)
    named, _ = written(named.select("fp", "n", "component_id"), "named")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(prints, named, "fp", "n", total).select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
