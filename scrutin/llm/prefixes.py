"""Conversation prefix trie by preorder intervals.

A node is a prefix that conversations share, and its name is its smallest member and its depth: so each conversation owns
a run of nodes, those below the point where it leaves the path of a smaller one. The path of a run is the list of the
points at which runs leave each other, and nodes are ranked by lexicographic order of these paths: a run from its top down,
then the runs that leave it, the deepest first. Each node is then an interval of that order, from its own place to the end
of its subtree, and leaves and savings of a subtree are differences of running sums over one distributed sort. Prefixes
are told apart by 128 bits summed over their turns, so no conversation is ever gathered, however many turns it has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running
from .shared import join_hot, table, written

#: Conversations are in families of so many ids; a member begins with up to LONGEST_HEAD - 1 turns of the family's first.
FAMILY, LONGEST_HEAD = 100, 6
#: Bytes of a list of ids that are hashed as one row.
BLOCK = 1 << 16
#: Above any depth; a path's elements count down from it, so that the deepest comes first.
DEEP = 0xFFFFFFFF


def _kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, key, chars): role and text as one hash, the text's code points. Ties in turn are ordered by the hash."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("key"), F.char_length(text).cast("long").alias("chars"))
    rows = _kept(rows.where("conv is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    return running(rows, ["conv"], ["turn", "key", "row"], {"pos": ("sum", F.lit(1).cast("long"))}, _kept).select("conv", "pos", "key", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own: turns() -> members (conv, turns) and rows (conv, depth, key, chars): the head of the family's first conversation,
    then the member's own turns after a head of its length."""
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % LONGEST_HEAD).alias("head")
    counted = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", head, (F.col("conv") - F.col("conv") % FAMILY).alias("first"))
    starts = own.where(F.col("pos") < LONGEST_HEAD).groupBy(F.col("conv").alias("first")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("starts"))  # at most LONGEST_HEAD - 1
    members = counted.join(starts, "first", "left")
    members = members.withColumn("starts", F.when(F.col("starts").isNull() | (F.col("head") == 0), F.array().cast("array<struct<pos:bigint,key:string,chars:bigint>>")).otherwise(F.slice("starts", 1, F.greatest(F.col("head"), F.lit(1)))))
    members = _kept(members.select("conv", "n", "head", "starts", F.size("starts").cast("long").alias("taken")), "members")
    begun = members.select("conv", F.explode("starts").alias("s")).select("conv", F.col("s.pos").alias("depth"), "s.key", "s.chars")
    by_conv = members.select("conv", "n", F.col("n").alias("rows"), "head", "taken")
    after = join_hot(own, by_conv, "conv", "rows", own.count()).where("pos > head")
    rows = begun.unionByName(after.select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "key", "chars"))
    return members.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("turns")), rows


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def member_hashes(ends: DataFrame) -> DataFrame:
    """ends(node, conv) -> (node, ends_sha256) of the decimal conv_ids, ascending, comma-joined.

    A hash is read in order by one task; what goes there is blocks of joined text, streamed, not rows."""
    kind = ends.schema["node"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        node, begin, ids = None, 0, []

        def close() -> None:
            nonlocal size
            if ids:
                made.append((node, begin, ",".join(ids).encode()))
                size += len(made[-1][2])

        def out() -> pa.RecordBatch:
            nodes, begins, texts = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(begins, pa.int64()), pa.array(texts, pa.binary())], names=["node", "conv", "ids"])

        for b in batches:
            for n, c in zip(b.column("node").to_pylist(), b.column("conv").to_pylist()):
                if n != node or len(ids) * 8 >= BLOCK:
                    close()
                    node, begin, ids = n, c, []
                ids.append(str(c))
            if size > 16 * BLOCK or len(made) > 10_000:
                yield out()
                made, size = [], 0
        close()
        if made:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done: list[tuple] = []
            for n, text in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if n == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    sorted_ = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    joined = sorted_.mapInArrow(blocks, f"node {kind.simpleString()}, conv long, ids binary")
    return joined.repartition("node").sortWithinPartitions("node", "conv").select("node", "ids").mapInArrow(hashes, f"node {kind.simpleString()}, ends_sha256 string")


def trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place, end).

    place is the node's rank in the order of paths, from 1, and end the rank of the last node of its subtree. Null roles
    and texts are empty; null turns come first, ties in turn by a hash of role and text, so repeated rows are turns of their
    own. Rows without a conversation belong to none. Empty table: no nodes. Very long texts are hashed where they are read.
    Other columns are not read."""
    spark = conversations.sparkSession
    members, rows = rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col))
    # A prefix's name: its depth and 128 bits, the exclusive or over its turns of hashes of (depth, turn).
    rows = rows.withColumns({"h1": F.xxhash64("depth", "key"), "h2": F.xxhash64("key", "depth")})
    rows = running(rows, ["conv"], ["depth"], {"i1": ("xor", F.col("h1")), "i2": ("xor", F.col("h2"))}, _kept)
    named = rows.select("conv", "depth", "chars", _hex(F.col("depth"), 8).alias("d"), "i1", "i2", "h1", "h2")
    name = lambda depth, a, b: F.concat(_hex(depth, 8), _hex(a, 16), _hex(b, 16))
    on_path = named.select("conv", "depth", "chars", name(F.col("depth"), F.col("i1"), F.col("i2")).alias("node"), F.when(F.col("depth") == 1, "").otherwise(name(F.col("depth") - 1, F.col("i1").bitwiseXOR(F.col("h1")), F.col("i2").bitwiseXOR(F.col("h2")))).alias("parent"))
    root = members.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"))
    on_path = _kept(on_path.unionByName(root), "on_path")
    n_rows = on_path.count()
    nodes = on_path.groupBy("node").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("parent").alias("parent"))
    nodes = _kept(nodes, "nodes")
    n_nodes = nodes.count()
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = _kept(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("times"))
    # The path of a run: which runs it passes through, and the depth at which it enters each.
    owned = join_hot(on_path.select("conv", "depth", "node"), nodes.select("node", F.col("owner").alias("_owner"), F.col("n_convs").alias("times")), "node", "times", n_rows)
    steps = owned.groupBy("conv", "_owner").agg(F.min("depth").alias("enters"), F.max("depth").alias("leaves"))
    element = lambda s: F.concat(_hex(DEEP - (s["enters"] - 1), 8), _hex(s["run"], 16))
    path = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("enters", F.col("_owner").alias("run")))), lambda s: s["enters"] > 0), element), "")
    runs = steps.groupBy("conv").agg(path.alias("path"), F.max(F.when(F.col("_owner") == F.col("conv"), F.col("leaves") - F.col("enters") + 1)).alias("length"))
    runs = _kept(runs.where("length is not null").withColumnRenamed("conv", "owner"), "runs")
    # Each node enters before what is below it and leaves after it.
    laid = join_hot(nodes, runs, "owner", "length", n_nodes)
    enters = F.struct(F.concat("path", F.lit("00000000"), _hex(F.col("depth"), 8)).alias("at"), F.lit(1).cast("long").alias("one"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    leaves = F.struct(F.concat("path", _hex(DEEP - F.col("depth"), 8), F.lit("G")).alias("at"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    events = laid.select("node", F.explode(F.array(enters, leaves)).alias("e")).select("node", "e.*")
    summed = running(events, [], ["at"], {"ones": ("sum", F.col("one")), "leafs": ("sum", F.col("leaf")), "saveds": ("sum", F.col("saved"))}, _kept)
    sign = F.when(F.col("one") == 1, -1).otherwise(1)
    spans = summed.groupBy("node").agg(F.max(F.when(F.col("one") == 1, F.col("ones"))).alias("place"), F.max(F.when(F.col("one") == 0, F.col("ones"))).alias("end"), F.sum(sign * (F.col("leafs") - F.col("leaf"))).alias("n_leaves"), F.sum(sign * (F.col("saveds") - F.col("saved"))).alias("saved_tokens"))
    ends = on_path.join(members.select("conv", F.col("turns").alias("depth")), ["conv", "depth"], "left_semi").select("node", "conv")
    out = join_hot(nodes.where("parent is not null"), above, "parent", "times", n_nodes).select("node", "parent_conv_id")
    out = nodes.join(out, "node", "left").join(spans, "node").join(member_hashes(ends), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "place", "end")


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("place", "end")


#: Every prefix of every conversation as the text of its turns' hashes, and each with all that begin with it.
OP13_SQL = """
WITH RECURSIVE crc(conv, head, bit, c) AS (  -- crc32 of a decimal, bit by bit
    SELECT conv, CAST(conv AS VARCHAR), 0, xor(4294967295, ascii(CAST(conv AS VARCHAR))) FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv FROM conversations WHERE conv_id IS NOT NULL)
    UNION ALL
    SELECT conv, head, bit + 1, xor(xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), CASE WHEN (bit + 1) % 8 = 0 AND (bit + 1) // 8 < len(head) THEN ascii(head[(bit + 1) // 8 + 1]) ELSE 0 END)
    FROM crc WHERE bit < 8 * len(head)
), heads AS MATERIALIZED (
    SELECT conv, conv - conv % 100 AS first, xor(c, 4294967295) % 6 AS head FROM crc WHERE bit = 8 * len(head)
), turns AS MATERIALIZED (
    SELECT conv, key, chars, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, key) AS pos
    FROM (SELECT CAST(conv_id AS BIGINT) AS conv, turn, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS MATERIALIZED (
    SELECT conv, key, chars, row_number() OVER (PARTITION BY conv ORDER BY own, pos) AS depth
    FROM (SELECT h.conv, key, chars, 0 AS own, pos FROM heads h JOIN turns t ON t.conv = h.first AND pos <= head
          UNION ALL SELECT h.conv, key, chars, 1, pos FROM heads h JOIN turns t ON t.conv = h.conv AND pos > head)
), paths AS MATERIALIZED (
    SELECT conv, depth, chars, string_agg(key, '') OVER (PARTITION BY conv ORDER BY depth) AS path, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM rebuilt
    UNION ALL SELECT conv, 0, 0, '', conv NOT IN (SELECT conv FROM rebuilt) FROM heads
), nodes AS MATERIALIZED (
    SELECT path, CAST(any_value(depth) AS BIGINT) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        CASE WHEN path = '' THEN NULL ELSE left(path, len(path) - 64) END AS parent,
        sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
    FROM paths GROUP BY path
), children AS MATERIALIZED (SELECT parent AS path, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1)
SELECT a.conv_id, a.depth, any_value(p.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, coalesce(any_value(c.n), 0) AS n_children,
    count(*) FILTER (WHERE b.path NOT IN (SELECT path FROM children)) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN nodes p ON p.path = a.parent LEFT JOIN children c ON c.path = a.path
GROUP BY a.conv_id, a.depth
"""
