"""The prefix trie against plain Python dictionaries, and against its SQL on other tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scrutin.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, pos string, key string, owner string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own, seen = {}, defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            seen[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    own = {c: [v[3] for v in sorted(vs)] for c, vs in seen.items()}
    nodes, ends, kids = defaultdict(set), defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path = tuple(own.get(first, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((str((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(n)))) for n, m in nodes.items())


def compare(spark, rows, parts=7):
    df = spark.createDataFrame([(*r, *("d n p k o".split())) for r in rows], SCHEMA).repartition(parts)
    got = prefixes.trie(df).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == plain(rows)
    # Intervals: places are 1..n, a child lies within its parent, and n_leaves and the subtree agree with them.
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert sorted(r["place"] for r in got) == list(range(1, len(got) + 1))
    for r in got:
        if r["parent_conv_id"] is not None:
            p = by[r["parent_conv_id"], r["depth"] - 1]
            assert p["place"] < r["place"] <= r["end"] <= p["end"]
        assert r["n_leaves"] == sum(x["n_children"] == 0 for x in got if r["place"] <= x["place"] <= r["end"])


def test_random_tables(spark):
    """Nulls everywhere, ties in turn, repeated rows, negative ids, families without a first conversation."""
    rng = random.Random(3)
    ids = [None, *range(-130, 130), *range(1001, 1060)]
    compare(spark, [(rng.choice(ids), rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, "", "u"]), rng.choice([None, "", "a", "aé", ",b"])) for _ in range(1500)])


def test_one_long_conversation_and_copies(spark):
    """A conversation with most turns, others that leave it at every depth, and a group of copies with a third of the ids."""
    long_ = [(7, i, "u", str(i % 5)) for i in range(600)]
    leaving = [(c, i, "u", str(i % 5) if i < c - 8 else f"x{c}") for c in range(8, 40) for i in range(c)]
    copies = [(c, i, "u", "same") for c in range(200, 240) for i in range(3)]
    compare(spark, long_ + leaving + copies)


def test_copies_of_a_group_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    compare(spark, [(c, 0, "u", "same") for c in range(300)])


def test_empty_and_turnless(spark):
    compare(spark, [])
    compare(spark, [(None, 1, "u", "x")])
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    compare(spark, [(turnless, 0, "u", "x"), (turnless + 100, 1, None, None)])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    got = prefixes.op13_prefixes(spark, f"/root/testdata/{sf}")
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got.collect()) == plain([tuple(r) for r in rows])
