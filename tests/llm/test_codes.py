"""Vector codes against a plain Lloyd in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutin.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, x string, scans string"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector) -> {row number: (code, error)}, codebooks."""
    ints = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows]
    order = sorted(range(len(ints)), key=lambda r: (ints[r][0] is None, ints[r][0] or 0, ints[r][1]))
    width = len(ints[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in ints]
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]
    nearest = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def made(n, seed, copies=0.4, grid=8):
    """Few distinct values, so that distances tie; copies; repeated ids."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        v = rng.choice(rows)[1] if rows and rng.random() < copies else [rng.randrange(-grid, grid) / 4096 for _ in range(16)]
        rows.append((rng.randrange(n // 2), v))
    return rows


@pytest.mark.parametrize("n,grid", [(3, 2), (16, 2), (200, 2), (300, 400)])
def test_like_plain_lloyd(spark, n, grid):
    rows = made(n, n, grid=grid)
    df = spark.createDataFrame([(i, v, k % 3 or None, "c", "e", "x", "s") for k, (i, v) in enumerate(rows)], SCHEMA).repartition(5)
    got, books = codes.compress(df, keep=("label",))
    want, plain_books = plain(rows)
    assert books.tolist() == plain_books
    labels = [k % 3 or None for k in range(len(rows))]
    have = sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in got.select("vec_id", "label", codes.hex_code(F.col("code")).alias("code"), "error").collect())
    assert have == sorted((str(i), str(c), *w) for (i, _), c, w in zip(rows, labels, want))
    sums = {}
    for c, (_, e) in zip(labels, want):
        sums[c] = sums.get(c, 0) + e
    assert {r["label"]: r["label_error"] for r in codes.label_errors(got).collect()} == sums


def test_bounds_spare_scans_and_keep_ties():
    """Assignments under bounds equal plain scans round by round, and far from all parts are scanned."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (16, 1, 4))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 1, 4))).astype(np.int64)
    x[:500] = x[500]  # a group of copies
    book = codes.Codebook(x[490:506].transpose(1, 0, 2).copy())
    code, upper, lower, scans = np.zeros((4000, 1), np.int64), np.full((4000, 1), np.inf), np.full((4000, 1), -np.inf), np.zeros(4000, np.int64)
    for _ in range(8):
        codes.assign(x, book, code, upper, lower, scans)
        squared = ((x - book.entries[0][None]) ** 2).sum(axis=2)
        assert (squared.argmin(axis=1) == code[:, 0]).all()
        near = np.sort(squared, axis=1)
        assert (upper[:, 0] ** 2 >= near[:, 0]).all() and (lower[:, 0] <= np.sqrt(near[:, 1])).all()
        sums, counts = np.zeros_like(book.entries), np.bincount(code[:, 0], minlength=16)[None]
        np.add.at(sums[0], code[:, 0], x[:, 0])
        book = codes.Codebook(codes.updated(book.entries, sums, counts), book.entries)
    assert scans.sum() < 0.7 * 8 * 4000


def test_odd_rows(spark):
    good = [0.5] * 8
    bad = [None, [*good[:7], None], [*good[:7], float("nan")], [*good[:7], float("inf")], [*good[:7], float("-inf")]]
    rows = [(i, v, 1, None, None, None, None) for i, v in enumerate(bad)] + [(None, good, None, None, None, None, None), (9, good, None, None, None, None, None), (9, good, None, None, None, None, None)]
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, (r["vec_id"] for r in got.collect()))) == ["9", "9", "None"] and books.shape == (8, 3, 1)
    assert {(tuple(r["code"]), r["error"]) for r in got.collect()} == {((0,) * 8, 0)}
    none, books = codes.compress(spark.createDataFrame(rows[:5], SCHEMA))
    assert none.columns == ["vec_id", "code", "error", "scans"] and none.count() == 0 and books.size == 0
    for wrong in ([[0.5] * 8, [0.5] * 16], [[0.5] * 12], [[]], [[3e38] * 8], [[1e6] * 8]):
        with pytest.raises(Exception, match="equal parts|fit a long|OVERFLOW"):
            codes.compress(spark.createDataFrame([(i, v, 1, *(None,) * 4) for i, v in enumerate(wrong)], SCHEMA))


def test_query(spark):
    rows = codes.op11_codes(spark, "/root/testdata/sf0.001").collect()
    assert len({r["vec_id"] for r in rows}) == len(rows) == 500 and all(len(r["code"]) == 16 for r in rows)
    raw = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    want, books = plain([(r["vec_id"], r["embedding"]) for r in raw])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in rows} == {r["vec_id"]: w for r, w in zip(raw, want)}
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in rows} == {sha}
