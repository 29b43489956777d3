"""Running totals, the rate limiter and exact quantiles against plain loops, with keys over many partitions."""

from __future__ import annotations

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutin.operators import acta, automaton, limiter, quantiles, scan, state


def largest_part(spark, made):
    """The most rows of a range partition among the tables that running() wrote."""
    return max(r["n"] for df in made for r in df.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.fixture()
def kept(monkeypatch):
    made = []

    def write(df, name="rows"):
        made.append(scan_written(df, name))
        return made[-1]

    scan_written = scan.written
    monkeypatch.setattr(scan.running, "__defaults__", (write,))
    return made


@pytest.fixture()
def hundred(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_like_a_loop(spark, hundred, kept):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b", "c"]), i, rng.choice([None, *range(-5, 6)]), rng.getrandbits(60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, v long, h long").repartition(7)
    for key in (["k"], []):
        got = {r["i"]: r for r in scan.running(df, key, ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("xor", F.col("h"))}).collect()}
        assert len(got) == len(rows)
        state = {}
        for k, i, v, h in rows:
            s, m, x = state.get(k if key else 0, (None, None, 0))
            if v is not None:
                s, m = (s or 0) + v, v if m is None else max(m, v)
            state[k if key else 0] = (s, m, x ^ h)
            assert (got[i]["s"], got[i]["m"], got[i]["x"]) == (s, m, x ^ h)
    assert largest_part(spark, kept) < 400  # of 4,000 rows, half of them of one key
    assert scan.running(df.limit(0), ["k"], ["i"], {"s": ("sum", F.col("v"))}).count() == 0


def plain_limiter(outcomes, trip=3, delay=1.0, cooldown=60.0):
    fails, slept, out = 0, 0.0, []
    for kind in outcomes:
        slept += delay
        before = fails >= trip
        if before:
            slept, fails = slept + cooldown, 0
        sent = slept
        if kind == "limited":
            slept, fails = slept + cooldown, 0
        else:
            fails = fails + 1 if kind == "failed" else 0
        out.append((fails, before, kind == "limited", sent))
    return out


def test_limiter_like_a_loop(spark, hundred, kept):
    """One counter over a hundred partitions, of which several lie within one run of failures."""
    rng = random.Random(7)
    kinds = rng.choices(["ok", "failed", "limited"], (5, 5, 1), k=2600) + ["failed"] * 400
    df = spark.createDataFrame([(i, k if k != "ok" or i % 2 else None) for i, k in enumerate(kinds)], "i long, kind string").repartition(11)
    rows = limiter.limiter(df, ["i"], F.col("kind") == "failed", F.col("kind") == "limited")
    got = {r["i"]: (r["fails"], r["pause_before"], r["pause_after"], r["sent_s"]) for r in rows.collect()}
    want = plain_limiter(kinds)
    assert [got[i] for i in range(len(kinds))] == want
    assert largest_part(spark, kept) < 300
    pauses = sorted((r["i"], r["kind"], r["starts_s"], r["ends_s"]) for r in limiter.pauses(rows).collect())
    assert pauses == sorted([(i, "fallos", s - 60, s) for i, (_, b, _, s) in enumerate(want) if b] + [(i, "limite", s, s + 60) for i, (_, _, a, s) in enumerate(want) if a])
    assert all(a[3] <= b[2] for a, b in zip(sorted(pauses, key=lambda p: p[2]), sorted(pauses, key=lambda p: p[2])[1:]))
    assert sum(r["trips"] for r in limiter.runs(rows, at="i").collect()) == sum(f == 3 for f, *_ in want)


def test_limiter_by_session(spark):
    rng = random.Random(2)
    weights = {"a": (1, 3, 0), "b": (0, 1, 0), "c": (1, 0, 0), "d": (0, 0, 1), "e": (1, 40, 1)}
    rows = [(s, i, rng.choices([None, "failed", "limited"], weights[s])[0]) for i, s in enumerate(rng.choices("abcde", k=500))]
    df = spark.createDataFrame(rows, "s string, i long, kind string")
    got = limiter.limiter(df, ["i"], F.col("kind") == "failed", F.col("kind") == "limited", key=["s"]).collect()
    for s in weights:
        own = sorted((r["i"], r["fails"], r["pause_before"], r["pause_after"], r["sent_s"]) for r in got if r["s"] == s)
        assert [o[1:] for o in own] == plain_limiter([k for x, _, k in rows if x == s])


def test_transport_failed(spark):
    rows = [(200, "", False), (429, "", False), (404, None, False), (500, "", True), (0, "", True), (None, None, True), (200, "TIMEOUT", True)]
    df = spark.createDataFrame(rows, "status int, error string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", limiter.transport_failed(F.col("status"), F.col("error")).alias("got")).collect())


def test_quantiles_like_percentile(spark, hundred, kept):
    rng = random.Random(4)
    values = lambda n: [rng.choice([None, rng.randrange(50) / 7, rng.gauss(0, 1e3)]) for _ in range(n)]
    rows = [("all", v) for v in values(5000)] + [(None, v) for v in values(50)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    shares = {"low": 0.25, "mid": 0.5, "high": 0.95, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in quantiles.quantiles(df, "g", "v", shares).collect()}
    assert set(got) == {g for g, _ in rows}
    want = {r["g"]: r for r in df.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", s).alias(k) for k, s in shares.items()]).collect()}
    for g in got:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == want[g]["n"] == len(own)
        for k in shares:
            assert got[g][k] == (pytest.approx(want[g][k], rel=1e-12, abs=1e-12) if own else None), (g, k)
        assert not own or got[g]["mid"] == pytest.approx(median(own)) == pytest.approx(float(np.median(own)))
    assert largest_part(spark, kept) < 400
    assert quantiles.quantiles(df.limit(0), "g", "v", shares).count() == 0


def test_peers_of_one_group(spark):
    rows = [("g", float(i)) for i in range(1, 2002)] + [("h", None), (None, 5.0)]
    got = acta.ratio_vs_peers(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v")).collect()
    assert len(got) == 2002 and {r["v"]: r["ratio"] for r in got if r["g"] == "g"} == {v: round(v / 1001, 6) for g, v in rows if g == "g"}
    mean = acta.ratio_vs_peers(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v"), "mean").collect()
    assert {r["v"]: r["ratio"] for r in mean if r["g"] == "g"} == {v: round(v / 1001, 6) for g, v in rows if g == "g"}


def plain_transports(calls, trip=3, reprobe=50):
    fails, since, fallback, used = 0, 0, False, []
    for bad in calls:
        if not fallback and fails >= trip:
            fallback, since, fails = True, 0, 0
        since += fallback
        fallback = fallback and not (since % reprobe == 0 and not bad)
        used.append("fallback" if fallback else "primary")
        fails = fails + 1 if bad and not fallback else 0
    return used


def test_transports_over_a_hundred_partitions(spark, hundred, monkeypatch):
    made = []
    real = automaton.written
    monkeypatch.setattr(automaton, "written", lambda df, name: made.append(real(df, name)) or made[-1])
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i, rng.choice([None, True, False, i // 200 % 2 == 0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, i long, bad boolean").repartition(9)
    for key, reprobe in ((["s"], 7), ([], 50)):
        got = {r["i"]: r["transport"] for r in state.transports(df, key, ["i"], "bad", reprobe=reprobe).collect()}
        for s in ("a", "b", None) if key else ("all",):
            own = [(i, bad is None or bad) for k, i, bad in rows if not key or k == s]
            assert [got[i] for i, _ in own] == plain_transports([b for _, b in own], reprobe=reprobe)
        assert {"primary", "fallback"} == set(got.values())
    assert largest_part(spark, made) < 300
    assert state.transports(df.limit(0), [], ["i"], "bad").count() == 0
