"""Histories of captures: merges one by one against a rebuild and plain Python, folders pruned, merges cut short."""

from __future__ import annotations

import random

import pytest

from scrutin.operators import history

SCHEMA = "k string, a long, b string"


def made(seed=1, dates=6, keys=30):
    rng = random.Random(seed)
    out = []
    for d in range(dates):
        rows = [(f"k{i}", rng.choice([1, 2, None]), rng.choice(["x", None])) for i in range(keys) if rng.random() < 0.7]
        out.append((f"2026-06-{10 + d}", rows + rows[:2] + [(None, 1, "n")]))
    return out


def plain(captures):
    dates, open_, out = [d for d, _ in captures], {}, []
    for d, rows in captures:
        now = {k: (a, b) for k, a, b in rows if k is not None}
        for k in list(open_):
            if now.get(k, "gone") != open_[k][0]:
                v, since = open_.pop(k)
                out.append((k, *v, since, d))
        for k, v in now.items():
            open_.setdefault(k, (v, d))
    assert dates == sorted(dates)
    return sorted(map(str, out + [(k, *v, since, None) for k, (v, since) in open_.items()]))


def rows_of(df):
    return sorted(str((r["k"], r["a"], r["b"], r["valid_from"], r["valid_to"])) for r in df.collect())


def test_merges_equal_a_rebuild(spark, tmp_path):
    captures, path = made(), str(tmp_path / "h")
    for n, (d, rows) in enumerate(captures, 1):
        history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", d)
        assert rows_of(history.history(spark, path)) == plain(captures[:n])
        assert len(history.captures(spark, path)) <= 2
    everything = spark.createDataFrame([(d, *r) for d, rows in captures for r in rows], f"date string, {SCHEMA}")
    assert rows_of(history.rebuilt(everything, "k")) == plain(captures)
    for d, rows in captures:
        then = history.history(spark, path, d)
        assert sorted(str((r["k"], r["a"], r["b"])) for r in then.collect()) == sorted({str(r) for r in rows if r[0] is not None})


def test_reads_one_folder_and_prunes(spark, tmp_path, capsys):
    captures, path = made(2), str(tmp_path / "h")
    for d, rows in captures:
        history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", d)
    on = captures[3][0]
    read = {f.split("valid_to=")[1][:10] for f in history.history(spark, path, on).inputFiles() if "valid_to=" in f}
    history.history(spark, path, on).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and f"(valid_to" in plan and on in plan and read
    # A merge needs neither the closed rows nor older open ones: with those unreadable it gives the same.
    for old in (tmp_path / "h/closed").glob("*/*.parquet"):
        old.write_bytes(b"no parquet")
    history.merge(path, spark.createDataFrame(captures[0][1], SCHEMA), "k", "2026-07-01")
    assert history.captures(spark, path)[-1] == "2026-07-01"


def test_cut_short_and_repeated(spark, tmp_path, monkeypatch):
    captures, path = made(3, 3), str(tmp_path / "h")
    for d, rows in captures[:2]:
        history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", d)
    # The merge dies once closed rows are written: readers see the capture before, and the merge can be repeated.
    d, rows = captures[2]
    history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", d)
    (tmp_path / f"h/open/as_of={d}/_SUCCESS").unlink()
    assert rows_of(history.history(spark, path)) == plain(captures[:2])
    for _ in range(2):
        history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", d)
        assert rows_of(history.history(spark, path)) == plain(captures)
    with pytest.raises(ValueError, match="before"):
        history.merge(path, spark.createDataFrame(rows, SCHEMA), "k", captures[0][0])


def test_empty_capture(spark, tmp_path):
    path = str(tmp_path / "h")
    history.merge(path, spark.createDataFrame([], SCHEMA), "k", "1")
    assert history.history(spark, path).count() == 0
    history.merge(path, spark.createDataFrame([("x", 1, None)], SCHEMA), "k", "2")
    history.merge(path, spark.createDataFrame([], SCHEMA), "k", "3")
    assert rows_of(history.history(spark, path)) == [str(("x", 1, None, "2", "3"))]
