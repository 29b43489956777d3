"""Streams against batch runs over the same input: arrival orders, restarts after failures."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scrutin.operators import integrity
from scrutin.sources import index as index_source
from scrutin.streaming import first, verdicts


@pytest.fixture()
def indexed(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for version, good in (("1", range(0, 20)), ("2", range(0, 40))):
        doc = {
            "by_hash": {sha(b"%%PDF%d" % i): f"f{i}.pdf" for i in good},
            "by_filename": {f"f{i}.pdf": sha(b"other") for i in range(40, 50)},
            "known_dif": {f"f{i}.pdf": {"versions": [{"sha256": sha(b"%%PDF%d" % i), "note": "n"}]} for i in range(50, 55)},
        }
        (tmp_path / f"index{version}.json").write_text(json.dumps(doc))
    index_source.normalize(spark, str(tmp_path / "index1.json"), str(tmp_path / "index/version=1"))
    return tmp_path


def drop_files(folder, numbers):
    folder.mkdir(exist_ok=True)
    for i in numbers:
        (folder / f"f{i}.pdf").write_bytes(b"" if i == 59 else b"%%PDF%d" % i)


def rows_of(df):
    return sorted((r["filename"], r["status"], r["note"]) for r in df.collect())


def test_verdicts_over_arriving_files(spark, indexed):
    folder, index, out, cp = indexed / "in", str(indexed / "index"), str(indexed / "out"), str(indexed / "cp")
    drop_files(folder, range(0, 30))
    verdicts.verify_arriving(spark, str(folder), index, out, cp)
    assert {r["index_version"] for r in verdicts.verdicts(spark, out).collect()} == {"1"}
    # A batch that dies after it wrote is repeated by the same version, though a newer one has come.
    drop_files(folder, range(30, 60))
    real = verdicts.classified

    def dies(*a):
        made = real(*a)
        made.write.mode("overwrite").parquet(f"{out}/batch=1")
        raise RuntimeError("killed")

    verdicts.classified = dies
    try:
        with pytest.raises(Exception, match="killed"):
            verdicts.verify_arriving(spark, str(folder), index, out, cp)
    finally:
        verdicts.classified = real
    index_source.normalize(spark, str(indexed / "index2.json"), str(indexed / "index/version=2"))
    verdicts.verify_arriving(spark, str(folder), index, out, cp)
    got = verdicts.verdicts(spark, out)
    assert got.count() == 60 and got.select("filename").distinct().count() == 60
    assert {r["index_version"] for r in got.where("filename not in ('f59.pdf')").collect()} == {"1"}
    batch = real(spark, verdicts.listing.list_files(spark, str(folder)), index, "1")
    assert rows_of(got.where("filename <> 'f59.pdf'")) == rows_of(batch.where("filename <> 'f59.pdf'"))
    assert {s for _, s, _ in rows_of(got)} == {integrity.VERIFIED, integrity.ALTERED, integrity.UNKNOWN}
    # Nothing new: nothing more. A file that comes now meets the newer version.
    verdicts.verify_arriving(spark, str(folder), index, out, cp)
    assert verdicts.verdicts(spark, out).count() == 60
    drop_files(folder, [60])
    verdicts.verify_arriving(spark, str(folder), index, out, cp)
    assert [r["index_version"] for r in verdicts.verdicts(spark, out).where("filename = 'f60.pdf'").collect()] == ["2"]


@pytest.mark.parametrize("seed", [1, 2])
def test_first_in_any_arrival_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", f"f{rng.randrange(3)}", i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(150)]
    want = {k: min((f, i) for x, f, i, _ in rows if x == k) for k, *_ in rows}
    rng.shuffle(rows)
    schema = "k string, file string, line long, ts timestamp"
    cp, out = str(tmp_path / "cp"), str(tmp_path / "out")
    folder = tmp_path / "in"

    def run():
        stream = first.first_in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), "k", ["file", "line"])
        keep = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    for part in range(3):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], "k string, file string, line long, ts string").coalesce(1).write.mode("append").json(str(folder))
        got = run()  # a new run, from the checkpoint
        so_far = rows[: part * 50 + 50]
        have = {r["k"]: (r["file"], r["line"]) for r in first.settled(got, "k").collect()}
        assert have == {k: min((f, i) for x, f, i, _ in so_far if x == k) for k, *_ in so_far}
    assert have == want
    each = got.groupBy("k", "revision").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] == 1 for r in each) and max(r["revision"] for r in each) > 1
    # The watermark passes: keys are given once more as final, and their state is gone.
    for day in ("02", "03", "04"):
        spark.createDataFrame([("late", "f9", 1, f"2024-01-{day} 00:00:00")], "k string, file string, line long, ts string").coalesce(1).write.mode("append").json(str(folder))
        got = run()
    final = {r["k"]: (r["file"], r["line"]) for r in got.where("final and k <> 'late'").collect()}
    assert final == want
