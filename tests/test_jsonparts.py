"""Members of JSON objects read by byte ranges, against json.loads of the whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from scrutin.sources import index, jsonparts

HARD = ["", "x", 'q"q', "\\", '\\"', "\\\\\\", "{", "},{", '":{"', "[,]", "é  \U0001f600", "\n\t", ":", " , "]


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False, -1.5e3, 7])
    if kind < 4:
        return "".join(rng.choices(HARD, k=rng.randrange(5)))
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice(HARD)}{i}": value(rng, deep + 1) for i in range(rng.randrange(4))}


def shown(v):
    return v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True)


def wanted(doc, level):
    rows = []
    for k, v in doc.items():
        if level == 1 or not isinstance(v, dict):
            rows.append((None, k, shown(v)))
        else:
            rows += [(k, a, shown(b)) for a, b in v.items()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_random_documents(spark, tmp_path, size):
    rng = random.Random(size)
    doc = {f"s{i}{rng.choice(HARD)}": {f"{rng.choice(HARD)}{j}": value(rng) for j in range(rng.randrange(12))} if i % 3 else value(rng) for i in range(9)}
    doc["long"] = {"a" * 100: "é\\" * 60_000, "b": "y"}
    doc |= {"list": [{"in": {"side": "x"}}, "},{"], "empty": {}, "last": None}
    path = tmp_path / "doc.json"
    text = json.dumps(doc, ensure_ascii=bool(size % 2), indent=rng.choice([None, 1]))
    path.write_text(text if size > 64 else text.replace("é\\\\" * 1000, ""), encoding="utf-8")
    doc = json.loads(path.read_text(encoding="utf-8"))
    for level in (1, 2):
        rows = jsonparts.members(spark, str(path), level, max(size, path.stat().st_size // 3000)).collect()
        have = []
        for section, key, v in rows:
            parent = doc if section is None else doc[section]
            if v is not None and not isinstance(parent[key], str):
                v = shown(json.loads(v))
            have.append((section, key, v))
        assert sorted(have, key=repr) == wanted(doc, level)


def test_a_folder_is_one_document(spark, tmp_path):
    parts = ['{"v": 1, "a": {', '"k1": "x",\n', '"k2": {"n": [1, 2]},\n', "\n  \n", '"k3": null}, "b":\n{', '"k4":"z"}}', ""]
    for i, text in enumerate(parts):
        (tmp_path / f"part-{i:05d}.txt").write_text(text)
    (tmp_path / "_SUCCESS").write_text("")
    rows = sorted(map(tuple, jsonparts.members(spark, str(tmp_path), 2, 5).collect()), key=repr)
    assert rows == sorted([(None, "v", "1"), ("a", "k1", "x"), ("a", "k2", '{"n": [1, 2]}'), ("a", "k3", None), ("b", "k4", "z")], key=repr)
    (tmp_path / "none").mkdir()
    (tmp_path / "none/empty.json").write_text("")
    assert jsonparts.members(spark, str(tmp_path / "none")).count() == 0


def test_same_five_tables(spark, tmp_path):
    doc = {
        "version": "t1", "generated_at": "2026-01-01", "entries_count": 3, "known_dif_count": 2, "coverage_note": "",
        "by_hash": {f"h{i}": f"f{i}.pdf" for i in range(500)},
        "by_filename": {"a.pdf": "A", "b.pdf": {"sha256": "B", "vuelta": "2"}, "c.pdf": {"vuelta": "1"}, "d.pdf": "", "e.pdf": None, "f.pdf": {}},
        "known_dif": {"d.pdf": {"versions": [{"sha256": "D1", "note": 'n"1'}]}, "e.pdf": {"local_sha256": "E1", "server_sha256": "E2"}},
        "by_location": {"a.pdf": "01/001/01/02", "bad.pdf": "01/001"},
    }
    path = tmp_path / "index.json"
    path.write_text(json.dumps(doc, indent=1))
    index.normalize(spark, str(path), str(tmp_path / "out"))
    whole = index.read(spark, str(path))
    for name, make in (("ix_hash", index.by_hash), ("ix_file", index.by_filename), ("ix_dif", index.known_versions), ("ix_loc", index.locations), ("ix_meta", index.meta)):
        table = spark.read.parquet(str(tmp_path / "out" / name))
        want = make(whole)
        assert table.columns == want.columns and sorted(map(str, table.collect())) == sorted(map(str, want.collect())), name
    urls = {"_meta": {"n": 2}, "a.pdf": "https://h/a", "b.pdf": "https://h/b,{"}
    path.write_text(json.dumps(urls))
    assert {tuple(r) for r in index.large_urls(spark, str(path)).collect()} == {("a.pdf", "https://h/a"), ("b.pdf", "https://h/b,{")}


def test_many_partitions(spark, tmp_path):
    path = tmp_path / "many.json"
    path.write_text(json.dumps({"s": {f"k{i}": f"v{i}" for i in range(3000)}}))
    rows = jsonparts.members(spark, str(path), 2, 1000).withColumn("task", F.spark_partition_id())
    by = [r["n"] for r in rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by) == 3000 and len(by) >= 6 and max(by) < 1200
