"""Files listed, hashed and numbered by tasks, against plain Python."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from scrutin.operators import state, two_pass
from scrutin.plans import sinks
from scrutin.sources import files, ids, listing


def make(folder, names):
    for name, content in names.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def test_list_like_rglob(spark, tmp_path):
    names = {"a.pdf": b"%PDF-1", "b c/ñ.PDF": b"", "b c/d/e.pDf": b"x" * 10, "b c/d/.pdf": b"h", "b c/d/.hidden/_u.pdf": b"u", "no.txt": b"t", "deep/1/2/3/4/z.pdf": b"z", "pdf": b"p"}
    make(tmp_path, names)
    os.symlink(tmp_path, tmp_path / "deep/loop")
    os.symlink(tmp_path / "a.pdf", tmp_path / "deep/link.pdf")
    got = {r["path"]: (r["filename"], r["length"]) for r in listing.list_files(spark, str(tmp_path)).collect()}
    want = {f"file:{p}": (p.name, p.stat().st_size) for p in tmp_path.rglob("*.[Pp][Dd][Ff]") if p.is_file()}
    assert got == want and len(got) == 7
    flat = listing.list_files(spark, f"file://{tmp_path}", recursive=False).collect()
    assert [r["filename"] for r in flat] == ["a.pdf"]
    (tmp_path / "none").mkdir()
    assert listing.list_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="absent"):
        listing.list_files(spark, str(tmp_path / "absent")).count()
    hashed = {r["path"]: (r["length"], r["sha256"]) for r in files.hashed_folder(spark, str(tmp_path)).collect()}
    assert hashed == {p: (n, hashlib.sha256(open(p[5:], "rb").read()).hexdigest()) for p, (_, n) in want.items()}


def test_a_file_beyond_the_limit_of_a_row(spark, tmp_path):
    """2.2 GB, more than a binary value can hold: read in blocks."""
    size = 2_200_000_000
    with open(tmp_path / "large.pdf", "wb") as f:
        f.write(b"%PDF")
        f.truncate(size)
    sha = hashlib.sha256(b"%PDF")
    zeros = bytes(1 << 24)
    for at in range(4, size, len(zeros)):
        sha.update(zeros[: min(len(zeros), size - at)])
    row = listing.hashed_paths(listing.list_files(spark, str(tmp_path))).first()
    assert (row["sha256"], row["bytes_read"], bytes(row["head"]), row["error"]) == (sha.hexdigest(), size, b"%PDF", None)


def test_no_driver_call_for_each_file(spark, tmp_path, monkeypatch):
    calls = []
    client = spark.sparkContext._gateway._gateway_client
    send = client.send_command
    of_files = ("\nlistFiles\n", "\nlistStatus\n", "\ngetPath\n", "\ngetLen\n", "\nhasNext\n")
    monkeypatch.setattr(client, "send_command", lambda command, *a, **k: calls.append(any(m in command for m in of_files)) or send(command, *a, **k))
    for n in (5, 400):
        make(tmp_path / str(n), {f"f{i}.pdf": b"x%d" % i for i in range(n)})
        calls.clear()
        assert files.hashed_folder(spark, str(tmp_path / str(n))).count() == n
        assert calls and sum(calls) < 40, (n, sum(calls), len(calls))


def test_hashed_paths_odd(spark, tmp_path):
    make(tmp_path, {"a.pdf": b"a"})
    rows = [(f"file:{tmp_path}/a.pdf", 1), (f"file:{tmp_path}/a.pdf", 1), (f"file:{tmp_path}/gone.pdf", None), (None, 3)]
    got = {r["path"]: r for r in listing.hashed_paths(spark.createDataFrame(rows, "path string, length long")).collect()}
    assert len(got) == 2 and got[rows[0][0]]["sha256"] == hashlib.sha256(b"a").hexdigest()
    assert got[rows[2][0]]["sha256"] is None and "gone.pdf" in got[rows[2][0]]["error"]


def test_fingerprint_decides_progress(spark, tmp_path):
    make(tmp_path, {"ids.txt": b"123456\n"})
    own = listing.fingerprint(spark, str(tmp_path / "ids.txt"))
    assert own == hashlib.sha256(b"123456\n").hexdigest()
    progress = spark.createDataFrame([("k1", own), ("k2", "stale")], "key string, input_sha256 string")
    assert [r["key"] for r in state.valid_progress(progress, own).collect()] == ["k1"]
    with pytest.raises(OSError):
        listing.fingerprint(spark, str(tmp_path / "absent.txt"))


def test_second_pass_opens_survivors_only(spark, tmp_path):
    """Files that the sizes settle are removed after they were listed: to open one would be an error of its own."""
    content = {f"f{i}.pdf": b"x" * i for i in range(40)}
    make(tmp_path, content)
    number = F.regexp_extract("filename", "[0-9]+", 0).cast("int")
    listed = listing.list_files(spark, str(tmp_path)).withColumn("url", F.when(number != 7, F.concat(F.lit("u"), number)))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    remote = [(f"u{i}", i if i % 2 == 0 else i + 1, sha(content[f"f{i}.pdf"] + (b"y" if i % 4 == 0 else b"")), "TIMEOUT" if i == 9 else None) for i in range(40)]
    remote_df = spark.createDataFrame(remote, "url string, remote_size long, server_sha256 string, error string")
    settled = [i for i in range(40) if i % 2 and i != 9]
    for i in settled:
        (tmp_path / f"f{i}.pdf").unlink()
    index = spark.createDataFrame([(sha(content["f8.pdf"]), "VERIFICADA")], "sha256 string, indice_status string")
    got = {int(r["path"].rsplit("/f", 1)[1][:-4]): r for r in two_pass.verify(listed, remote_df, index).collect()}
    assert len(got) == 40
    read = {i: r["bytes_read"] for i, r in got.items() if r["bytes_read"] is not None}
    assert read == {i: i for i in range(40) if i % 2 == 0 or i == 9}  # the files that were opened, and what was read of them
    for i, r in got.items():
        if i == 7:
            want = "URL_NO_CONSTRUIBLE"
        elif i == 9:
            want = "ERROR_DESCARGA"
        elif i % 2:
            want = "DIFERENTE_TAMANIO"
        else:
            want = "IGUAL_SERVIDOR" if i % 4 else "MANIPULADA_EN_SERVIDOR" if i == 8 else "DIFERENTE_SERVIDOR"
        assert r["status"] == want, (i, r)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_lines_of_one_file_over_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(1)
    text = {n: "".join(rng.choice(["", "# c", " 123456 x", "é" * rng.randrange(40), f"{rng.randrange(10**9)}"]) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(3000)) for n in ("one.txt", "b.txt")}
    text["b.txt"] = "﻿77\n" + text["b.txt"]
    text |= {"empty.txt": "", "last.txt": "no end"}
    make(tmp_path, {n: t.encode() for n, t in text.items()})
    assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 10
    for n in ("one.txt", "b.txt", "empty.txt", "last.txt"):
        got = sorted((r["linea_origen"], r["line"]) for r in ids.numbered_lines(spark, str(tmp_path / n)).collect())
        with open(tmp_path / n, encoding="utf-8-sig") as f:
            assert got == [(i, line.rstrip("\n")) for i, line in enumerate(f, 1)], n
    rows = sorted((r["archivo_origen"].rsplit("/", 1)[1], r["linea_origen"], r["token"], r["has_bom"]) for r in ids.read_text(spark, str(tmp_path)).collect())
    want = []
    for n in text:
        with open(tmp_path / n, encoding="utf-8") as f:
            want += [(n, i, line.strip().split()[0], n == "b.txt") for i, line in enumerate(f, 1) if line.strip() and not line.strip().startswith("#")]
    assert rows == sorted(want)


def test_lone_carriage_returns(spark, tmp_path):
    make(tmp_path, {"r.txt": b"1\r2\r\r3\n4"})
    got = sorted((r["linea_origen"], r["line"]) for r in ids.numbered_lines(spark, str(tmp_path / "r.txt")).collect())
    assert got == [(1, "1"), (2, "2"), (3, ""), (4, "3"), (5, "4")]


def test_names_stay_in_the_folder(spark, tmp_path):
    ok = spark.createDataFrame([("d/a.txt", "é"), ("b..c.txt", "")], "name string, text string")
    sinks.write_named(ok, str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b..c.txt", "d/a.txt"]
    for name in ("../x.txt", "/x.txt", "a/../../x.txt", "", "a//b", None):
        with pytest.raises(Exception, match="not a name within"):
            sinks.write_named(spark.createDataFrame([(name, "x")], ok.schema), str(tmp_path / "out"))
    assert not (tmp_path / "x.txt").exists()
