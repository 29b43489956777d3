"""URLs, form bodies and captured settings against the standard library on made input."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
from urllib.parse import urlencode, urlsplit

from pyspark.sql import functions as F

from scrutin.functions.text import form_encoded, url_parts
from scrutin.plans import reports
from scrutin.sources import config


def test_urls_like_urlsplit(spark):
    rng = random.Random(1)
    bits = ["https:", "HTTP:", "ftp+x:", "1x:", "//", "/", "h", "H.Co", "a@b", "u:p@", ":9", ":0", ":", ":65535", "?", "#", "q=1", " ", "[::1]", "[fe80::1%Eth0]", "é", "%41", ".", "\t"]
    urls = {"".join(rng.choices(bits, k=rng.randrange(1, 8))) for _ in range(4000)} | {"", "https://h:0065/x", "https://[::1]:7/", "HTTPS://H.co:9/x"}
    want = {}
    for u in urls:
        try:
            s = urlsplit(u)
            want[u] = (s.hostname or "", s.port or 443, s.path)
        except ValueError:  # no port, or brackets that don't match: refused there
            pass
    assert len(want) > 2500
    df = spark.createDataFrame([(u,) for u in want], "u string")
    got = {r["u"]: tuple(r["p"]) for r in df.select("u", url_parts(F.col("u")).alias("p")).collect()}
    assert {u: (got[u], want[u]) for u in want if got[u] != want[u]} == {}
    bad = spark.createDataFrame([("https://h:x/",), ("https://h:70000/",), (None,)], "u string").select(url_parts(F.col("u")).alias("p")).collect()
    assert [r["p"]["port"] for r in bad] == [None, None, 443]


def test_forms_like_urlencode(spark):
    rng = random.Random(2)
    chars = [*map(chr, range(1, 128)), "é", "漢", "\U0001f600"]
    rows = [tuple("".join(rng.choices(chars, k=rng.randrange(9))) if rng.random() < 0.9 else None for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", form_encoded({"__VIEW$é ": F.col("a"), "b": F.col("b")}).alias("body")).collect()
    assert all(r["body"] == urlencode({"__VIEW$é ": r["a"], "b": r["b"]}) for r in got)


def test_settings_like_load(spark):
    rng = random.Random(3)
    values = [None, 0, 3, -2, 2.5, 3.9, "3", "2.5", "x", "", True, False, [], {}, 99999999999, 10**30, -(10**30), 1e300]
    texts = [json.dumps({k: rng.choice(values) for k in ("delay", "workers", "ip_mode", "other") if rng.random() < 0.7}) for _ in range(500)]
    texts += ["", "{", "null", "3", '"x"', "[]", '[{"workers": 2}]', '{"delay": 1', None, '{"workers": 2} x']
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in config.captured(df, "text").collect():
        want = config.load(r["text"])
        assert r["delay"] == want.delay and r["workers"] == max(-(2**63), min(2**63 - 1, want.workers)) or abs(want.workers) > 9e18 and abs(r["workers"]) > 9e18 and r["workers"] * want.workers > 0, (r, want)


def test_certificates_beyond_the_limit_are_counted(spark):
    rows = [(f"p{i:02d}", "u", "OK" if i % 2 else "ERROR", "i", "s") for i in range(12)]
    text = reports.tls_report(spark.createDataFrame(rows, "label string, url string, status string, issuer_cn string, subject_cn string"), most=5)
    assert "| p04 | u | ERROR | i | s |" in text and "p05" not in text and "... (7 mas)" in text and "- OK: 6" in text
    assert "mas)" not in reports.tls_report(spark.createDataFrame(rows[:5], "label string, url string, status string, issuer_cn string, subject_cn string"), most=5)


def test_entry_without_a_library(tmp_path):
    """A library that only the training-data package needs is absent: the audit queries stay."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('no ahocorasick', name='ahocorasick')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; from scrutin.plans import registry; assert set(e.queries()) >= set(registry.QUERIES); print(len(e.queries()) == len(registry.QUERIES))"
    ran = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, check=True)
    there = os.path.isdir(f"{root}/scrutin/llm")
    assert ran.stdout.strip() == "True" and ("left out" in ran.stderr) == there
