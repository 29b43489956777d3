"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import os
import random

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrutin.llm import mixing, pii, quality, shared
from tests.llm.test_llm import brute_fingerprint, components, odd_docs

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = pipeline.keep_good(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want and 0.5 < len(want) / docs.count() < 1

    one = pipeline.keep_one_of_near_copies(spark, good, SF).cache()
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = components(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for i, r in enumerate(rows) if comp[i] == i}

    clean = pipeline.redact(spark, one, SF).cache()
    before = {r.doc_id: r for r in one.collect()}
    assert clean.columns == columns and clean.dtypes == docs.dtypes
    for r in clean.collect():
        assert r.text == pii.redacted(before[r.doc_id].text) and r.lang == before[r.doc_id].lang
        assert not [s for s in pii.find(r.text) if s[0] in pii.BASE]

    mixed = pipeline.mix(spark, clean, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).select("row.doc_id", "copies").collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and got == {k: n for k, n in copies.items() if n}

    packed = pipeline.pack(spark, mixed, SF)
    assert packed.where("start = 0").count() == mixed.count()
    assert packed.agg(F.max("length")).first()[0] <= 2048


def test_stages_in_odd_cases(spark):
    docs = odd_docs(spark).withColumns({"fp": F.lit(1), "print": F.lit("p"), "clean": F.lit("c"), "copies": F.lit(2)})
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, empty, SF).count() == 0, name
    assert pipeline.keep_one_of_near_copies(spark, docs, SF).where("doc_id = 3").count() == 1
    assert pipeline.keep_one_of_near_copies(spark, docs, SF).where("doc_id is null").count() == 1
    assert pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_near_copies_are_of_components_not_of_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in ("alpha", "beta", "gamma"))
    other = next(f"{a} tail{i}" for i in range(10_000) if 0 < (brute_fingerprint(f"{a} tail{i}") ^ brute_fingerprint(a)).bit_count() <= 3)

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(r.text for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect())

    assert kept([(1, a), (1, b), (1, b), (2, c), (3, a)]) == sorted([a, b, c])  # one id, two texts
    assert len(kept([(None, a), (None, other), (None, a)])) == 1  # near copies without ids
    assert kept([(None, a), (5, other), (None, b)]) == sorted([other, b])


def test_one_of_each_component_against_brute_force(spark):
    """Ids repeated, missing and shared by different texts, exact repeats, near copies: one row of each component, and the
    same in two runs."""
    rng = random.Random(21)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(60)) for _ in range(25)]
    near = [b + rng.choice(["", " x", " tail", " tail end"]) for b in base for _ in range(3)]
    rows = [(rng.choice([None, *range(12)]), t, rng.randrange(3)) for t in [*base, *near, None, "", " "]]
    rows += rng.sample(rows, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = components(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3))
    runs = [sorted(map(repr, pipeline.keep_one_of_near_copies(spark, d, SF).collect())) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == len(set(comp))
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    own = {}
    for (k, t, n), c in zip(rows, comp):
        own.setdefault(c, []).append((k, t, n))
    left = dict(own)
    for r in kept:
        c = next(c for c, members in left.items() if tuple(r) in members)
        ids = [k for k, _, _ in left.pop(c) if k is not None]
        assert r.doc_id == (min(ids) if ids else None)
    assert not left


def test_pack_stage_in_odd_cases(spark):
    rows = [(5, "one text"), (5, "another text of the same id"), (None, "no id"), (None, "no id"), (7, None), (8, ""), (9, "word " * 6000), (5, "one text")]
    docs = spark.createDataFrame([(k, t, "q", 1, 2) for k, t in rows], "doc_id long, text string, start string, length int, sequence_id int")
    got = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if k is None else k, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for k, x in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for _, n in want) and max(r.offset + r.length for r in got) <= 2048


def test_run(spark, tmp_path):
    folder = shared.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    first, second = (sorted(map(repr, pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset").collect())) for _ in range(2))
    assert len(first) > 100 and first == second
    left = [x for x in set(os.listdir(folder)) - before if os.path.isdir(f"{folder}/{x}")]
    assert sorted(x.split("-")[0] for x in left) == ["packing", "packing"]  # a run leaves its result only
