"""Language ID: held-out accuracy, sizes block by block, odd rows."""

from __future__ import annotations

import zlib

import pytest
import zstandard

from scrutin.llm import langid

from .test_llm import ODD, odd_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in langid.op12_langid(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    right = [got[i]["lang_pred"] == truth[i] for i in held]
    assert sum(right) / len(right) >= 0.99
    sure = [got[i]["lang_pred"] == truth[i] for i in held if got[i]["accepted"]]
    assert len(sure) >= 0.95 * len(held) and sum(sure) / len(sure) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_sizes_are_those_of_plain_calls(spark, docs):
    """Each prediction is the smallest of sums of plain zstandard calls over the blocks of the whole text."""
    learned = langid.learn(docs)
    assert [lang for lang, _ in learned][0] == "en" and sorted(lang for lang, _ in learned) == ["de", "en", "es", "fr"]
    assert all(0 < len(d) <= langid.DICTIONARY for _, d in learned)
    by = langid.Compressors(learned)
    for r in docs.orderBy("doc_id").limit(30).collect():
        text = r["text"] * 3
        blocks = [text[a : a + langid.BLOCK].lower().encode() for a in range(0, len(text), langid.BLOCK)]
        assert "".join(b.decode() for b in blocks) == text.lower()
        want = []
        for _, content in learned:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
            frames = [c.compress(b) for b in blocks]
            assert [zstandard.ZstdDecompressor(dict_data=held).decompress(f, max_output_size=1 << 20) for f in frames] == blocks
            want.append(sum(map(len, frames)))
        assert by.sizes(text) == want
        assert by.predict(text)[0] == learned[want.index(min(want))][0]


def test_learns_from_its_fold_only(spark, docs):
    """Neither the held-out rows nor source or id change the dictionaries; copies fill none."""
    from pyspark.sql import functions as F

    learned = langid.learn(docs)
    out = langid.held_out(F.col("doc_id"), 5, 0)
    other = docs.withColumn("text", F.when(out, "zzz").otherwise(F.col("text"))).withColumn("source", F.lit("s"))
    assert langid.learn(other) == learned
    assert langid.learn(docs.unionByName(docs).unionByName(docs)) == learned


def test_margin_decides_acceptance():
    by = langid.Compressors([("a", b"the quick brown fox jumps over the lazy dog " * 4), ("b", b"der schnelle braune fuchs springt ueber den hund " * 4)])
    lang, score, margin, accepted = by.predict("The quick brown fox jumps over the lazy dog")
    assert (lang, accepted) == ("a", True) and margin >= 2 and score > 0.75
    assert by.predict("xq") == ("a", 0.5, 0, False)
    assert by.predict("1234 --") == by.predict("") == by.predict(None) == ("und", 0.0, 0, False)


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = langid.languages(df).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert all((by[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(ODD))
    assert {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert langid.languages(df.limit(0)).count() == 0
    none = langid.languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert len(none) == len(rows) and {r["lang_pred"] for r in none} == {"und"}
