"""Each operator against a brute-force version on small fixtures, and its defined results in odd cases."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrutin.llm import caps, mixing, packing, pii, quality, registry, secrets, shared, simhash, tokens, topk, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\t ", "one", "one two", "Ünïcode ß — 漢字 \U0001f600 text", "x" * 20_000, "word " * 30_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score string, size string, row string, r string, id string, component_id string"


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that share names with results."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "f", "x", "z", "q", "r", "i", "c") for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None,) * 12, (None, "no id here", None, None, None, *(None,) * 7)]
    return spark.createDataFrame(rows, SCHEMA)


def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()


def components(n, links):
    """Smallest member of each one's component."""
    to = list(range(n))

    def find(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- shared ---


def test_intermediates_of_two_threads(spark):
    """A run in one thread neither registers nor removes the tables of a run in another."""
    from threading import Barrier, Thread

    barrier, counts, lists = Barrier(2), {}, {}

    def run(name, rows):
        with shared.intermediates(spark) as made:
            df, _ = shared.written(spark.range(rows), name)
            lists[name] = list(made)
            barrier.wait()
            if name == "second":
                gone.join()  # the other run has ended, and removed its own
            counts[name] = df.count()

    gone = Thread(target=run, args=("first", 10))
    other = Thread(target=run, args=("second", 20))
    gone.start(), other.start()
    other.join()
    assert counts == {"first": 10, "second": 20} and all(len(m) == 1 for m in lists.values())


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(links + [(5, 5)], "u long, v long")).collect()}
    want = components(300, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert shared.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 token counts ---


def brute_tokens(text, trie, pattern):
    n = words = 0
    score = 0.0
    for w in pattern.findall(text or ""):
        w = w.encode()
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(best[s][0] + trie.scores[w[s:end]], -(best[s][1] + 1)) for s in range(end) if w[s:end] in trie.scores]
            top = max(options)
            best.append((top[0], -top[1]))
        words, n, score = words + 1, n + best[-1][1], score + best[-1][0]
    return words, n, score


def test_tokens(spark, monkeypatch):
    import regex

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = regex.compile(public_tokenizers.PATTERN)
    trie = tokens.Trie(tokens.vocabulary(path), public_tokenizers.PATTERN)
    some = [t for _, t in texts() if len(t) < 8000 or len(t) > 60_000] + [x for x in ODD if x is None or len(x) < 1000] + ["a\x1c b", "a\t \n b  ", "  lead", "it's 12,5"]
    want, known = [], {}
    for t in some:
        for w in pattern.findall(t or ""):
            if w not in known:
                known[w] = brute_tokens(w, trie, pattern)[1:]
        own = pattern.findall(t or "")
        want.append((len((t or "").encode()), len(own), sum(known[w][0] for w in own), math.fsum(known[w][1] for w in own)))
    for together, most in ((tokens.TOGETHER, tokens.MOST_SEGMENTS), (3000, 50)):  # begun anew again and again: the same counts
        monkeypatch.setattr(tokens, "TOGETHER", together)
        monkeypatch.setattr(tokens, "MOST_SEGMENTS", most)
        got = list(tokens.Trie(tokens.vocabulary(path), public_tokenizers.PATTERN).texts(some))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))
    got = tokens.token_counts(odd_docs(spark), path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) + 4 and got[0][1:] == (0, 0, 0, 0.0) and got[1].n_tokens == 0


def test_tokens_under_another_pattern(spark):
    """A pattern whose pre-tokens reach over what the other never joins: texts are not cut."""
    import regex

    pattern = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    texts_ = ["foo.\n\nbar", "a,b \n c", "", None, "it's 12345 !\n"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern).collect()}
    column = next(c for c in got[0].asDict() if "pre" in c)
    assert [got[i][column] for i in range(5)] == [len(regex.findall(pattern, t or "")) for t in texts_]
    assert tokens.CUT_UNDER == public_tokenizers.PATTERN


def test_segments_keep_pre_tokens():
    import regex

    p = regex.compile(public_tokenizers.PATTERN)
    for t in [t for _, t in texts()[::20]] + ["a\t\n b", " \xa0x　 y\r\n z  ", "a\x1d b \x1c", "don't  stop"]:
        assert [w for s in tokens.segments(t) for w in p.findall(s)] == p.findall(t)


# --- 2 embeddings ---


def brute_links(vectors, cosine=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def components_of(near):
    return np.array(components(len(near), zip(*np.nonzero(near))))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 64))
    v = np.concatenate([base, np.repeat(base[:4], 60, axis=0) + 0.25 * rng.standard_normal((240, 64)), np.repeat(base[5:6], 30, axis=0), rng.standard_normal((200, 64))])
    v = v.astype(np.float32)
    rows = [(i * 3, [float(x) for x in e]) for i, e in enumerate(v)]
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [1.0, None] * 32), (9004, [float("nan")] * 64), (9005, [float("inf")] + [1.0] * 63), (None, [1.0] * 64), (9006, []), (9007, [1.0] * 32)]
    df = spark.createDataFrame([(*r, None, "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, node string")
    near = brute_links(v)
    want = components(len(v), zip(*np.nonzero(near)))
    for block in (512, 32):
        got = {r.vec_id: r for r in caps.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows) + len(bad)
        for i, (k, _) in enumerate(rows):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (int(near[i].sum()), 3 * want[i], want[i] == i), k
        for k, _ in bad[:5] + bad[6:]:
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
        assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    repeated = df.where("vec_id in (0, 3, 480, 483)").unionByName(df.where("vec_id in (0, 480)"))
    x = np.array([r.embedding for r in repeated.collect()], float)
    ids = [r.vec_id for r in repeated.collect()]
    near = brute_links(x)
    want = sorted((k, int(n.sum()), min(i for i, y in zip(ids, components_of(near)[j] == components_of(near)) if y)) for j, (k, n) in enumerate(zip(ids, near)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in caps.near_duplicates(repeated).collect()) == want
    assert caps.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [2, 8, 16, 32, 64, 384])
def test_embeddings_recall_of_filters(dim):
    """Pairs at the least cosine, in few and many dimensions, for few and many vectors."""
    rng = np.random.default_rng(7)
    x = caps.units_of(rng.standard_normal((400, dim)))
    y = rng.standard_normal((400, dim))
    y = caps.units_of(y - (y * x).sum(1)[:, None] * x)
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * y
    for n in (3000, 10**6 if dim in (16, 64) else 50_000):
        codewords = caps.codewords_for(n, dim)
        met = [len(np.intersect1d(a, b)) > 0 for k in range(0, 400, 50) for a, b in zip(caps.decode(x[k : k + 50], codewords), caps.decode(y[k : k + 50], codewords))]
        assert np.mean(met) >= 0.99, (dim, n, codewords)
    assert caps.codewords_for(10, 64) == 600 and caps.codewords_for(10**6, 64) > 10_000 and caps.least_for(600) == 12


def test_embeddings_of_one_id(spark):
    """Rows of one id that hold different vectors are nodes of their own."""
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, x), (5, y), (6, [1.0, 0.1, 0.0, 0.0]), (7, [0.1, 1.0, 0.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0]), (8, [0.0, 0.0, 1.0, 0.1]), (5, x)]
    got = sorted(map(tuple, caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (7, 1, 5, False), (8, 1, 8, True), (9, 1, 8, False)])


def test_decode_gives_all_filters_that_exceed():
    rng = np.random.default_rng(8)
    x = caps.units_of(rng.standard_normal((20, 16)))
    for own, v in zip(caps.decode(x, 40), x):
        scores = []
        for rotation in range(caps.ROTATIONS):
            turn, first, second = caps.directions(16, rotation, 40)
            t = v.astype(np.float32) @ turn
            scores.append((first @ t[:8])[:, None] + second @ t[8:])
        flat = np.array(scores).reshape(caps.ROTATIONS, -1)
        for rotation, s in enumerate(flat):
            mine = own[(own >= rotation * 1600) & (own < (rotation + 1) * 1600)] - rotation * 1600
            assert len(mine) >= caps.least_for(40) and s[mine].min() >= np.delete(s, mine).max()


# --- 3 top-k ---


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-60, 60, (900, 24))
    v[100:140] = v[100]  # ties
    monkeypatch.setattr(topk, "SHARD", 128)
    monkeypatch.setattr(topk, "LEAST_BLOCK", 7)
    monkeypatch.setattr(topk, "RESCORE", 20)
    df = spark.createDataFrame([(i, [int(x) for x in e]) for i, e in enumerate(v)] + [(5000, [1] * 3), (None, [1] * 24), (5001, None)], "id long, vector array<long>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 900, 50):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(900) if i != q)[:5]
        assert got[q] == [(k, i, -x) for k, (x, i) in enumerate(best, 1)]
    assert 5000 not in got  # no other vector of its length
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_index_proves_before_the_end():
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((4000, 64))
    v = np.floor(256 * unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.int64)
    index = topk.ImpactIndex(v)
    assert sorted(index.postings[: len(v)].tolist()) == list(range(len(v)))  # each id once in each dimension
    queries = np.concatenate([v[:200], np.zeros((1, 64), int), -v[3:4], np.eye(64, dtype=int)[2:3] * 9, v[:1] * 10**7])
    sizes = []
    for q, query in enumerate(queries):
        own = np.array([q] if q < 200 else [], int)
        at, score = index.search(query, 5, own)
        s = v @ query
        assert (score == s[at]).all() and not np.isin(at, own).any()
        assert sorted(score)[-5:] == sorted(np.delete(s, own))[-5:]
        sizes.append(len(at))
    assert np.median(sizes[:200]) <= topk.RESCORE
    alike = topk.ImpactIndex(np.ones((9, 3), int)).search(np.ones(3, int), 5, np.array([4]))
    assert len(alike[0]) == 8


def test_topk_of_repeated_ids_in_any_order(spark):
    """Of rows that repeat an id the one with the least vector takes part, however rows are ordered."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (1, [3.0, 1.0]), (1, [-3.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, vector array<double>").coalesce(1)
        got = [tuple(r) for r in topk.top_k(*topk.integers(df)).orderBy("rank").collect()]
        assert got == [(0, 1, 2, -(256**2)), (0, 2, 1, -5 * 256**2)]


def test_topk_of_large_components(spark):
    """Sums of products beyond what doubles hold are exact; beyond a long they are refused."""
    rng = np.random.default_rng(9)
    for top in (1 << 22, 1 << 29):
        v = [[int(x) for x in rng.integers(-top, top, 8)] for _ in range(60)]
        df = spark.createDataFrame(list(enumerate(v)), "id long, vector array<long>")
        got = collections.defaultdict(list)
        for r in topk.top_k(df, df.where("id < 3")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        for q in range(3):
            want = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(60) if i != q)[:5]
            assert got[q] == [(i, -s) for s, i in want]
    huge = spark.createDataFrame([(0, [1 << 60] * 2), (1, [1 << 60] * 2)], "id long, vector array<long>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(huge, huge).collect()
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(*topk.integers(spark.createDataFrame([(0, [1e300])], "id long, vector array<double>"))).collect()


def test_topk_query_in_odd_cases(spark):
    rng = np.random.default_rng(6)
    v = {i: [float(x) for x in rng.standard_normal(8)] for i in range(40)} | {100: [0.0] * 8, 150: [1.0] * 3, 200: [1.0] * 3}
    bad = [(50, None), (51, []), (250, [None] * 8), (52, [float("nan")] * 8), (53, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(k, e, 1, "x") for k, e in [*v.items(), *bad, (0, v[0]), (7, v[7])]]
    df = spark.createDataFrame(rows, "id long, vector array<double>, score int, shard string")
    got = collections.defaultdict(list)
    for r in topk.top_k(*topk.integers(df.select("id", "vector"))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {k: [math.floor(256 * x) for x in e] for k, e in v.items()}
    for q in (0, 100, 150, 200):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], e)), k) for k, e in whole.items() if k != q and len(e) == len(whole[q]))
        assert got[q] == [(k, -s) for s, k in scores[:5]]
    assert set(got) == {0, 100, 150, 200}
    assert topk.top_k(*topk.integers(df.select("id", "vector").limit(0))).count() == 0


# --- 4 mixing ---


def brute_targets(sizes, weights):
    total, targets = sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= 3 * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = 3.0 * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 2, 3, 0], [5], [7, 7000, 3, 90, 1, 1]])
def test_mixing_targets(spark, sizes):
    rows = [(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.doc_id", "size", "target", "source_size", "copies").collect()}
    want = brute_targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
    for i, n in enumerate(sizes):
        assert got[i].size == n and math.isclose(got[i].target, want[i], rel_tol=1e-9, abs_tol=1e-9) and 0 <= got[i].copies <= 3


def test_mixing_comes_near_and_odd_cases(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 4}" if i % 9 else None) for i in range(8000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in m.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target
    odd = odd_docs(spark)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert sorted(map(str, mixing.mixed_rows(odd).collect())) == sorted(map(str, mixing.mixed_rows(odd).collect()))


# --- 5 quality, 8 toxicity ---


def auc(scores, truth):
    good, bad = [s for s, t in zip(scores, truth) if t], [s for s, t in zip(scores, truth) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("query", "column", "folds", "fold"), [("op5_quality", "quality", 3, 1), ("op8_toxicity", "toxic", 5, 0)])
def test_held_out(spark, query, column, folds, fold):
    """On 10,000 documents: the 51 toxic labels of the smaller tables are too few for a held-out figure."""
    sf = SF.replace("sf0.01", "sf0.1")
    got = {r.doc_id: r for r in registry.QUERIES[query](spark, sf).collect()}
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{sf}/labels.parquet'").fetchall())
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % folds == fold) for k, r in got.items())
    held = [k for k in truth if got[k].held_out]
    assert auc([got[k].score for k in held], [truth[k] for k in held]) > 0.95
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.95


def test_classifiers_in_odd_cases(spark):
    docs = odd_docs(spark)
    one = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (one, one.limit(0)):
        for f in (quality.quality, toxicity.toxicity):
            got = f(docs, labels).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            assert f(docs.limit(0), labels).count() == 0


def test_forest_matches_plain_traversal():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, len(quality.STATISTICS)))
    forest = quality.grow(x, (x[:, 2] + x[:, 5] > 0).astype(float))

    def walk(row):
        total = forest.base
        for c, t, v in zip(forest.column, forest.threshold, forest.value):
            at = 0
            while c[at] >= 0 and 2 * at + 1 < len(c):
                at = 2 * at + 1 + int(row[c[at]] > t[at])
            total += v[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == (x[:, 2] + x[:, 5] > 0)).mean() > 0.95


def brute_statistics(text):
    """The statistics by name, a character and a word at a time."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    n, w = len(raw), len(words)
    share = lambda chars: sum(x in chars for x in raw) / n
    ranges = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n", "other_bytes": bytes(range(128, 256)), "comma_stop": b",.;:", "pipe": b"|", "bang": b"!?", "hash_star_dollar": b"#*$%&@~^=+_<>{}[]\\"}
    out = {k: share(v) for k, v in ranges.items()}
    out["rest_punct"] = share(set(range(256)) - {x for v in ranges.values() for x in v})
    marks = b"!#*$%&|@~"
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_byte = collections.Counter(raw)
    return out | {
        "log_bytes": math.log1p(n), "log_words": math.log1p(w), "word_length": sum(map(len, words)) / w, "distinct_words": len(set(words)) / w,
        "distinct_pairs": len({(words[i], words[i + 1]) for i in range(w - 1)}) / max(1, w - 1), "top_word": max(words.count(x) for x in set(words)) / w,
        "short_words": sum(len(x) <= 2 for x in words) / w, "long_words": sum(len(x) >= 12 for x in words) / w, "capital_words": sum(x.isupper() for x in words) / w,
        "marked_words": sum(x[0] in marks or x[-1] in marks for x in words) / w, "log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines),
        "line_words": w / len(lines), "stopped_lines": sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines),
        "repeated_line_bytes": (sum(map(len, lines)) - sum(map(len, set(lines)))) / n, "top_byte": max(by_byte.values()) / n,
        "byte_entropy": -sum(c / n * math.log2(c / n) for c in by_byte.values()), "stops_per_word": sum(x in b".!?" for x in raw) / w,
    }


def test_statistics_against_brute_force():
    for t in [t for _, t in texts()[::25] if len(t) < 20_000] + [*ODD[:6], "A b!\nA b!\n\n#x|y~", "\n\n", "ÀÉ 12 .?"]:
        want = brute_statistics(t)
        assert np.allclose(quality.statistics(t), [want[k] for k in quality.STATISTICS], rtol=1e-9, atol=1e-12), repr(t)[:200]


def test_splits_against_exhaustive_search(monkeypatch):
    """The first tree's first split is the best of all columns and all thresholds that a histogram can tell apart."""
    monkeypatch.setattr(quality, "TREES", 1)
    rng = np.random.default_rng(14)
    x = np.round(rng.standard_normal((240, len(quality.STATISTICS))), 1)
    y = (x[:, 3] + 0.5 * x[:, 7] + 0.6 * rng.standard_normal(240) > 0.2).astype(float)
    forest = quality.grow(x, y)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - mean, np.full(len(y), mean * (1 - mean))
    gain_of = lambda at: g[at].sum() ** 2 / (h[at].sum() + quality.PENALTY)
    gains = {}
    for c in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, c], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, c] <= t
            if quality.LEAF <= left.sum() <= len(y) - quality.LEAF:
                gains[c, t] = gain_of(left) + gain_of(~left) - gain_of(np.ones(len(y), bool))
    best = max(gains.values())
    assert math.isclose(gains[int(forest.column[0][0]), forest.threshold[0][0]], best, rel_tol=1e-9)
    left = x[:, int(forest.column[0][0])] <= forest.threshold[0][0]
    for node, side in ((1, left), (2, ~left)):
        assert math.isclose(forest.value[0][node], quality.RATE * g[side].sum() / (h[side].sum() + quality.PENALTY), rel_tol=1e-9)


def brute_telling(texts, labels):
    held = [set().union(*toxicity.bag_of(t)) for t in texts]
    often, bad = collections.Counter(w for x in held for w in x), collections.Counter(w for x, y in zip(held, labels) for w in x if y == 1)
    n, positive = len(texts), sum(labels)
    least = 2 * math.log(max(2, sum(c >= toxicity.LEAST_DOCUMENTS for c in often.values()))) - toxicity.SLACK
    out = []
    for w, c in often.items():
        table = [[bad[w], positive - bad[w]], [c - bad[w], n - positive - c + bad[w]]]
        ratio = 2 * sum(v * math.log(v * n / (sum(r) * (table[0][j] + table[1][j]))) for r in table for j, v in enumerate(r) if v)
        if c >= toxicity.LEAST_DOCUMENTS and bad[w] * n > c * positive and ratio >= least:
            out.append(w)
    return sorted(out)


def made_bags():
    rng = random.Random(8)
    plain = ["sun", "rain", "birds", "people", "walk", "sing", "fall", "out", "down", "on", "the", "a"]
    made = lambda: " ".join(rng.choices(plain, k=6)) + "."
    clean = [" ".join(made() for _ in range(8)) for _ in range(160)]
    bad = [" ".join([made(), rng.choice(plain) + " " + rng.choice(("moron", "idiot")) + " " + made(), *(made() for _ in range(6))]) for _ in range(60)]
    return clean + bad + [None, ""], [0.0] * 160 + [1.0] * 60 + [0.0, 1.0]


def test_telling_words_and_offending_sentences(spark):
    texts_, labels = made_bags()
    sample = spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(zip(texts_, labels))], "id long, label double, text string")
    words = toxicity.telling_words(sample)
    assert words == brute_telling(texts_, labels) and {"moron", "idiot"} <= set(words)
    y, ids, sentence_at, doc_at = toxicity.bags(sample, {w: i for i, w in enumerate(words)})
    want = [(d, [words.index(w) for w in sorted(s & set(words))]) for d, t in enumerate(texts_) for s in toxicity.bag_of(t) if s & set(words)]
    got = [(int(doc_at[k]), ids[sentence_at == k].tolist()) for k in range(len(doc_at))]
    assert y.tolist() == labels and got == want
    model = toxicity.train(words, y, ids, sentence_at, doc_at)
    p, found = model.score("rain falls down. what a moron sings! birds sing here.")
    assert p > 0.5 and [(a, b) for a, b, _ in found] == [(16, 36)]
    assert model.score("birds sing here. rain falls down.")[0] < 0.5 and model.score(None) == (0.0, [])
    assert toxicity.telling_words(sample.limit(0)) == [] and toxicity.train([], *toxicity.bags(sample.limit(0), {})).weight == {}


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(15)
    labels, doc_at = rng.integers(0, 2, 12).astype(float), np.sort(rng.integers(0, 12, 30))
    sentence_at = np.sort(np.concatenate([np.arange(30), rng.integers(0, 30, 20)]))
    ids, theta = rng.integers(0, 5, 50), rng.standard_normal(6)
    loss, grad = toxicity.loss_and_gradient(theta, labels, ids, sentence_at, doc_at)
    want = toxicity.PENALTY * sum(theta[:-1] ** 2) / 2 / 12
    share = labels.mean()
    for d in range(12):
        clean = 1.0
        for s in np.nonzero(doc_at == d)[0]:
            clean *= 1 - 1 / (1 + math.exp(-(theta[-1] + sum(theta[i] for i in ids[sentence_at == s]))))
        weight = math.sqrt(0.5 / share if labels[d] else 0.5 / (1 - share))
        want -= weight * math.log(max(1e-9, 1 - clean) if labels[d] else min(clean, 1 - 1e-9)) / 12
    assert math.isclose(loss, want, rel_tol=1e-6)
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        slope = (toxicity.loss_and_gradient(theta + step, labels, ids, sentence_at, doc_at)[0] - toxicity.loss_and_gradient(theta - step, labels, ids, sentence_at, doc_at)[0]) / 2e-6
        assert math.isclose(grad[i], slope, rel_tol=1e-4, abs_tol=1e-7)


# --- 6 simhash ---


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [t for _, t in texts()[::40]] + [x for x in ODD if x is None or len(x) < 30_000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_links_of_fingerprints(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 7}
    for x in list(fps)[:60]:
        for flips in (1, 2, 3, 3, 3, 4, 5):
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            fps.add(y)
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = components(len(fps), links)
    at = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(fps)}
    for block in (1024, 16):
        got = [(at[r.u], at[r.v]) for r in simhash.fingerprint_links(df, block=block).collect()]
        assert components(len(fps), got) == want


def test_near_duplicates_in_odd_cases(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0} and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert [r.component_id for r in got if r.doc_id is None and r.fp != 0] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- 7 personal data ---

PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0


def brute_spans(text, kinds):
    return sorted(((k, *m.span()) for k, (p, ok) in kinds.items() for m in p.finditer(text or "") if ok(m[0])), key=lambda s: (s[1], list(kinds).index(s[0]), s[2]))


def test_pii_base_spans():
    rng = random.Random(11)
    made = ["".join(rng.choice("a.@1204 -+()%9\n5é") for _ in range(rng.randrange(120))) for _ in range(4000)]
    made += ["a@b.c@d.e", "x@@y.z", "a@b..c", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "4111 1111 1111 1111", "+1 (212) 555-0100.", "+1+22 333 444 5555 6", "é@b.co", "٣.1.2.3.4", "+4١ 23456789012", "300.1.1.1.5.6.7.8"]
    for t in [t for _, t in texts()] + made + ODD:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute_spans(t, PII), repr(t)[:300]


def test_pii_linear_on_long_runs():
    for t in ("ssn a@b.cd 123456 " * 30_000, "account " + "1" * 300_000, "a" * 300_000 + "@", "1" * 300_000 + ".1", "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1-" * 150_000):
        pii.find(t)


def test_pii_adds_spans_and_redacts():
    t = "see https://bob:pw@host.example/x, IBAN GB82 WEST 1234 5698 7654 32 and account no 12345678. mail a@b.org"
    kinds = {k: t[a:b] for k, a, b in pii.find(t)}
    assert kinds["url_user"] == "https://bob:pw@host.example" and kinds["iban"] == "GB82 WEST 1234 5698 7654 32" and kinds["account"] == "12345678"
    clean = pii.redacted(t)
    assert not brute_spans(clean, PII) and clean.endswith("mail [EMAIL]") and pii.redacted(None) is None and pii.redacted("plain") == "plain"


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("Social Security 123-45-6789", "account", "123-45-6789"),
        ("Tax ID: 123456789", "account", "123456789"),
        ("Account Number: 12345678", "account", "12345678"),
        ("Account No. 12345678", "account", "12345678"),
        ("aCCount nUmber 12345678", "account", "12345678"),
        ("SSN ID 123456789", "account", "123456789"),
        ("account " + "12345678901234567890" * 3, "account", "12345678901234567890" * 3),
        ("IBAN " + "x" * 45 + " DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("iban not AB12 CDEF GHIJ KLMN OPQ, DE89370400440532013000", "iban", "DE89370400440532013000"),
        ("IBAN REF AB12 DE89370400440532013000", "iban", "DE89370400440532013000"),
        ("\u0130\u0130 Tax Id 123456789", "account", "123456789"),
    ],
)
def test_pii_added_spans_in_all_spellings(text, kind, value):
    assert [(k, text[a:b]) for k, a, b in pii.find(text) if k in ("account", "iban")] == [(kind, value)]
    assert value not in pii.redacted(text)


def test_pii_several_numbers_after_one_cue():
    text = "account 12345678, DE89370400440532013000 or GB82WEST12345698765432"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == [("account", "12345678"), ("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432")]
    assert pii.find("iban " * 40_000) == []  # each search ends at its window
    assert [k for k, _, _ in pii.find("account +49 30 12345678")] == ["phone"]  # a base span is no account besides


def test_pii_query(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op7_pii"](spark, SF).collect()}
    for k, t in texts():
        spans = brute_spans(t, PII)
        assert got[k].base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in PII] == [sum(s[0] == x for s in spans) for x in PII]
    assert pii.personal_data(odd_docs(spark)).count() == len(ODD) + 4


# --- 9 secrets ---

SECRETS = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), None),
    "access": (re.compile("AKIA[A-Z0-9]+"), None),
    "hex": (re.compile("[0-9a-f]+"), None),
}


def brute_secrets(text):
    out = []
    for k, (p, _) in SECRETS.items():
        for m in p.finditer(text or ""):
            if (len(m[2]) >= 8) if k == "assign" else len(m[0]) >= (16 if k == "access" else 32):
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(SECRETS).index(s[0]), s[2]))


def test_secret_spans():
    rng = random.Random(12)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "ſecret", "toKen", "\n", "zz"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    for t in [t for _, t in texts()] + made + ODD:
        assert [c[:3] for c in secrets.find(t) if c[0] in secrets.BASE] == brute_secrets(t), repr(t)[:300]


def test_added_secrets_and_long_runs():
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----"
    assert [(k, v) for k, _, _, v in secrets.find(f"x {key} y")] == [("private_key", "MIIabc")]
    assert [c[0] for c in secrets.find("Bearer abcdefgh12345678 and https://u:hunter22@h")] == ["bearer", "url_password"]
    for t in ("-----BEGIN PRIVATE KEY-----" * 20_000 + key, "password" + " " * 300_000, "token" * 60_000, "abcdef0123" * 50_000, "x://a:b" * 50_000):
        secrets.find(t)


def brute_classes(rows, repositories, owners):
    """Class of each span and the counts of a row's values, from all rows' plain sets."""
    repos, own = collections.defaultdict(set), collections.defaultdict(set)
    for k, t, source in rows:
        for _, _, _, value in secrets.find(t):
            repos[value].add(k)
            own[value].add(source)

    def one(value):
        if len(repos[value]) >= repositories and len(own[value]) >= owners:
            return "copied"
        n = len(value)
        bits = -sum(c / n * math.log2(c / n) for c in collections.Counter(value).values()) if n else 0
        return "weak" if bits < 2.5 else "shared" if len(own[value]) > 1 else "live"

    for k, t, _ in rows:
        found = secrets.find(t)
        kinds = collections.Counter(one(v) for v in {c[3] for c in found})
        most = [max((len(x[c[3]]) for c in found), default=0) for x in (own, repos)]
        yield k, ",".join(one(c[3]) for c in found), [kinds[c] for c in secrets.CLASSES], most


def test_ownership(spark):
    shown, live, both, low, pasted = "AKIA" + "EXAMPLE9" * 2, "AKIA" + "Q7ZP40LM1X8V", "AKIA" + "R5TY81KD9C2W", "AKIA" + "A" * 16, "AKIA" + "J3N6B0VX4Q1E"
    rows = [(i, f"key {shown} here", f"s{i % 4}") for i in range(8)] + [(8, f"use {live}, {live} {low}", "s1"), (9, f"use {live}", "s1"), (10, None, None), (11, f"{both} {shown}", None), (12, both, "s2")]
    rows += [(20 + i, f"see {pasted}", "s0") for i in range(12)]  # one owner, many repositories
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for at_least in ((10, 3), (3, 3), (8, 2), (100, 2)):
        got = {r.doc_id: r for r in secrets.secrets(df, copied_repositories=at_least[0], copied_owners=at_least[1]).collect()}
        assert len(got) == len(rows)
        for k, classes, counts, most in brute_classes(rows, *at_least):
            r = got[k]
            assert (r.classes, [r[f"n_{c}"] for c in secrets.CLASSES], [r.most_owners, r.most_repositories]) == (classes, counts, most), k
        if at_least == (3, 3):  # what one owner has pasted into a dozen repositories is that owner's
            assert [got[k].classes for k in (0, 8, 11, 12, 20, 10)] == ["copied", "live,live,weak", "shared,copied", "shared", "live", ""]
    odd = odd_docs(spark)
    assert secrets.secrets(odd).count() == odd.count() and secrets.secrets(odd.limit(0)).count() == 0


def test_secrets_query(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op9_secrets"](spark, SF).collect()}
    for k, t in texts():
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in brute_secrets(t)).encode()).hexdigest()
        assert got[k].spans == ",".join(f"{a}:{b}:{c}" for a, b, c, _ in secrets.find(t))
    rows = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    for k, classes, counts, most in brute_classes(rows, secrets.COPIED_REPOSITORIES, secrets.COPIED_OWNERS):
        assert (got[k].classes, [got[k][f"n_{c}"] for c in secrets.CLASSES], [got[k].most_owners, got[k].most_repositories]) == (classes, counts, most)


# --- 10 packing ---


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, path, public_tokenizers.PATTERN, shard_tokens=300_000).collect()
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in texts()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = want[k][r.start : r.start + r.length]
            assert r.start == at and len(ids) == r.length > 0 and r.doc_tokens == len(want[k])
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[k])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at.bit_count() == 1 else 2048 - at
    assert padding == 0 and len(by_sequence) < sum(map(len, want.values())) / 2048 + 60


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * k, 100 * k + 60, 300) for k in range(1, 9) for _ in range(6)]
    docs = [topics[i].astype(np.uint16) for i in rng.permutation(len(topics))]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=65536)
    sequences = packing.windows(docs, packing.Index(docs, frequency, len(docs), 300.0), 1024)
    same = [int(docs[a[0]][0]) // 100 == int(docs[b[0]][0]) // 100 for s in sequences for a, b in zip(s, s[1:])]
    assert np.mean(same) > 0.6


def test_packing_brings_neighbours_together_over_many_shards(spark):
    """Texts and near copies of them, far apart in the table: over 20 shards and over 80, a pair shares a shard."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("bcdfghklmnprstvz") + list("aeiou"), 6)) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    for n in (400, 1600):
        first = [[words[w] for w in rng.integers(0, 3000, 60)] for _ in range(n // 2)]
        second = [[words[rng.integers(3000)] if rng.random() < 0.1 else w for w in t] for t in first]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(first + second)], "doc_id long, text string")
        shard, tokens = {}, 0
        for r in packing.pack(docs, path, public_tokenizers.PATTERN, shard_tokens=4000).where("start = 0").collect():
            shard[r.doc_id], tokens = r.sequence_id >> 32, tokens + r.doc_tokens
        assert len(shard) == n and len(set(shard.values())) >= n / 20
        assert tokens / 4000 - 1 < len(set(shard.values())) <= tokens / 4000 + 1
        assert np.mean([shard[i] == shard[i + n // 2] for i in range(n // 2)]) > 0.85


def brute_neighbours(docs, seed, unused, frequency, n_docs, mean):
    scores = []
    for d in sorted(unused):
        score = 0.0
        for t in sorted(set(docs[seed].tolist()) & set(docs[d].tolist())):
            times = docs[d].tolist().count(t)
            idf = math.log(1 + (n_docs - frequency[t] + 0.5) / (frequency[t] + 0.5))
            score += idf * times * (1.2 + 1) / (times + 1.2 * (1 - 0.75 + 0.75 * len(docs[d]) / mean))
        if score > 0:
            scores.append((-round(score, 9), d))
    return [d for _, d in sorted(scores)]


def brute_windows(docs, frequency, n_docs, mean, size):
    """The first unused document opens an empty window; its neighbours fill it, then what is next in order; a document that
    is cut seeds the next window. Full windows only, then what is left."""
    unused, out, current, room, seed = set(range(len(docs))), [], [], size, None
    waiting = []
    while unused:
        if seed is None:
            d = seed = min(unused)
            waiting = None
        else:
            if waiting is None:
                waiting = brute_neighbours(docs, seed, unused, frequency, n_docs, mean)
            d = waiting.pop(0) if waiting else min(unused)
        unused.discard(d)
        at = 0
        while at < len(docs[d]):
            take = min(room, len(docs[d]) - at)
            current.append((d, at, take))
            at, room = at + take, room - take
            if not room:
                out.append(current)
                current, room = [], size
                seed, waiting = (d if at < len(docs[d]) else None), None
    return out, current


def test_packing_scores_and_greedy_fill_against_brute_force():
    rng = np.random.default_rng(17)
    docs = [(rng.zipf(1.6, int(n)) % 500 + 10 * (i % 5)).astype(np.uint16) for i, n in enumerate(rng.integers(5, 400, 60))]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=65536) * 3  # of a larger corpus
    args = frequency, 200, 150.0
    index = packing.Index(docs, *args)
    for seed in range(0, 60, 7):
        unused = rng.random(60) < 0.6
        unused[seed] = False
        assert index.neighbours(seed, unused).tolist() == brute_neighbours(docs, seed, np.nonzero(unused)[0].tolist(), *args)
    full, left = brute_windows(docs, *args, 256)
    got = packing.windows(docs, index, 256)
    assert got[: len(full)] == full and all(sum(p[2] for p in s) == 256 for s in full)
    rest = got[len(full) :]
    assert [sum(p[2] for p in s).bit_count() for s in rest] == [1] * len(rest)
    assert sum(p[2] for s in rest for p in s) == sum(p[2] for p in left)


def test_seed_asks_with_all_its_terms():
    """Neighbours that share only terms past the seed's 32 most telling ones are found too."""
    docs = [np.arange(100, 200, dtype=np.uint16), np.arange(190, 290, dtype=np.uint16)]
    frequency = np.ones(65536, np.int64)
    frequency[190:200] = 2
    assert packing.Index(docs, frequency, 50, 100.0).neighbours(0, np.array([False, True])).tolist() == [1]


def test_packing_in_odd_cases(spark):
    docs = odd_docs(spark)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert sum(1 for r in got if r.start == 0) == sum(1 for r in got if r.start + r.length == r.doc_tokens) == docs.count()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_ids_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    raw = open(path, encoding="utf-8").read()
    ranks = packing.ranks_of(json.loads(raw))
    assert len(ranks) == 50256 and {len(p) for p, i in ranks.items() if i < 256} == {1}
    e = packing.Encoder(raw, public_tokenizers.PATTERN)
    slow = packing.Encoder(raw.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type": "NFC"}'), public_tokenizers.PATTERN)
    assert e.fast and not slow.fast
    rng = random.Random(13)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "<", " ", "\n", "word", " 12", "é", "\x1c", "\xa0", "<|startoftext|>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    for x in ["a <|endoftext|> b", "<|endoftext|>", "a\x1c b", " \xa0 x", *made, *[x for x in ODD if x], *[x for _, x in texts()]]:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]
    assert np.frombuffer(e.encode("x <|endoftext|> y"), "<u2").tolist() == [87, 220, 50256, 331, 1]
    assert np.frombuffer(slow.encode("plain <|endoftext|>"), "<u2").tolist() == [*t.encode("plain <|endoftext|>", add_special_tokens=False).ids, 1]


# --- SQL ---


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(registry.SQL[name]).select(*[duckdb.ColumnExpression(c) for c in columns])
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_ids_over_white_space_are_those_of_the_plain_call():
    """Texts with and without two white spaces in a row take different patterns: same ids. No look ahead where none is needed."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.Encoder(open(path, encoding="utf-8").read(), public_tokenizers.PATTERN)
    calls = []
    straight, fast = e.straight, e.fast
    e.straight, e.fast = (lambda x: calls.append("straight") or straight(x)), (lambda x: calls.append("fast") or fast(x))
    rng = random.Random(17)
    parts = ["word", "'s", "'ll", "12", "é", "日本", "..", "?", "\x1c", "\x1f", "​", *packing.WHITE, " ", " ", "\n"]
    for _ in range(5000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(e.encode(x), "<u2").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]
        assert calls.pop() == ("fast" if re.search(r"[^\S\x1c-\x1f]{2}", x) else "straight")
    other = packing.Encoder(open(path, encoding="utf-8").read(), r"\S+|\s+")
    assert other.straight is None and other.fast("a  b") == [64, 220, 220, 65]


def test_terms_are_counted_for_documents_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 40, rng.integers(1, 90)).astype("<u2") for _ in range(300)] + [np.array([65535, 0, 65535], "<u2")]
    of, terms, times = packing.counted(docs)
    assert list(zip(of.tolist(), terms.tolist(), times.tolist())) == [(i, t, c) for i, d in enumerate(docs) for t, c in sorted(collections.Counter(d.tolist()).items())]
    many = [np.array([i & 7], "<u2") for i in range(70_000)]
    assert [x.tolist() for x in packing.counted(many)] == [list(range(70_000)), [i & 7 for i in range(70_000)], [1] * 70_000]
    frequency = np.bincount(terms, minlength=65536)
    idf = np.where(frequency > 1, packing.inverse(frequency, len(docs)), 0)
    mean = float(np.mean([len(d) for d in docs]))
    want = []
    for d in docs:
        weight = {t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, c in collections.Counter(d.tolist()).items()}
        want.append(sorted((t for t in weight if weight[t] > 0), key=lambda t: (-weight[t], t))[: packing.TELLING])
    for together in (1, 100, 1 << 20):  # documents beyond it, several lists, one
        monkeypatch.setattr(packing, "TOGETHER", together)
        assert [len(d) for x in packing.few(docs) for d in x] == [len(d) for d in docs]
        assert [np.frombuffer(t, ">u2").tolist() for t, _ in packing.telling(docs, idf, mean)] == want
    # The frequencies that the encoding's batches note are those of all documents.
    path = public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        some = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
        rows = some.select(packing.ids_of(spark, F.col("text"), path, public_tokenizers.PATTERN).alias("r")).select("r.*").localCheckpoint()
        got = {r.id: r.n for r in rows.where("held is not null").select("held").mapInArrow(packing._frequencies, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
        ids = packing.unpacked(rows.select("ids", "n").toArrow())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(ids) == 150 and got == dict(collections.Counter(i for d in ids for i in set(d.tolist())))


def test_strips_of_scores_are_those_of_single_seeds(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 120, 80).astype(np.uint16) for _ in range(90)]
    frequency = np.bincount(packing.counted(docs)[1], minlength=65536)
    monkeypatch.setattr(packing, "STRIP", 32)
    strips, unused = packing.Index(docs, frequency, 90, 80.0), rng.random(90) < 0.7
    got = [(strips.long_scores(i), strips.neighbours(i, unused), strips.neighbours(i, unused)) for i in range(90)]
    monkeypatch.setattr(packing, "SQUARE", 10)
    single = packing.Index(docs, frequency, 90, 80.0)
    for i, (scores, first, again) in enumerate(got):
        assert np.allclose(scores, single.long_scores(i), rtol=1e-12) and (first == again).all()
        assert sorted(first) == sorted(single.neighbours(i, unused))


def test_components_of_links(spark):
    """Chains, cycles, leaves, a hub and a target that links nowhere."""
    rng = random.Random(8)
    links = {u: rng.choice([v for v in range(max(0, u - 9), u + 5) if v != u]) for u in range(400)}
    links |= {1000 + i: 2000 for i in range(50)} | {3000: 3001, 3001: 3002, 3002: 3000, 3003: 3000}
    at = {}

    def top(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for u, v in links.items():
        at[top(u)] = top(v)
    rows = packing.components_of_links(spark.createDataFrame(list(links.items()), "u long, v long"), len(links)).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got) and set(got) == set(links)
    names = collections.defaultdict(set)
    for u, c in got.items():
        names[top(u)].add(c)
    assert all(len(x) == 1 for x in names.values()) and len({min(x) for x in names.values()}) == len(names)
    assert got[1000] == 2000 and all(top(c) == top(u) for u, c in got.items())
