"""Lexical retrieval packing.

Related documents are first brought together over the whole corpus: each document looks for its best neighbour among those
that share one of its telling terms, and what these links connect is laid side by side in one lexical order. That order is
cut into shards of a bounded number of tokens. Each shard has an inverted BM25 index over its documents' token ids, with
document frequencies of the whole corpus. A window is opened by a seed document; the index returns the seed's unused
neighbours, best first, and these fill the window greedily. What doesn't fit is cut and seeds the next window, so all
windows but a shard's last are full."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, drop, join_hot, table, written

WINDOW = 2048
END_ID = 1
#: About so many tokens per shard; a document is never split over shards.
SHARD_TOKENS = 1 << 20
#: A document is compared over the whole corpus by so many telling terms, and sorted under each of the first PASSES of
#: them; BLOCK documents that a sort makes consecutive are compared with each other, so a common term costs linear time.
TELLING, PASSES, BLOCK = 16, 8, 64
K1, B = 1.2, 0.75
#: Posting lists with at least one in so many of a shard's documents are long.
DENSE = 16
#: A shard of at most SQUARE documents (of 512 tokens on average, so that a good part of them become seeds) scores its long
#: lists for STRIP documents at a time, by one matrix product.
SQUARE, STRIP = 2048, 256
#: Tokens of documents that are told apart by one sort.
TOGETHER = 1 << 20
_held: dict = {}

#: Under this pattern (a fixed value) pieces are those of a second one, whose `++` only say what never is given back, and,
#: in texts without two white spaces in a row, of a third one that needs no look ahead and so no backtracking.
LOOKS_AHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEPS = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
STRAIGHT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
WHITE = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def has_runs(text: str) -> bool:
    """Two white spaces in a row."""
    white = [w for w in (WHITE[:6] if text.isascii() else WHITE) if w in text]
    return any(a + b in text for a in white for b in white)


def ranks_of(kind: dict) -> dict[bytes, int] | None:
    """The byte pieces of a tokenizer file by rank, if it is plain byte-level BPE whose merges are in the order of their
    ids: then ranks say all that the file does. Otherwise None."""
    from tokenizers import pre_tokenizers

    model, pre = kind["model"], kind.get("pre_tokenizer") or {}
    if kind.get("normalizer") or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or model.get("type") != "BPE" or model.get("dropout"):
        return None
    byte_level, byte_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for char in map(chr, range(256)):
        byte_of |= {shown: byte for byte, shown in zip(char.encode(), byte_level.pre_tokenize_str(char)[0][0])}
    special = {t["content"] for t in kind.get("added_tokens", [])}
    pieces = {piece: i for piece, i in model["vocab"].items() if piece not in special}
    missing = sorted({c for p in pieces for c in p} - set(byte_of))
    absent = sorted(set(range(256)) - set(byte_of.values()))
    byte_of |= dict(zip(missing, absent))  # bytes that no UTF-8 text holds, in order
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [pieces.get(m, -1) for m in merged]
    if order != sorted(order) or len(merged) + 256 != len(pieces) or -1 in order:
        return None
    return {bytes(byte_of[c] for c in p): i for p, i in pieces.items()}


class Encoder:
    """Ids of whole texts, those of Tokenizer.encode(text, add_special_tokens=False) of a tokenizer's file, as little-endian
    unsigned 16-bit bytes.

    A file that ranks say all about is run by the faster of the two libraries over those ranks and the file's ids, but for
    texts that hold the string of an added token: those, and any other file's texts, are run by that very call. tests/llm
    compares both text by text."""

    def __init__(self, tokenizer_json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        kind = json.loads(tokenizer_json)
        ranks, added = ranks_of(kind), kind.get("added_tokens", [])
        if max([*kind["model"]["vocab"].values(), *(t["id"] for t in added)]) > 65535:
            raise ValueError("ids must fit 16 bits")
        self.file, self.added, self.plain, self.straight = tokenizer_json, [t["content"] for t in added], None, None
        if ranks and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            import tiktoken

            def under(pattern: str):
                return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            if pattern == LOOKS_AHEAD:
                self.fast, self.straight = under(KEEPS), under(STRAIGHT)
            else:
                self.fast = under(pattern)
        else:
            self.fast = None

    def run(self, text: str) -> list[int]:
        if self.fast and not any(x in text for x in self.added):
            return self.straight(text) if self.straight and not has_runs(text) else self.fast(text)
        if not self.plain:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_str(self.file)
        return self.plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text (null: none), then the end id."""
        ids = self.run(text or "")
        return np.fromiter(chain(ids, (END_ID,)), "<u2", len(ids) + 1).tobytes()


def worker_encoder(tokenizer_json: str, pattern: str) -> Encoder:
    """The worker's encoder, kept for its later tasks."""
    key = len(tokenizer_json), zlib.crc32(tokenizer_json[:100_000].encode())
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(tokenizer_json, pattern)
    return _held[key]


def ids_of(spark: SparkSession, text: Column, tokenizer_path: str, pattern: str) -> Column:
    """A struct: ids, compressed since they are shuffled twice, n, their number, and, in the first row of each batch, held:
    how many documents of the batch hold each id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # of fixed size

    @F.pandas_udf("ids binary, n long, held binary")
    def ids(texts: pd.Series) -> pd.DataFrame:
        encoder, codec = worker_encoder(sent.value, pattern), pa.Codec("zstd", compression_level=1)
        raw = [encoder.encode(t) for t in texts]
        total = np.zeros(65536, "<u4")
        for docs in few([np.frombuffer(x, "<u2") for x in raw]):
            total += np.bincount(counted(docs)[1], minlength=65536).astype("<u4")
        held = [codec.compress(total.tobytes(), asbytes=True), *[None] * (len(raw) - 1)][: len(raw)]
        return pd.DataFrame({"ids": [codec.compress(x, asbytes=True) for x in raw], "n": [len(x) // 2 for x in raw], "held": held})

    return ids.asNondeterministic()(text)


def unpacked(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    return [np.frombuffer(codec.decompress(x, 2 * n, asbytes=True), "<u2") for x, n in zip(rows.column("ids").to_pylist(), rows.column("n").to_pylist())]


def few(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The documents in their order, by lists of about TOGETHER tokens."""
    ends = np.cumsum([len(d) for d in docs])
    begin = 0
    while begin < len(docs):
        before = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, before + TOGETHER, "right")), begin + 1)
        yield docs[begin:end]
        begin = end


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and times for each distinct term of each document, by document, then term."""
    kind = np.uint32 if len(docs) <= 65536 else np.uint64
    key = np.repeat(np.arange(len(docs), dtype=kind), [len(d) for d in docs]) << 16 | np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    key, times = key[first], np.diff(first, append=len(key))
    return (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64), times


def _frequencies(batches):
    """Documents that hold each id, of a task's batches of documents."""
    total, codec = np.zeros(65536, np.int64), pa.Codec("zstd")
    for batch in batches:
        for held in batch.column("held").to_pylist():
            total += np.frombuffer(codec.decompress(held, 4 * 65536, asbytes=True), "<u4")
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])


def inverse(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))


def telling(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> Iterator[tuple[bytes, bytes]]:
    """Each document's TELLING terms of the highest BM25 weight, best first, and the weights. idf: 0 for terms of one document."""
    for some in few(docs):
        of, terms, times = counted(some)
        lengths = np.array([len(d) for d in some])
        weights = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[of] / mean_length))
        ends = np.searchsorted(of, np.arange(len(some) + 1)).tolist()
        for begin, end in zip(ends, ends[1:]):
            term, weight = terms[begin:end], weights[begin:end]
            if len(weight) > TELLING:  # of those that reach the last place, the first by weight, then by term
                best = np.flatnonzero(weight >= np.partition(weight, len(weight) - TELLING)[len(weight) - TELLING])
                best = best[np.argsort(-weight[best], kind="stable")][:TELLING]
            else:
                best = np.argsort(-weight, kind="stable")
            best = best[weight[best] > 0]
            yield term[best].astype(">u2").tobytes(), weight[best].astype("<f2").tobytes()


def best_of_block(nodes: np.ndarray, terms: list[bytes], weights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a block the one that scores highest for its telling terms, and the score (0: none does)."""
    of = np.repeat(np.arange(len(nodes)), [len(t) // 2 for t in terms])
    seen, at = np.unique(np.frombuffer(b"".join(terms), ">u2"), return_inverse=True)
    weight = np.zeros((len(nodes), len(seen)), np.float32)
    weight[of, at] = np.frombuffer(b"".join(weights), "<f2")
    score = (weight > 0).astype(np.float32) @ weight.T
    score[nodes[:, None] == nodes[None, :]] = 0
    best = score.argmax(axis=1)
    return nodes[best], score[np.arange(len(nodes)), best]


def _best(batches):
    for batch in batches:
        nodes, terms, weights = batch.column("node").to_numpy(), batch.column("terms").to_pylist(), batch.column("weights").to_pylist()
        found = [best_of_block(nodes[a : a + BLOCK], terms[a : a + BLOCK], weights[a : a + BLOCK]) for a in range(0, len(nodes), BLOCK)]
        if found:
            other, score = map(np.concatenate, zip(*found))
            keep = score > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(other[keep]), pa.array(score[keep])], names=["u", "v", "score"])


def _running(batches):
    """Each row's number of tokens before it in its task."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(np.full(len(n), part, np.int32)), pa.array(at)], names=["row", "n", "part", "at"])


def components_of_links(links: DataFrame, most: int) -> DataFrame:
    """links(u, v), one of each node that has any -> (node, component), for every u, the components of the undirected graph.

    Only nodes that others link to are searched: all others belong where their own link leads. most: links at most. A node
    that links nowhere and is absent is a component's name, if any."""
    targets = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    core = links.join(targets.select(F.col("v").alias("u")), "u", "left_semi")
    found = connected_components(core).withColumnRenamed("node", "v")
    by_target = targets.join(found, "v", "left").select("v", "n", F.coalesce("component", "v").alias("component"))
    return join_hot(links, by_target, "v", "n", most).select(F.col("u").alias("node"), "component")


def lexical_order(ids: DataFrame, frequency, n_docs: int, mean_length: float) -> DataFrame:
    """ids(row, ids, n) -> (row, place): the tokens before the document in an order where related documents are neighbours.

    Copies are one node. Each node is sorted under each of its first PASSES terms, by its other best ones next, and
    compared with its block there; its best neighbour over all passes is its link. Components of links follow each other
    by their least telling terms, and within a component documents do. A term that many documents have, or a large group of
    copies, is only a longer stretch of a sort: no group is gathered."""
    spark = ids.sparkSession

    def signs(batches):
        idf = np.where(frequency.value > 1, inverse(frequency.value, n_docs), 0)
        for batch in batches:
            found = list(telling(unpacked(batch), idf, mean_length))
            columns = [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), batch.column("node"), *columns], names=["row", "n", "node", "terms", "weights"])

    signed = ids.select("row", "n", "ids", F.xxhash64("ids").alias("node")).mapInArrow(signs, "row long, n long, node long, terms binary, weights binary")
    signed, at_signs = written(signed, "signs")
    nodes = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("terms", "weights")).alias("s")).select("node", "copies", "s.*")
    passes = nodes.select("node", "terms", "weights", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("k")).where(F.octet_length("terms") > 2 * F.col("k"))
    passes = passes.withColumn("key", F.expr("concat(substring(terms, 2 * k + 1, 2), substring(terms, 1, 8))"))
    blocks = passes.repartitionByRange("key", "node").sortWithinPartitions("key", "node").select("node", "terms", "weights")
    links = blocks.mapInArrow(_best, "u long, v long, score float").groupBy("u").agg(F.max(F.struct("score", "v")).alias("best")).select("u", "best.v")
    links, at_links = written(links, "links")
    component = components_of_links(links, n_docs)
    named = nodes.join(component, "node", "left").select("node", "copies", "terms", F.coalesce("component", "node").alias("component"))
    lead = named.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.min("terms").alias("lead"))
    named = join_hot(named, lead, "component", "nodes", n_docs)
    named, at_named = written(named.select("node", "copies", "component", "lead"), "named")
    by = ["lead", "component", "terms", "row"]
    ordered = join_hot(signed, named, "node", "copies", n_docs).select("n", *by).repartitionByRange(*by).sortWithinPartitions(*by).select("row", "n")
    ordered, _ = written(ordered.mapInArrow(_running, "row long, n long, part int, at long"), "order")
    drop(spark, at_signs, at_links, at_named)
    total, offsets = 0, []
    for part, n in sorted(ordered.groupBy("part").agg(F.sum("n")).collect()):  # a row for each task
        offsets.append((part, total))
        total += n
    offsets = spark.createDataFrame(pa.table({"part": pa.array([o[0] for o in offsets], pa.int32()), "offset": pa.array([o[1] for o in offsets], pa.int64())}))
    return ordered.join(F.broadcast(offsets), "part").select("row", (F.col("offset") + F.col("at")).alias("place"))


class Index:
    """BM25 over a shard's documents. frequency: by id, of n_docs documents in all."""

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray, n_docs: int, mean_length: float):
        lengths = np.array([len(d) for d in docs])
        doc, term, times = counted(docs)
        self.weight = inverse(frequency, n_docs)[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[doc] / mean_length))
        self.begin, self.term = np.searchsorted(doc, np.arange(len(docs) + 1)), term
        order = np.argsort(term, kind="stable")
        self.postings, self.impact = doc[order], self.weight[order]
        self.ends = np.searchsorted(term[order], np.arange(65537))
        self.n = len(docs)
        # Long posting lists are also laid out as rows with a place for each document, which are summed faster than gathered.
        held = np.diff(self.ends)
        long_ = np.nonzero(held * DENSE >= max(self.n, 1))[0]
        self.row = np.full(65536, -1)
        self.row[long_] = np.arange(len(long_))
        rows = self.row[term[order]]
        self.dense = np.zeros((len(long_), self.n))
        self.dense[rows[rows >= 0], self.postings[rows >= 0]] = self.impact[rows >= 0]
        self.strips: dict[int, np.ndarray] = {}

    def long_scores(self, seed: int) -> np.ndarray:
        """What the long lists add to each document's score."""
        if self.n > SQUARE:
            asks = np.zeros(len(self.dense))
            row = self.row[self.term[self.begin[seed] : self.begin[seed + 1]]]
            asks[row[row >= 0]] = 1
            return asks @ self.dense
        strip, at = divmod(seed, STRIP)
        if strip not in self.strips:
            self.strips[strip] = (self.dense[:, strip * STRIP : (strip + 1) * STRIP] > 0).T.astype(float) @ self.dense
        return self.strips[strip][at].copy()

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by score, ties in the shard's order."""
        terms = self.term[self.begin[seed] : self.begin[seed + 1]]
        score, rare = self.long_scores(seed), terms[self.row[terms] < 0]
        if len(rare):
            begin, n = self.ends[rare], self.ends[rare + 1] - self.ends[rare]
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            score += np.bincount(self.postings[at], weights=self.impact[at], minlength=self.n)
        score[~unused] = 0
        found = np.nonzero(score)[0]
        return found[np.argsort(-score[found], kind="stable")]


def windows(docs: list[np.ndarray], index: Index, size: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). The last window, if its tokens are no power of two, is cut into
    sequences that are: those need no padding."""
    unused, at_unused = np.ones(len(docs), bool), 0
    out: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room, waiting, at_waiting, seed = size, np.zeros(0, np.int64), 0, -1
    for _ in range(len(docs)):
        if seed < 0:  # an empty window: the next unused document opens it
            while not unused[at_unused]:
                at_unused += 1
            doc = seed = at_unused
            asked = False
        else:
            if not asked:
                waiting, at_waiting, asked = index.neighbours(seed, unused), 0, True
            if at_waiting < len(waiting):
                doc, at_waiting = int(waiting[at_waiting]), at_waiting + 1
            else:
                while not unused[at_unused]:
                    at_unused += 1
                doc = at_unused
        unused[doc] = False
        start, n = 0, len(docs[doc])
        while n:
            take = min(n, room)
            current.append((doc, start, take))
            start, n, room = start + take, n - take, room - take
            if not room:
                out.append(current)
                current, room = [], size
                seed, asked = (doc, False) if n else (-1, False)  # what is cut seeds the next window
    left = [list(p) for p in current]
    while left:
        total = sum(p[2] for p in left)
        want, cut = 1 << (total.bit_length() - 1), []
        while want:
            take = min(want, left[0][2])
            cut.append((left[0][0], left[0][1], take))
            left[0][1], left[0][2], want = left[0][1] + take, left[0][2] - take, want - take
            if not left[0][2]:
                left.pop(0)
        out.append(cut)
    return out


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    pattern: the tokenizer's pre-token pattern.
    Null and empty texts are the end id alone. Repeated rows and ids, null ids too, are documents of their own. Empty
    table: no pieces. Very long documents fill windows of their own. Other columns are not read."""
    spark = docs.sparkSession
    ids = docs.select(F.col(f"`{id_col}`").alias("doc"), ids_of(spark, F.col(f"`{text_col}`"), tokenizer_path, pattern).alias("r")).select("doc", "r.*")
    ids, _ = written(ids.withColumn("row", F.monotonically_increasing_id()), "ids")
    n_docs, n_tokens = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_id = ids.select("held").where("held is not null").mapInArrow(_frequencies, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = np.zeros(65536, np.int64)
    for row in by_id.collect():  # at most as many rows as the vocabulary has ids
        frequency[row["id"]] = row["n"]
    sent, mean = spark.sparkContext.broadcast(frequency), float(n_tokens) / max(1, n_docs)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pack_shard(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        own = unpacked(rows)
        pieces = []
        for number, sequence in enumerate(windows(own, Index(own, sent.value, n_docs, mean), size)):
            offset = 0
            for doc, start, n in sequence:
                crc = zlib.crc32(own[doc][start : start + n].astype("<u4").tobytes())
                pieces.append((doc, start, n, crc, len(own[doc]), (key[0].as_py() << 32) + number, offset))
                offset += n
        columns = list(zip(*pieces))
        return pa.Table.from_arrays([rows.column("doc").take(pa.array(columns[0]))] + [pa.array(c, pa.int64()) for c in columns[1:]], names=schema.names)

    if n_tokens > shard_tokens:
        ids = ids.join(lexical_order(ids, sent, n_docs, mean).hint("shuffle_hash"), "row")  # the order's rows are small, those of ids are not sorted
        shard = F.expr(f"place div {shard_tokens}")
    else:  # one shard has all
        ids, shard = ids.withColumn("place", F.col("row")), F.lit(0).cast("long")
    dealt = ids.select("doc", "ids", "n", "place", shard.alias("shard"))
    return dealt.groupBy("shard").applyInArrow(pack_shard, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
