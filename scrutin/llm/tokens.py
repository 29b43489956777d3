"""Token counts under a unigram model, by dynamic programming that words share in a trie.

A pre-token's best segmentation into pieces has the highest sum of log scores. Its forward scores depend on prefixes only,
so the distinct pre-tokens that a worker has not met go into a trie, depth first: each node's forward score and token
count are computed once for all words that share the prefix, and a word's terminal node gives its count. The trie lives in
the worker that reads the texts: no shuffle, and its size is bounded, however many distinct words a corpus has."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: Characters of texts that are worked on together; segments whose counts a worker keeps (twice as many at most: the older
#: half goes when the newer is full); longer segments than LONG characters are computed again each time.
TOGETHER, MOST_SEGMENTS, LONG = 2_000_000, 300_000, 512

#: Under this pattern (a fixed value) pre-tokens never reach over a white space that follows something else, nor from a
#: letter to a stop or comma, so a text is cut there and each segment (white space and a word, marks at a word's end, or white space and anything else) is
#: worked on once. White space of Python's that other engines don't count is left alone, and under any other pattern a text
#: is not cut.
CUT_UNDER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SEGMENT = re.compile(rf"\s*[{LETTERS}]+(?=[\s.,;:!?]|$)|[.,;:!?]+(?=\s|$)|\s*\S+|\s+")
UNUSUAL = re.compile("[\x1c-\x1f]")


ONLY_END, NO_END = 2.0, 1.0


def segments(text: str, pattern: str = CUT_UNDER) -> list[str]:
    if pattern != CUT_UNDER or UNUSUAL.search(text):
        return [text] if text else []
    return SEGMENT.findall(text)


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (a line each: base64 of the piece, its rank), by rank."""
    with open(path, "rb") as lines:
        return [piece for _, piece in sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))]


class Trie:
    """pieces by rank: a piece's log score is that of Zipf's law, -ln(rank + 1) less the log of the total."""

    def __init__(self, pieces: list[bytes], pattern: str):
        norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.scores = {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}
        # Log scores are under 0. Ends of pieces that are no pieces have ONLY_END: where even that is absent, no longer piece ends.
        self.ends = dict.fromkeys((p[i:] for p in pieces for i in range(1, len(p))), ONLY_END) | self.scores
        self.unknown = -2 * math.log(len(pieces) + 1)
        self.pattern, self.pre_token = pattern, regex.compile(pattern)
        self.seen: dict[str, tuple[int, int, float]] = {}
        self.older = self.seen

    def counts(self, words: list[bytes]) -> Iterator[tuple[int, float]]:
        """Tokens and score of each of the sorted distinct words: in that order the trie's nodes are met depth first, and
        `best` and `tokens` hold those on the path to the current one.

        Of equal scores the fewest tokens count. A byte that is no piece costs what the rarest piece costs."""
        best, tokens, get, before = [0.0], [0], self.ends.get, b""
        for word in words:
            shared, least = 0, min(len(before), len(word))
            while shared < least and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, few = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    score = get(word[start:end], NO_END)
                    if score > 0:
                        if start == end - 1:
                            score = self.unknown
                        elif score == ONLY_END:
                            continue
                        else:
                            break
                    score += best[start]
                    if score > top or score == top and tokens[start] + 1 < few:
                        top, few = score, tokens[start] + 1
                best.append(top)
                tokens.append(few)
            before = word
            yield tokens[-1], best[-1]

    def learn(self, new: set[str]) -> dict[str, tuple[int, int, float]]:
        """Pre-tokens, tokens and score of each segment that no text had before."""
        parts = {s: [w.encode("utf-8", "replace") for w in self.pre_token.findall(s)] for s in new}
        words = sorted({w for own in parts.values() for w in own})
        of = dict(zip(words, self.counts(words)))
        return {s: (len(own), sum(of[w][0] for w in own), math.fsum(of[w][1] for w in own)) for s, own in parts.items()}

    def together(self, texts: list[str]) -> Iterator[tuple[int, int, int, float]]:
        cut = [segments(t, self.pattern) for t in texts]
        needed = set().union(*cut)
        if len(self.seen) > MOST_SEGMENTS:
            self.older, self.seen = self.seen, {}
        own = {s: x for s in needed if (x := self.seen.get(s) or self.older.get(s))}
        own |= self.learn(needed - own.keys())
        self.seen |= {s: x for s, x in own.items() if len(s) <= LONG}
        for text, of in zip(texts, cut):
            pre_tokens, tokens, scores = zip(*map(own.__getitem__, of)) if of else ((), (), ())
            yield len(text.encode("utf-8", "replace")), sum(pre_tokens), sum(tokens), math.fsum(scores)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float]]:
        """Bytes, pre-tokens, tokens and score of each whole text; the score does not depend on the order of summing."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size > TOGETHER:
                yield from self.together(some)
                some, size = [], 0
        yield from self.together(some)


_held: dict[int, Trie] = {}


def worker_trie(vocabulary: tuple[list[bytes], str]) -> Trie:
    """The worker's trie, kept for its later tasks."""
    pieces, pattern = vocabulary
    key = hash((len(pieces), pieces[-1] if pieces else b"", pattern))
    if key not in _held:
        _held.clear()
        _held[key] = Trie(pieces, pattern)
    return _held[key]


COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in ("n_bytes", "n_pretokens", "n_tokens")] + [T.StructField("log_score", T.DoubleType())])


def counts_of(spark: SparkSession, text: Column, pieces: list[bytes], pattern: str) -> Column:
    """struct(n_bytes, n_pretokens, n_tokens, log_score). The vocabulary, of fixed size, is sent to each executor once."""
    sent = spark.sparkContext.broadcast((pieces, pattern))

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        trie = worker_trie(sent.value)
        return pd.DataFrame(list(trie.texts(texts)), columns=COUNTS.names)

    return count.asNondeterministic()(text)


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_pretokens, n_tokens, log_score), a row for each row; map-only.

    Null and empty texts: zeros. Ids are passed on as they are, null or repeated; other columns are not read. The pattern
    is a tokenizer's pre-token pattern; the vocabulary a rank file, read on the driver."""
    r = counts_of(docs.sparkSession, F.col(f"`{text_col}`"), vocabulary(vocabulary_path), pattern)
    return docs.select(F.col(f"`{id_col}`").alias(id_col), r.alias("r")).select(id_col, "r.*")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
