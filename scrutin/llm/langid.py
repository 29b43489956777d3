"""Language ID by compression.

Each language has a raw-content dictionary: pieces of its training texts, side by side. A text is cut into blocks and each
block is compressed by zstandard with each language's dictionary; the language whose sizes sum to the least is the text's.
Where the second least is hardly larger, the answer is given but not accepted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .shared import table

#: The sample that dictionaries are made of: about so many pieces of so many characters for each language, from texts chosen
#: by a hash of the text; several from each where a language has few. A dictionary is at most that many bytes.
PIECES, PIECE = 512, 200
DICTIONARY = 96_000
#: The last level before zstandard's optimal parser, which gains little from raw dictionaries.
LEVEL = 12
#: Characters a block, so that the dictionary tells at the end of a long text as it does at its beginning.
BLOCK = 4000
#: An answer is accepted if the second best language takes so many bytes more, and so large a share of the best one's.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.02
UNKNOWN = "und"


def learn(docs: DataFrame, *, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), the languages with more texts first, then by name.

    Only rows outside the fold with a language and a text are read. Copies count once, so a large group of them fills no
    dictionary. What comes to the driver is PIECES * PIECE characters or so for each language."""
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`"), folds, fold).alias("out"))
    rows = rows.where("not out and lang is not null and trim(text) <> ''").withColumn("hash", F.xxhash64("text"))
    texts = rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("texts")).collect()  # a row for each language
    if not texts:
        return []
    share = F.create_map(*[F.lit(x) for r in texts for x in (r["lang"], PIECES / r["texts"])])[F.col("lang")]
    chosen = rows.withColumn("share", share).where(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    pieces = chosen.select("lang", "text", "hash", F.explode(F.sequence(F.lit(1), F.ceil("share").cast("int"))).alias("k"))
    start = 1 + F.pmod(F.xxhash64("hash", "k"), F.greatest(F.lit(1), F.char_length("text") - PIECE + 1)).cast("int")
    pieces = pieces.select("lang", F.xxhash64("hash", "k").alias("place"), F.substring("text", start, F.lit(PIECE)).alias("piece"))
    own: dict[str, list[str]] = {r["lang"]: [] for r in sorted(texts, key=lambda r: (-r["texts"], r["lang"]))}
    for r in pieces.groupBy("lang", "piece").agg(F.min("place").alias("place")).orderBy("place", "piece").collect():
        own[r["lang"]].append(r["piece"].lower())
    return [(lang, "\n".join(p).encode()[:DICTIONARY]) for lang, p in own.items() if p]


class Compressors:
    def __init__(self, learned: list[tuple[str, bytes]]):
        import zstandard

        self.names, self.by = [lang for lang, _ in learned], []
        for _, content in learned:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text, block by block, by each language's dictionary."""
        total = [0] * len(self.by)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK].lower().encode()
            for i, c in enumerate(self.by):
                total[i] += len(c.compress(block))
        return total

    def predict(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, by how many bytes the second best is larger, accepted. Ties go to the language with more texts.
        The score is the best language's share of weights that halve with each byte more."""
        if not text or not self.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, 0, True
        margin = sorted(sizes)[1] - sizes[best]
        score = 1 / sum(2.0 ** max(sizes[best] - s, -1000) for s in sizes)
        return self.names[best], score, margin, margin >= max(MARGIN_BYTES, MARGIN_SHARE * sizes[best])


def language_of(spark: SparkSession, learned: list[tuple[str, bytes]], text: Column) -> Column:
    """struct(lang_pred, score, margin, accepted) of a whole text."""
    sent = spark.sparkContext.broadcast(learned)  # DICTIONARY bytes for each language

    @F.pandas_udf("lang_pred string, score double, margin long, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by = Compressors(sent.value)
        for texts in batches:
            yield pd.DataFrame([by.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "accepted"])

    return predict.asNondeterministic()(text)


def languages(docs: DataFrame, *, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, margin, accepted), a row for each row; after the dictionaries are made, map-only.

    The prediction reads the text alone. lang_pred is `und` (score 0, not accepted) for a text that is null or has no
    letter, and for all if no language was learned; it is always a learned one else, and `accepted` says whether the margin
    carries it. Null ids are folded as the text "null"; repeated rows each get their row; empty table: no rows. Very long
    texts are read block by block. Other columns are not read."""
    learned = learn(docs, folds=folds, fold=fold, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), held_out(F.col(f"`{id_col}`"), folds, fold).alias("held_out"), language_of(docs.sparkSession, learned, F.col(f"`{text_col}`")).alias("r"))
    return out.select(F.col(f"`{id_col}`"), "held_out", "r.*")


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
