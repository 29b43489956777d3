"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in the tasks that read the texts. Trees are grown on a bounded sample of labelled documents
(MOST_TRAINING rows of numbers) and flattened into arrays, which vectorised numpy traversal applies to every document."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: The fit reads at most about this many labelled documents, chosen by a hash of their id.
MOST_TRAINING = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 80, 4, 0.15, 64, 8
PENALTY = 1.0

STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "other_bytes", "comma_stop", "pipe", "bang", "hash_star_dollar", "rest_punct",
    "log_words", "word_length", "distinct_words", "distinct_pairs", "top_word", "short_words", "long_words", "capital_words", "marked_words",
    "log_lines", "distinct_lines", "line_words", "stopped_lines", "repeated_line_bytes", "top_byte", "byte_entropy", "stops_per_word",
)


def _class_of_bytes() -> np.ndarray:
    """Byte -> which of the counted classes it belongs to."""
    out = np.full(256, 10, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)), b",.;:", b"|", b"!?", b"#*$%&@~^=+_<>{}[]\\")):
        out[list(chars)] = k
    return out


CLASS_OF = _class_of_bytes()


def statistics(text: str | None) -> np.ndarray:
    """The numbers of one whole text; all zero if it is null or has no word."""
    out = np.zeros(len(STATISTICS))
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    n, w = len(raw), len(words)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF, weights=by_byte, minlength=11) / n
    out[0], out[1:12] = np.log1p(n), classes
    lengths = np.fromiter(map(len, words), np.int64, w)
    often = Counter(words)
    out[12:16] = np.log1p(w), lengths.mean(), len(often) / w, len(set(zip(words, words[1:]))) / max(1, w - 1)
    out[16] = max(often.values()) / w
    out[17], out[18] = (lengths <= 2).mean(), (lengths >= 12).mean()
    out[19] = sum(c for x, c in often.items() if x.isupper()) / w
    out[20] = sum(c for x, c in often.items() if x[-1:] in b"!#*$%&|@~" or x[:1] in b"!#*$%&|@~") / w
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_often = Counter(lines)
    out[21:24] = np.log1p(len(lines)), len(line_often) / len(lines), w / len(lines)
    out[24] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    out[25] = sum((c - 1) * len(x) for x, c in line_often.items()) / n
    share = by_byte[by_byte > 0] / n
    out[26], out[27] = share.max(), -(share * np.log2(share)).sum()
    out[28] = by_byte[[33, 46, 63]].sum() / w
    return out


def traverse(x: np.ndarray, column: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a flattened tree gives each row: all rows step down a level at a time."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(DEPTH):
        c = column[at]
        at = np.where(c < 0, at, 2 * at + 1 + (x[rows, np.maximum(c, 0)] > threshold[at]))
    return value[at]


@dataclass
class Forest:
    """Trees as arrays, a row for each tree: node i's children are 2i+1 and 2i+2; column -1 marks a leaf."""

    column: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in zip(self.column, self.threshold, self.value):
            total += traverse(x, *tree)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting on the logistic loss. Each column is cut into at most BINS bins by its quantiles, and splits are chosen
    from the histograms of gradients. No labels, or one class only: a forest without trees that scores the smoothed share."""
    n, columns = x.shape if len(y) else (0, len(STATISTICS))
    mean = (y.sum() + 0.5) / (n + 1)
    base, nodes = float(np.log(mean / (1 - mean))), 2 ** (DEPTH + 1) - 1
    if n < 2 * LEAF or y.min() == y.max():
        empty = np.zeros((0, nodes))
        return Forest(empty.astype(np.int64), empty, empty, base)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(columns)]
    binned = np.stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in range(columns)], 1)
    offset = np.arange(columns) * BINS
    flat = (binned + offset).astype(np.int64)
    margin, trees = np.full(n, base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        column, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        members = {0: np.arange(n)}
        for node in range(nodes):
            at = members.pop(node, None)
            if at is None:
                continue
            total_g, total_h = g[at].sum(), h[at].sum()
            value[node] = RATE * total_g / (total_h + PENALTY)
            if node >= nodes // 2 or len(at) < 2 * LEAF:
                continue
            keys = flat[at].ravel()
            left_g, left_h, left_n = (np.cumsum(np.bincount(keys, weights=np.repeat(v, columns) if v is not None else None, minlength=columns * BINS).reshape(columns, BINS), axis=1) for v in (g[at], h[at], None))
            right_g, right_h, right_n = total_g - left_g, total_h - left_h, len(at) - left_n
            gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - total_g**2 / (total_h + PENALTY)
            gain[(left_n < LEAF) | (right_n < LEAF)] = -1
            c, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[c, b] <= 1e-6:
                continue
            column[node], threshold[node] = c, cuts[c][b]
            goes = binned[at, c] > b
            members[2 * node + 1], members[2 * node + 2] = at[~goes], at[goes]
        for into, tree in zip(trees, (column, threshold, value)):
            into.append(tree)
        margin += traverse(x, column, threshold, value)
    return Forest(*map(np.array, trees), base)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == fold


def sample_of_labels(labels: DataFrame, label: str, *, folds: int, fold: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0.0 or 1.0) of at most about `most` labelled ids outside the fold, by a hash of the id.

    Several labels of an id: their mean, rounded half up. Null ids and null labels are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    one = one.groupBy(F.col(id_col).alias("id")).agg(F.floor(F.avg(label) + 0.5).cast("double").alias("label"))
    share = most / max(1, one.count())
    return one if share >= 1 else one.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def sample_of_texts(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, fold: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of the sample's labelled documents: of rows that repeat an id the one whose text has the least hash."""
    sample = F.broadcast(sample_of_labels(labels, label, folds=folds, fold=fold, most=most))  # at most about `most` rows
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sample, "id")
    return chosen.groupBy("id").agg(F.any_value("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 3, fold: int = 1, most: int = MOST_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Grows the forest from the labelled documents outside the fold. Only the sample's statistics, a row for each id, come
    to the driver."""
    sample = F.broadcast(sample_of_labels(labels, label, folds=folds, fold=fold, most=most))  # at most about `most` rows
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sample, "id")
    chosen = chosen.select("id", "label", F.xxhash64("text").alias("hash"), _statistics("text").alias("x"))
    rows = chosen.groupBy("id").agg(F.any_value("label").alias("label"), F.min_by("x", F.struct("hash", "x")).alias("x")).orderBy("id").select("label", "x").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return grow(x, rows["label"].to_numpy(np.float64))


def score_of(forest: Forest, text: Column) -> Column:
    """The score of a whole text, as a column that the planner never evaluates twice for a row."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return score.asNondeterministic()(text)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, most: int = MOST_TRAINING) -> DataFrame:
    """(id_col, held_out, score, predicted), a row for each row; after the fit it is map-only.

    The score reads the text alone. Null, empty and blank texts share the score of all-zero statistics. Null ids are
    scored and never learned from; repeated rows each get their row. Empty tables: no rows; no labels: 0.5 for all."""
    forest = fit(docs, labels, folds=folds, fold=fold, most=most, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), score_of(forest, F.col(f"`{text_col}`")).alias("score"))
    return out.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
