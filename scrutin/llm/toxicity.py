"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its telling words (0 without one); the document's is
their noisy-or, 1 - prod(1 - s), so that one offending sentence is enough. Only documents are labelled; the weights are fitted through
the noisy-or, and the fitted sentence scores then locate the offending sentences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import held_out, sample_of_texts
from .shared import drop, table, written

#: The fit reads at most about this many labelled documents, chosen by a hash of their id.
MOST_TRAINING = 6_000
#: A word is learned if at least so many sampled documents hold it, and it tells more than chance does, less SLACK.
LEAST_DOCUMENTS = 3
SLACK = 4.0
STEPS, PENALTY = 200, 0.02
OFFENDING = 0.5

SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
WORD = re.compile(r"\w+")
#: A longer word also counts by its beginning of so many letters, which inflected forms share.
STEM = 4
#: Words of which a worker remembers what they tell.
MOST_WORDS = 200_000


def features_of(word: str) -> tuple[str, ...]:
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


def words_of(sentence: str) -> set[str]:
    """A sentence's distinct words and their beginnings."""
    return {f for w in set(WORD.findall(sentence.lower())) for f in features_of(w)}


@dataclass
class Model:
    weight: dict[str, float]
    bias: float
    told: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)  # of words met before

    def _tells(self, word: str) -> tuple[str, ...]:
        found = self.told.get(word)
        if found is None:
            if len(self.told) >= MOST_WORDS:
                self.told.clear()
            found = self.told[word] = tuple(f for f in features_of(word) if f in self.weight)
        return found

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence in code points; those of equal words have equal scores."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            told = {f for w in WORD.findall(m[0].lower()) for f in self._tells(w)}
            score = 1 / (1 + math.exp(-min(40.0, max(-40.0, self.bias + math.fsum(self.weight[f] for f in told))))) if told else 0.0
            out.append((m.start(), m.end(), score))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's noisy-or (no sentence: 0) and its offending sentences, by start."""
        scored = [s for s in self.sentence_scores(text) if s[2]]
        clean = math.fsum(math.log1p(-min(s, 1 - 1e-12)) for _, _, s in scored)
        return max(0.0, -math.expm1(clean)), [s for s in scored if s[2] >= OFFENDING]


def bag_of(text: str | None) -> Iterator[set[str]]:
    return (words_of(m[0]) for m in SENTENCE.finditer(text or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set().union(*bag_of(t))) for t in texts], dtype=object)


def telling_words(sample: DataFrame) -> list[str]:
    """sample(id, label, text), a row for each id -> words that toxic documents hold oftener than chance explains, sorted.

    The log-likelihood ratio of the word against the label has to exceed what the best of all the words would reach by
    chance, less SLACK. A noisy-or has no use for words that speak against an offence, and thousands of rare words would
    only let it memorise. Words are counted in Spark; only telling ones come to the driver."""
    n, positive = (float(x) for x in sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first())
    counted = sample.select("label", F.explode(_words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("k"))
    counted, path = written(counted.where(F.col("c") >= LEAST_DOCUMENTS), "words")
    least = 2 * math.log(max(2, counted.count())) - SLACK
    c, k = F.col("c").cast("double"), F.col("k")
    cells = ((k, c * positive / n), (c - k, c * (n - positive) / n), (positive - k, (n - c) * positive / n), (n - positive - c + k, (n - c) * (n - positive) / n)) if n else ()
    ratio = sum((F.when(a > 0, a * F.log(a / b)).otherwise(0.0) for a, b in cells), F.lit(0.0)) * 2
    out = sorted(r["word"] for r in counted.where((k * n > c * positive) & (ratio >= least)).select("word").collect())
    drop(sample.sparkSession, path)
    return out


def bags(sample: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels by id; for each telling word of each sentence its number and the sentence's; the document of each sentence.

    Sentences are read in the tasks; what reaches the driver is numbers of telling words."""
    sent = sample.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def told(texts: pd.Series) -> pd.Series:
        get = sent.value.get
        return pd.Series([[own for s in bag_of(t) if (own := sorted(i for w in s if (i := get(w)) is not None))] for t in texts], dtype=object)

    rows = sample.select("id", "label", told("text").alias("told")).orderBy("id").select("label", "told").collect()
    ids = [i for r in rows for own in r["told"] for i in own]
    lengths = [len(own) for r in rows for own in r["told"]]
    doc_at = np.repeat(np.arange(len(rows)), [len(r["told"]) for r in rows])
    return np.array([r["label"] for r in rows], np.float64), np.array(ids, np.int32), np.repeat(np.arange(len(lengths)), lengths), doc_at


def loss_and_gradient(theta: np.ndarray, labels: np.ndarray, ids: np.ndarray, sentence_at: np.ndarray, doc_at: np.ndarray) -> tuple[float, np.ndarray]:
    """The balanced cross-entropy of the documents' noisy-or with an L2 penalty on the words' weights (theta's last is the
    bias), and its gradient."""
    n, sentences, weights = len(labels), len(doc_at), theta[:-1]
    share = np.clip(labels.mean(), 0.01, 0.99)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    z = theta[-1] + np.bincount(sentence_at, weights=theta[ids], minlength=sentences)
    s = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
    clean = np.bincount(doc_at, weights=np.log1p(-s), minlength=n)  # log of the chance that no sentence offends
    p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    loss = -(balance * np.where(labels == 1, np.log(p), np.where(p < 1 - 1e-9, clean, np.log1p(-p)))).sum() / n + PENALTY * (weights**2).sum() / 2 / n
    # d loss / d clean: toxic (1 - p) / p, others -1; d clean / d z = -s.
    up = balance * np.where(labels == 1, (1 - p) / p, -1.0) / n
    dz = -up[doc_at] * s
    grad = np.append(np.bincount(ids, weights=dz[sentence_at], minlength=len(weights)), dz.sum())
    grad[:-1] += PENALTY * weights / n
    return float(loss), grad


def train(words: list[str], labels: np.ndarray, ids: np.ndarray, sentence_at: np.ndarray, doc_at: np.ndarray) -> Model:
    """Full-batch Adam. No labels, one class only or no telling words: no weights, every score is 0."""
    if not len(labels) or labels.min() == labels.max() or not words:
        return Model({}, 0.0)
    theta = np.zeros(len(words) + 1)
    theta[-1] = -1.0
    m, v, rate = np.zeros_like(theta), np.zeros_like(theta), 0.15
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(theta, labels, ids, sentence_at, doc_at)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        rate *= 0.99
    return Model({w: float(x) for w, x in zip(words, theta[:-1]) if abs(x) > 1e-3}, float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, fold: int = 0, most: int = MOST_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the sample of labelled documents outside the fold, one text for each id; texts stay in the tasks."""
    sample, path = written(sample_of_texts(docs, labels, label, folds=folds, fold=fold, most=most, id_col=id_col, text_col=text_col), "sample")
    words = telling_words(sample)
    model = train(words, *bags(sample, {w: i for i, w in enumerate(words)}))
    drop(docs.sparkSession, path)
    return model


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.StringType())])


def score_of(model: Model, text: Column) -> Column:
    """struct(score, offending): offending sentences as start:end:score, comma-joined."""

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            p, bad = model.score(t)
            rows.append((p, ",".join(f"{a}:{b}:{s:.4f}" for a, b, s in bad)))
        return pd.DataFrame(rows, columns=SCORED.names)

    return score.asNondeterministic()(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0, most: int = MOST_TRAINING) -> DataFrame:
    """(id_col, held_out, score, predicted, offending), a row for each row; after the fit it is map-only.

    The score reads the text alone. A null or empty text has no sentence: score 0. Null ids are scored and never learned
    from; repeated rows each get their row. Without labels of both classes nothing is learned and every score is 0."""
    model = fit(docs, labels, folds=folds, fold=fold, most=most, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), score_of(model, F.col(f"`{text_col}`")).alias("r"))
    out = out.select(id_col, F.col("r.score").alias("score"), F.col("r.offending").alias("offending"))
    return out.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
