"""A training corpus from documents: STAGES in order, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrutin.llm import mixing, packing, pii, quality, simhash
from scrutin.llm.shared import drop, intermediates, table, written


def whole(docs: DataFrame) -> F.Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Documents that the classifier, fitted on this stage's labelled documents, scores under 0.5 go.

    Null, empty and blank texts share a score and so stay or go together; a null id is scored and never learned from;
    repeated rows share their text's lot; no labels: all score 0.5 and stay; an empty table stays empty. Columns are carried
    as one struct, so none can clash."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(whole(docs), quality.score_of(forest, F.col("text")).alias("score"))
    return scored.where("score >= 0.5").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. One row of each component stays: that of the smallest id (null: last), then of the smallest fingerprint,
    then the smallest hash of the row. Ids may be repeated or null; rows that share one are copies only if their texts are."""
    rows = docs.select(whole(docs), simhash.fingerprints("text").alias("fp"))
    rows, _ = written(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    found = simhash.components(rows.select("fp").distinct())
    ranked = rows.select("at", "fp", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), "fp", F.xxhash64("row"), "at").alias("rank"))
    least = ranked.groupBy("fp").agg(F.min("rank").alias("rank"))
    kept = least.join(found, "fp").groupBy("component").agg(F.min("rank").alias("rank")).select("rank.at")
    return rows.join(kept, "at", "left_semi").select("row.*").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Personal data becomes [KIND]; n_chars follows the new text.

    A null text stays null with its n_chars, an empty one empty; a text without personal data is left as it is, very long ones
    included; repeated rows each stay; an empty table stays empty. Columns are carried as one struct, so none can clash."""
    marked = docs.select(whole(docs), pii.redact(F.col("text")).alias("clean"))
    changed = F.when(F.col("clean").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.char_length("clean"))
    put = {"text": F.col("clean"), "n_chars": changed.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return marked.select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Each document as often as its source's rate says, rows repeated.

    Null and empty texts are of size 0 and copied at their source's rate; a null source is one of its own; a null id is drawn
    as the text "null"; repeated rows draw alike; sources without words go; an empty table stays empty. Columns are carried
    as one struct, so none can clash."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. The pieces of all sequences.

    Null and empty texts are the end id alone; a null id and rows that repeat one are documents of their own, as the mix
    repeats rows; very long texts fill windows; an empty table has no pieces. Only doc_id and text are read."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_near_copies), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

#: Trees, fingerprints and tokenizers are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what a stage wrote besides, and the result before, are removed."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with intermediates(spark) as made:
            docs, path = written(stage(spark, docs, sf_dir), name)
            made.remove(path)
        drop(spark, *before)
        before = [path]
    return docs
