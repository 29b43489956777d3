"""Secret scan with corpus-wide ownership frequency.

Candidates are found in each text, and each is known by the hash of its value alone. Over the whole corpus a hash's
distinct repositories and owners are counted. One that many repositories or several owners hold is a copied example; one
that a single owner has, in few repositories, looks live; each span gets the class of its value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import join_hot, table, written

# Kinds in the order in which spans at one start are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "bearer", "url_password")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PRIVATE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
BEARER = re.compile(r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})")
URL_PASSWORD = re.compile(r"[a-z]://[^\s/@:?#]+:([^\s/@?#]{6,})@")

#: A value is a copied example if so many owners hold it, in so many repositories. Two owners may share a live one, and one
#: owner's, however often it is pasted, is that owner's.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 3
#: Bits a character; a value below this (repeated or plain words) does not look live.
LIVE_ENTROPY = 2.5
CLASSES = ("copied", "weak", "shared", "live")

Candidate = tuple[str, int, int, str]


def find(text: str | None) -> list[Candidate]:
    """(kind, start, end, value) in code points, by start, then kind as listed. Null: none."""
    text = text or ""
    found = [("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    begun = None  # the marker before, if it begins a key
    for m in PRIVATE.finditer(text):
        if m[1] == "END" and begun:
            found.append(("private_key", begun.start(), m.end(), text[begun.end() : m.start()].strip()))
        begun = m if m[1] == "BEGIN" else None
    found += [("bearer", *m.span(), m[1]) for m in BEARER.finditer(text)]
    found += [("url_password", *m.span(1), m[1]) for m in URL_PASSWORD.finditer(text)] if "://" in text else []
    return sorted(found, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    + [T.StructField("hashes", T.ArrayType(T.StringType())), T.StructField("entropies", T.ArrayType(T.DoubleType())), T.StructField("of", T.ArrayType(T.IntegerType()))]
)


@F.pandas_udf(FOUND)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for found in map(find, texts):
        spans = [f"{k}:{a}:{b}" for k, a, b, _ in found]
        base = ",".join(s for s, c in zip(spans, found) if c[0] in BASE)
        kinds = [c[0] for c in found]
        values = sorted({c[3] for c in found})
        hashes = [hashlib.sha256(v.encode("utf-8", "replace")).hexdigest() for v in values]
        at = {v: i for i, v in enumerate(values)}
        rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(base.encode()).hexdigest(), ",".join(spans), hashes, [entropy(v) for v in values], [at[c[3]] for c in found]))
    return pd.DataFrame(rows, columns=FOUND.names)


scan = _scan.asNondeterministic()  # for the planner only, which so never runs it twice for a row


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(hash, repository, owner) -> (hash, n_rows, n_repositories, n_owners), nulls counting as one of their own.

    Distinct (hash, repository) and (hash, owner) rows come first, with partial aggregation, so a hash that a third of all
    documents have is one row for each place and no group is gathered."""
    marked = candidates.groupBy("hash", F.struct("repository").alias("r"), F.struct("owner").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    repositories = marked.groupBy("hash", "r").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_repositories"))
    owners = marked.select("hash", "o").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repositories.join(owners, "hash")


def class_of(n_repositories: Column, n_owners: Column, entropy_: Column, repositories: int = COPIED_REPOSITORIES, owners: int = COPIED_OWNERS) -> Column:
    """copied: at least so many owners hold the value, in at least so many repositories; weak: it is of low entropy; shared:
    several owners hold it, too few for an example; live: a single owner does, in however many repositories."""
    copied = (n_repositories >= repositories) & (n_owners >= owners)
    return F.when(copied, "copied").when(entropy_ < LIVE_ENTROPY, "weak").when(n_owners > 1, "shared").otherwise("live")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", copied_repositories: int = COPIED_REPOSITORIES, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, classes, n_copied, n_weak, n_shared, n_live, most_owners,
    most_repositories), a row for each row.

    classes: the class (class_of) of each span, in the order of `spans`, comma-joined; n_copied and the like: the row's
    distinct values of each class; most_owners, most_repositories: of its most widely held value (0: it has none).
    Documents tell nothing of repositories here, so a document stands for one and its source for the owner; both columns
    are parameters. Null and empty texts have no candidates. A null repository or owner counts as one of its own. Repeated
    rows each get their row. Values themselves never leave the tasks that found them, only hashes."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{repository_col}`").cast("string").alias("repository"), F.col(f"`{owner_col}`").cast("string").alias("owner"), scan(F.col(f"`{text_col}`")).alias("r"))
    rows, _ = written(rows.select("id", "repository", "owner", "r.*").withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = rows.where(F.size("hashes") > 0).select("row", "repository", "owner", F.posexplode(F.arrays_zip("hashes", "entropies")).alias("at", "c"))
    each = each.select("row", "repository", "owner", "at", F.col("c.hashes").alias("hash"), F.col("c.entropies").alias("entropy"))
    owned, _ = written(ownership(each), "ownership")
    total = owned.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    held = join_hot(each.select("row", "at", "hash", "entropy"), owned, "hash", "n_rows", total)
    held = held.withColumn("class", class_of(F.col("n_repositories"), F.col("n_owners"), F.col("entropy"), copied_repositories, copied_owners))
    counts = [F.count_if(F.col("class") == k).alias(f"n_{k}") for k in CLASSES]
    by_row = held.groupBy("row").agg(*counts, F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"), F.array_sort(F.collect_list(F.struct("at", "class"))).alias("by_value"))
    out = rows.select("row", "id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "of").join(by_row, "row", "left")
    classes = F.coalesce(F.array_join(F.transform("of", lambda i: F.get("by_value", i)["class"]), ","), F.lit(""))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in CLASSES), "most_owners", "most_repositories")]
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in BASE], "base_sha256", "spans", classes.alias("classes"), *zero)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
