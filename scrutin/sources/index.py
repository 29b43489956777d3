"""The hash index: one JSON document whose keys are data, as narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonparts import members
from .listing import in_tasks
from .scratch import written

# Notes of the two hashes of the older shape.
OLD_NOTES = (("local_sha256", "version original"), ("server_sha256", "version servidor post-modificacion"))


def by_hash(doc: DataFrame) -> DataFrame:
    """doc(value: the JSON text) -> (sha256, filename)."""
    return doc.select(F.explode(F.from_json(F.get_json_object("value", "$.by_hash"), "map<string,string>")).alias("sha256", "filename"))


def by_filename(doc: DataFrame) -> DataFrame:
    """(filename, sha256, vuelta). An entry is a hash, or an object with one; a malformed object has a null hash and
    malformed = true. Empty entries count as absent."""
    return named_entries(doc.select(F.explode(F.from_json(F.get_json_object("value", "$.by_filename"), "map<string,string>")).alias("filename", "entry")))


def named_entries(e: DataFrame) -> DataFrame:
    e = e.where("entry is not null and entry not in ('', '{}', 'null')")
    obj = F.col("entry").startswith("{")
    sha = F.when(obj, F.get_json_object("entry", "$.sha256")).otherwise(F.col("entry"))
    return e.select("filename", sha.alias("sha256"), F.when(obj, F.get_json_object("entry", "$.vuelta")).alias("vuelta"), (obj & sha.isNull()).alias("malformed"))


_VERSIONS = "struct<versions:array<struct<sha256:string,note:string>>,local_sha256:string,server_sha256:string>"


def known_versions(doc: DataFrame) -> DataFrame:
    """(filename, versions array<struct<sha256, note>>), the older shape adapted."""
    return adapted_entries(doc.select(F.explode(F.from_json(F.get_json_object("value", "$.known_dif"), f"map<string,{_VERSIONS}>")).alias("filename", "e")))


def adapted_entries(e: DataFrame) -> DataFrame:
    return e.select("filename", adapted(F.col("e.versions"), F.col("e.local_sha256"), F.col("e.server_sha256")).alias("versions"))


def adapted(versions, local, server):
    """versions, or where there are none those of the older shape's two hashes that are not empty."""
    old = F.array(*[F.struct(c.alias("sha256"), F.lit(note).alias("note")) for c, (_, note) in zip((local, server), OLD_NOTES)])
    return F.when(F.coalesce(F.size(versions), F.lit(0)) > 0, versions).otherwise(F.filter(old, lambda v: F.coalesce(v["sha256"], F.lit("")) != ""))


def locations(doc: DataFrame) -> DataFrame:
    """(filename, dept, mpio, zona, puesto); values without exactly four parts are left out."""
    return placed_entries(doc.select(F.explode(F.from_json(F.get_json_object("value", "$.by_location"), "map<string,string>")).alias("filename", "place")))


def placed_entries(e: DataFrame) -> DataFrame:
    p = F.split("place", "/")
    return e.where(F.size(p) == 4).select("filename", *[p[i].alias(k) for i, k in enumerate(("dept", "mpio", "zona", "puesto"))])


_META = ("version", "generated_at", "entries_count", "known_dif_count", "coverage_note")


def meta(doc: DataFrame) -> DataFrame:
    return doc.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in _META])


def urls(doc: DataFrame) -> DataFrame:
    """A URL index: file name -> URL, without its _meta entry."""
    return doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "url")).where("filename <> '_meta'")


def large_urls(spark: SparkSession, path: str) -> DataFrame:
    """The same of a document of any size, read by many tasks."""
    return members(spark, path, 1).where("key <> '_meta'").select(F.col("key").alias("filename"), F.col("value").alias("url"))


def large_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of an index document of any size, read by byte ranges: the rows of the functions above, but a key that
    is repeated within a section has each of its rows."""
    m = written(members(spark, path), "members")
    of = lambda section, key, value: m.where(F.col("section") == section).select(F.col("key").alias(key), value)
    value = F.col("value")
    return {
        "ix_hash": of("by_hash", "sha256", value.alias("filename")),
        "ix_file": named_entries(of("by_filename", "filename", value.alias("entry"))),
        "ix_dif": adapted_entries(of("known_dif", "filename", F.from_json(value, _VERSIONS).alias("e"))),
        "ix_loc": placed_entries(of("by_location", "filename", value.alias("place"))),
        "ix_meta": m.where("section is null").agg(*[F.max(F.when(F.col("key") == k, value)).alias(k) for k in _META]),
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def normalize(spark: SparkSession, path: str, into: str) -> None:
    """Writes the five narrow tables as Parquet, once. A document that only Spark can open is read as one row."""
    if in_tasks(path):
        tables = large_tables(spark, path)
    else:
        doc = read(spark, path)
        tables = {name: make(doc) for name, make in (("ix_hash", by_hash), ("ix_file", by_filename), ("ix_dif", known_versions), ("ix_loc", locations), ("ix_meta", meta))}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{into}/{name}")
