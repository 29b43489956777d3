"""Files against the hash index and against a server's manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, parent, stem

# Statuses and the texts of notes.
VERIFIED, ALTERED, UNKNOWN = "VERIFICADA", "ALTERADA", "DESCONOCIDA"
SAME_SIZE, OTHER_SIZE, NO_SIZE = "IGUAL_TAMANIO", "DIFERENTE_TAMANIO", "TAMANIO_NO_DISPONIBLE"
NO_URL, LOCAL_ERROR, FETCH_ERROR = "URL_NO_CONSTRUIBLE", "ERROR_LOCAL", "ERROR_DESCARGA"
SAME, DIFFERENT, TAMPERED = "IGUAL_SERVIDOR", "DIFERENTE_SERVIDOR", "MANIPULADA_EN_SERVIDOR"
NOTE_VERSION = "version conocida en known_dif: %s"
NOTE_NO_VERSION = "archivo en known_dif pero hash no coincide con ninguna de las %d versiones conocidas"
NOTE_ROUND = "vuelta: %s"
NOTE_READ = "error al leer archivo: sha256"


def classify(files: DataFrame, ix_hash: DataFrame, ix_file: DataFrame, ix_dif: DataFrame) -> DataFrame:
    """files(filename, sha256, ...) -> the same with status, expected_sha256, note.

    Rules in order: the hash is known under any name; the name is known with another hash; the name has documented
    versions and this is one of them, or none; otherwise unknown. The index tables are unique by their keys, so no join
    multiplies rows, and the two joins by name share one shuffle where they are not broadcast."""
    owner = ix_file.select(F.col("filename").alias("owner"), F.col("vuelta").alias("owner_round"))
    by_hash = ix_hash.select(F.col("sha256"), F.col("filename").alias("owner")).join(owner, "owner", "left").withColumn("hit", F.lit(True))
    malformed = F.col("malformed") if "malformed" in ix_file.columns else F.lit(False)
    by_name = ix_file.select("filename", F.col("sha256").alias("index_sha"), F.col("vuelta").alias("index_round"), malformed.alias("malformed"), F.lit(True).alias("named"))
    r = files.join(by_hash, "sha256", "left").join(by_name, "filename", "left").join(ix_dif, "filename", "left")
    same = F.get(F.filter("versions", lambda v: v["sha256"] == F.col("sha256")), F.lit(0))
    rule = (
        F.when(F.col("hit"), 1)
        .when(F.coalesce("malformed", F.lit(False)), 5)
        .when(F.col("named") & (F.col("index_sha") != F.col("sha256")), 2)
        .when(F.col("versions").isNotNull() & same.isNotNull(), 3)
        .when(F.col("versions").isNotNull(), 4)
        .otherwise(6)
    )
    r = r.withColumn("rule", rule)
    at = F.col("rule")
    note_round = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(NOTE_ROUND, c)).otherwise("")
    return r.select(
        *[F.when(at == 5, "").otherwise(F.col(c)).alias(c) if c == "sha256" else c for c in files.columns],
        F.when(at.isin(1, 3), VERIFIED).when(at == 2, ALTERED).otherwise(UNKNOWN).alias("status"),
        F.when(at == 1, F.col("sha256")).when(at == 2, F.col("index_sha")).otherwise("").alias("expected_sha256"),
        F.when(at == 1, note_round(F.col("owner_round")))
        .when(at == 2, note_round(F.col("index_round")))
        .when(at == 3, F.format_string(NOTE_VERSION, F.coalesce(same["note"], F.lit(""))))
        .when(at == 4, F.format_string(NOTE_NO_VERSION, F.size("versions")))
        .when(at == 5, NOTE_READ)
        .otherwise("")
        .alias("note"),
    )


def classify_summary(verdicts: DataFrame) -> DataFrame:
    """One row of counts; VERIFICADA is split by whether there is a note, a round's note too."""
    s, noted = F.col("status"), F.col("note") != ""
    counts = {"total": F.count(F.lit(1)), "verified_plain": F.count_if((s == VERIFIED) & ~noted), "verified_noted": F.count_if((s == VERIFIED) & noted), "altered": F.count_if(s == ALTERED), "unknown": F.count_if(s == UNKNOWN)}
    return verdicts.agg(*[c.alias(k) for k, c in counts.items()])


def path_place(path: Column) -> Column:
    """struct(dept, mpio, zona, puesto, tail) of a path, or null: the first two from the name, the others from folders."""
    name = F.split(stem(file_name(path)), "_", 6)
    zone, post = parent(path, 2), parent(path, 1)
    ok = (F.size(name) > 5) & (F.get(name, F.lit(4)) == "E14") & zone.startswith("zona_") & post.startswith("puesto_") & (F.char_length(zone) > 5) & (F.char_length(post) > 7)
    tail = F.concat(F.concat_ws("_", F.slice(name, 5, 2)), F.lit(".pdf"))
    return F.when(ok, F.struct(F.get(name, F.lit(0)).alias("dept"), F.get(name, F.lit(1)).alias("mpio"), F.substr(zone, F.lit(6)).alias("zona"), F.substr(post, F.lit(8)).alias("puesto"), tail.alias("tail")))


def locate(files: DataFrame, ix_loc: DataFrame, base: str) -> DataFrame:
    """files(path, ...) plus dept, mpio, zona, puesto and url: from the path, else from the bridge by file name, else
    null. The bridge gives a URL to any name with the fifth part that paths need."""
    bridge = ix_loc.select(F.col("filename").alias("bridged"), *[F.col(k).alias(f"b_{k}") for k in ("dept", "mpio", "zona", "puesto")])
    r = files.withColumn("place", path_place(F.col("path"))).withColumn("bridged", file_name(F.col("path"))).join(bridge, "bridged", "left")
    name = F.split(stem(F.col("bridged")), "_", 6)
    tail = F.when((F.size(name) > 5) & (F.get(name, F.lit(4)) == "E14"), F.concat(F.concat_ws("_", F.slice(name, 5, 2)), F.lit(".pdf")))
    found = F.coalesce("place", F.when(F.col("b_dept").isNotNull() & tail.isNotNull(), F.struct(*[F.col(f"b_{k}").alias(k) for k in ("dept", "mpio", "zona", "puesto")], tail.alias("tail"))))
    parts = [found[k].alias(k) for k in ("dept", "mpio", "zona", "puesto")]
    return r.select(*files.columns, *parts, F.when(found.isNotNull(), F.concat_ws("/", F.lit(base), F.lit("docs/E14"), *[found[k] for k in ("dept", "mpio", "zona", "puesto", "tail")])).alias("url"))


def size_status(local: Column, remote: Column, error: Column, url: Column) -> Column:
    """A remote size of -1 is a failed request, 0 without an error an absent header."""
    return (
        F.when(url.isNull(), NO_URL)
        .when(local.isNull(), LOCAL_ERROR)
        .when(remote.isNull() | (remote == -1) | (F.coalesce(error, F.lit("")) != ""), FETCH_ERROR)
        .when(remote == 0, NO_SIZE)
        .when(local == remote, SAME_SIZE)
        .otherwise(OTHER_SIZE)
    )


def reconcile_sizes(files: DataFrame, remote: DataFrame) -> DataFrame:
    """files(path, url, local_size) with remote(url, remote_size, error) -> status, note, variation in percent."""
    r = files.join(remote, "url", "left").withColumn("status", size_status(F.col("local_size"), F.col("remote_size"), F.col("error"), F.col("url")))
    note = F.when(F.col("status") == OTHER_SIZE, F.format_string("local=%d remote=%d", "local_size", "remote_size")).otherwise(F.coalesce("error", F.lit("")))
    change = F.when(F.col("status").isin(SAME_SIZE, OTHER_SIZE), F.round(F.try_divide((F.col("remote_size") - F.col("local_size")) * F.lit(100.0), F.col("local_size")), 6))
    return r.withColumns({"note": note, "variation_pct": change})


def size_gate(sized: DataFrame) -> DataFrame:
    """What the second pass hashes: all but different sizes, so failed requests are tried again."""
    return sized.where(F.col("status") != OTHER_SIZE)


def gate_counts(sized: DataFrame) -> DataFrame:
    """One row: files seen by the first pass, passed on to the second, and discarded by their size alone."""
    other = F.col("status") == OTHER_SIZE
    return sized.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~other).alias("passed"), F.count_if(other).alias("discarded"))


def server_status(url: Column, local: Column, remote: Column, error: Column, index_status: Column) -> Column:
    return (
        F.when(url.isNull(), NO_URL)
        .when(local.isNull(), LOCAL_ERROR)
        .when(remote.isNull() | (F.coalesce(error, F.lit("")) != ""), FETCH_ERROR)
        .when(local == remote, SAME)
        .when(index_status == VERIFIED, TAMPERED)
        .otherwise(DIFFERENT)
    )


def reconcile_server(verdicts: DataFrame, remote: DataFrame) -> DataFrame:
    """verdicts(url, local_sha256, indice_status, ...) with remote(url, server_sha256, error) -> status."""
    r = verdicts.join(remote, "url", "left")
    return r.withColumn("status", server_status(F.col("url"), F.col("local_sha256"), F.col("server_sha256"), F.col("error"), F.coalesce("indice_status", F.lit("SIN_INDICE"))))


def recheck(divergent: DataFrame, now: DataFrame, key: str, was: str, is_: str) -> DataFrame:
    """Divergent files against a later look: unreachable, still different, or equal again."""
    r = divergent.join(now, key, "left")
    return r.withColumn("seguimiento", F.when(F.col(is_).isNull(), "INACCESIBLE").when(F.col(was) == F.col(is_), "ahora igual").otherwise("sigue diferente"))


def evidence(files: DataFrame) -> DataFrame:
    """Server copies that differ, kept as binary rows under the name that the evidence folder would use."""
    return files.select(F.concat(stem(F.col("filename")), F.lit("_SERVER.pdf")).alias("evidence_name"), "content")
