"""Verification in two passes: sizes first, then hashes of the files that sizes leave open, and of no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.listing import hashed_paths
from ..sources.scratch import written
from .integrity import LOCAL_ERROR, NO_URL, reconcile_sizes, server_status, size_gate


def verify(files: DataFrame, remote: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """files(path, url, length) and remote(url, remote_size, server_sha256, error), a row for each url, to
    (path, url, size_status, local_sha256, server_sha256, indice_status, status, bytes_read).

    The first pass compares sizes and opens nothing. Files of another size end there (bytes_read null); those without a URL
    or a readable size keep that status; the rest, failed requests included, are read by path, so what the second pass reads
    follows the first pass's result. index(sha256, indice_status): what an index says of a hash. Rows that repeat a path each
    get their row, and the file is read once."""
    sized = written(reconcile_sizes(files.select("path", "url", F.col("length").alias("local_size")), remote.select("url", "remote_size", "error")), "sized")
    open_ = size_gate(sized).where(~F.col("status").isin(NO_URL, LOCAL_ERROR))
    read = hashed_paths(open_.select("path", F.col("local_size").alias("length"))).select("path", F.col("sha256").alias("local_sha256"), "bytes_read")
    if index is not None:
        known = index.select(F.col("sha256").alias("local_sha256"), "indice_status").groupBy("local_sha256").agg(F.min("indice_status").alias("indice_status"))
        read = read.join(known, "local_sha256", "left")
    else:
        read = read.withColumn("indice_status", F.lit(None).cast("string"))
    r = sized.select("path", "url", F.col("status").alias("size_status")).join(read, "path", "left").join(remote.select("url", "server_sha256", "error"), "url", "left")
    r = r.withColumn("indice_status", F.coalesce("indice_status", F.lit("SIN_INDICE")))
    second = server_status(F.col("url"), F.col("local_sha256"), F.col("server_sha256"), F.col("error"), F.col("indice_status"))
    return r.select("path", "url", "size_status", "local_sha256", "server_sha256", "indice_status", F.when(F.col("bytes_read").isNull(), F.col("size_status")).otherwise(second).alias("status"), "bytes_read")
