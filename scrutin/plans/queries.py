"""Each operator of the audit engine applied to the driver's tables, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import streaming
from ..functions.text import csv_line, file_name, form_encoded, newer_version, path_parts, stem, url_parts
from ..operators import acta, history, ids, integrity, limiter, quantiles, scan, state, summaries, tables, tls, two_pass
from ..sources import config, files, jsonparts, listing, scratch
from ..sources import ids as id_source
from ..sources import index as index_source
from . import sinks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


# --- files against the index ---------------------------------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("filename"), "text")
    kind = F.col("doc_id") % 10
    files = d.select("doc_id", "filename", sha(F.col("text")).alias("sha256"))
    ix_hash = d.where(kind <= 5).groupBy(sha(F.col("text")).alias("sha256")).agg(F.min_by("filename", "doc_id").alias("filename"))
    wrong = sha(F.concat("text", F.lit("x")))
    ix_file = d.where(kind.isin(0, 1, 2, 3, 5, 6, 9)).select("filename", F.when(kind == 6, wrong).when(kind != 9, sha(F.col("text"))).alias("sha256"), F.when(kind == 1, "1").when(kind == 5, "2").alias("vuelta"), (kind == 9).alias("malformed"))
    old = [F.when(kind == 8, sha(F.concat("text", F.lit(x)))) for x in "ls"]
    new = F.when(kind == 7, F.array(F.struct(sha(F.col("text")).alias("sha256"), F.lit("n7").alias("note"))))
    ix_dif = d.where(kind.isin(7, 8)).select("filename", index_source.adapted(new, *old).alias("versions"))
    return integrity.classify(files, ix_hash, ix_file, ix_dif)


_CLASSIFIED = """
d AS (SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, sha256(text) AS sha, text, doc_id % 10 AS kind FROM documents),
ix_hash AS (SELECT sha, arg_min(filename, doc_id) AS owner, min(doc_id) AS owner_id FROM d WHERE kind <= 5 GROUP BY sha),
ver AS (
  SELECT d.doc_id, d.filename,
    CASE WHEN h.sha IS NOT NULL THEN 1 WHEN kind = 9 THEN 5 WHEN kind = 6 THEN 2 WHEN kind = 7 THEN 3 WHEN kind = 8 THEN 4 ELSE 6 END AS rule,
    d.sha, h.owner_id, sha256(d.text || 'x') AS wrong
  FROM d LEFT JOIN ix_hash h ON d.sha = h.sha
),
verdicts AS (
  SELECT doc_id, filename, CASE WHEN rule = 5 THEN '' ELSE sha END AS sha256,
    CASE rule WHEN 1 THEN 'VERIFICADA' WHEN 3 THEN 'VERIFICADA' WHEN 2 THEN 'ALTERADA' ELSE 'DESCONOCIDA' END AS status,
    CASE rule WHEN 1 THEN sha WHEN 2 THEN wrong ELSE '' END AS expected_sha256,
    CASE WHEN rule = 1 AND owner_id % 10 = 1 THEN 'vuelta: 1' WHEN rule = 1 AND owner_id % 10 = 5 THEN 'vuelta: 2'
         WHEN rule = 3 THEN 'version conocida en known_dif: n7'
         WHEN rule = 4 THEN 'archivo en known_dif pero hash no coincide con ninguna de las 2 versiones conocidas'
         WHEN rule = 5 THEN 'error al leer archivo: sha256' ELSE '' END AS note
  FROM ver
)"""


@query(f"WITH {_CLASSIFIED} SELECT * FROM verdicts")
def hash_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"""WITH {_CLASSIFIED} SELECT count(*) AS total, count(*) FILTER (status = 'VERIFICADA' AND note = '') AS verified_plain,
count(*) FILTER (status = 'VERIFICADA' AND note <> '') AS verified_noted, count(*) FILTER (status = 'ALTERADA') AS altered,
count(*) FILTER (status = 'DESCONOCIDA') AS unknown FROM verdicts""")
def hash_classify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.classify_summary(_classified(spark, sf_dir))


@query("""SELECT n_name AS filename, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE 'sha' || n_nationkey END AS sha256,
CASE WHEN n_nationkey % 3 = 1 THEN '2' END AS vuelta, n_nationkey % 3 = 2 AS malformed FROM nation""")
def index_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    key = F.concat(F.lit('"'), "n_name", F.lit('":'))
    entry = F.when(k % 3 == 0, F.format_string('"sha%d"', k)).when(k % 3 == 1, F.format_string('{"sha256":"sha%d","vuelta":"2"}', k)).otherwise('{"vuelta":"9"}')
    doc = n.agg(F.concat(F.lit('{"by_filename":{'), F.array_join(F.collect_list(F.concat(key, entry)), ","), F.lit("}}")).alias("value"))
    e = index_source.by_filename(doc)
    return e.withColumn("vuelta", F.when(~F.col("malformed"), F.col("vuelta")))


@query(r"""SELECT 'by_hash' AS section, sha256(text) AS key, 'd"\é' || doc_id || '.pdf' AS value FROM documents UNION ALL
SELECT 'by_filename', 'd"\é' || doc_id || '.pdf', CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN '{"sha256": "' || sha256(text) || '", "vuelta": ["{", 2]}' END FROM documents UNION ALL SELECT NULL, 'version', 't,"}{' UNION ALL SELECT NULL, 'parts', '["a", {"b": 1}]'""")
def index_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index document over a folder of files, read by byte ranges."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", sha(F.col("text")).alias("sha"), F.concat(F.lit(r'"d\"\\\u00e9'), k.cast("string"), F.lit('.pdf"')).alias("name"))
    entry = F.when(k % 3 == 0, F.concat(F.lit('"'), "sha", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('{"sha256": "'), "sha", F.lit('", "vuelta": ["{", 2]}'))).otherwise("null")
    lines = d.select(F.lit(0).alias("part"), "doc_id", F.concat(F.lit(' "'), "sha", F.lit('" : '), "name", F.lit(",")).alias("value"))
    lines = lines.unionByName(d.select(F.lit(1).alias("part"), "doc_id", F.concat("name", F.lit(":"), entry, F.lit(",")).alias("value")))
    frame = [(0, '{"version": "t,\\"}{", "parts": ["a", {"b": 1}], "by_hash" : {'), (1, '"-": null}, "by_filename":{'), (2, '"-": null} }')]
    lines = lines.unionByName(spark.createDataFrame([(part, None, text) for part, text in frame], "part int, doc_id long, value string"))
    folder = scratch.scratch_folder(spark)
    lines.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").select("value").write.text(folder)
    return jsonparts.members(spark, folder).where("key <> '-'")


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS filename, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem,
strlen(html) AS length, sha256(html) AS sha256 FROM pages""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").withColumn("filename", file_name(F.col("url")))
    return p.select("page_id", "filename", stem(F.col("filename")).alias("stem"), F.octet_length("html").cast("long").alias("length"), sha(F.col("html")).alias("sha256"))


_DEPARTMENTS = ", ".join(f"('{code}', '{name}')" for code, name in state.DEPARTMENTS.items())


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0").alias("code"))


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pages as files, a tenth of them empty."""
    k = F.col("page_id")
    folder = scratch.scratch_folder(spark)
    pages = read(spark, sf_dir, "pages").select(F.format_string("%d/p%d.PDF", k % 3, k).alias("name"), F.when(k % 10 == 0, "").otherwise(F.col("html")).alias("text"))
    sinks.write_named(pages, folder)
    return folder


@query("""SELECT 'p' || page_id || '.PDF' AS filename, CASE WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) END AS length, CASE WHEN page_id % 10 = 0 THEN sha256('') ELSE sha256(html) END AS sha256 FROM pages""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, which are then listed and hashed by tasks, empty ones included."""
    return files.hashed_folder(spark, _page_files(spark, sf_dir)).select("filename", "length", "sha256")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE html END AS html FROM pages),
r AS (SELECT page_id, html, sha256(html) AS own, CASE WHEN page_id % 11 <> 0 THEN 'u' || page_id END AS url,
  CASE WHEN page_id % 7 = 0 THEN -1 WHEN page_id % 5 = 1 THEN 0 WHEN page_id % 4 = 1 THEN strlen(html) + 1 ELSE strlen(html) END AS remote_size,
  CASE WHEN page_id % 3 = 0 THEN sha256(html || 'x') ELSE sha256(html) END AS remote_sha FROM p),
z AS (SELECT *, CASE WHEN url IS NULL THEN 'URL_NO_CONSTRUIBLE' WHEN remote_size = -1 THEN 'ERROR_DESCARGA' WHEN remote_size = 0 THEN 'TAMANIO_NO_DISPONIBLE' WHEN remote_size = strlen(html) THEN 'IGUAL_TAMANIO' ELSE 'DIFERENTE_TAMANIO' END AS size_status FROM r),
h AS (SELECT *, size_status IN ('ERROR_DESCARGA', 'TAMANIO_NO_DISPONIBLE', 'IGUAL_TAMANIO') AS second FROM z)
SELECT 'p' || page_id || '.PDF' AS filename, url, size_status, CASE WHEN second THEN own END AS local_sha256,
CASE WHEN NOT second THEN size_status WHEN own = remote_sha THEN 'IGUAL_SERVIDOR' WHEN page_id % 2 = 0 AND html <> '' THEN 'MANIPULADA_EN_SERVIDOR' ELSE 'DIFERENTE_SERVIDOR' END AS status,
CASE WHEN second THEN strlen(html) END AS bytes_read FROM h""")
def two_pass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by size, then by hash: only those that sizes leave open are opened."""
    k = F.col("page_id")
    html = F.when(k % 10 == 0, "").otherwise(F.col("html"))
    size = F.octet_length(html).cast("long")
    pages = read(spark, sf_dir, "pages")
    url = F.concat(F.lit("u"), k)
    listed = listing.list_files(spark, _page_files(spark, sf_dir)).withColumn("k", F.regexp_extract("filename", "[0-9]+", 0).cast("long"))
    listed = listed.withColumn("url", F.when(F.col("k") % 11 != 0, F.concat(F.lit("u"), "k")))
    remote = pages.select(url.alias("url"), F.when(k % 7 == 0, -1).when(k % 5 == 1, 0).when(k % 4 == 1, size + 1).otherwise(size).alias("remote_size"), sha(F.when(k % 3 == 0, F.concat(html, F.lit("x"))).otherwise(html)).alias("server_sha256"), F.lit(None).cast("string").alias("error"))
    index = pages.where((k % 2 == 0) & (html != "")).select(sha(html).alias("sha256"), F.lit(integrity.VERIFIED).alias("indice_status"))
    return two_pass.verify(listed, remote, index).select(file_name(F.col("path")).alias("filename"), "url", "size_status", "local_sha256", "status", "bytes_read")


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, len(text) AS chars FROM documents""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as lines of a folder of text files, which tasks read by splits: each line's number over the folder."""
    folder = scratch.scratch_folder(spark)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.translate("text", "\r\n", "  "))
    read(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(folder)
    rows = id_source.numbered_lines(spark, folder)
    sizes = scratch.written(rows.groupBy("archivo_origen").agg(F.max("linea_origen").alias("n")), "sizes")
    before = Window.orderBy("archivo_origen").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = sizes.select("archivo_origen", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(sizes, "archivo_origen")
    return numbered.select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), (F.col("before") + F.col("linea_origen")).alias("place"), (F.char_length("line") - F.char_length(F.substring_index("line", " ", 1)) - 1).cast("long").alias("chars"))


@query(f"""WITH d(code, dept_name) AS (VALUES {_DEPARTMENTS}), c AS (SELECT lpad((c_custkey % 100)::VARCHAR, 2, '0') AS code, count(*) AS n FROM customer GROUP BY 1)
SELECT c.code, n, dept_name FROM c LEFT JOIN d ON c.code = d.code""")
def dim_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.decode(_coded(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code")


@query(f"""WITH d(code, dept_name) AS (VALUES {_DEPARTMENTS}) SELECT count(dept_name) AS matched, count(*) - count(dept_name) AS unmatched
FROM customer LEFT JOIN d ON lpad((c_custkey % 100)::VARCHAR, 2, '0') = d.code""")
def dim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.decode_counts(_coded(spark, sf_dir), "code")


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, (row_number() OVER (PARTITION BY regexp_extract(url, '^(.*)/[^/]*$', 1) ORDER BY string_split(url || '/' || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '/x' ELSE '-x/y' END, '/'), page_id))::INTEGER AS place FROM pages""")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat("url", F.lit("/"), (k % 3).cast("string"), F.when(k % 2 == 0, "/x").otherwise("-x/y"))
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder"), path.alias("path"))
    return p.select("page_id", "folder", F.row_number().over(Window.partitionBy("folder").orderBy(path_parts(F.col("path")), "page_id")).alias("place"))


_PLACED = """
p AS (
  SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN '/in/01/002/zona_' || lpad((c_custkey % 7)::VARCHAR, 2, '0') || '/puesto_03/01_002_9_9_E14_PRE_' || c_custkey || '.pdf'
    WHEN 1 THEN '/in/01_002_9_9_E14_PRE_' || c_custkey || '.pdf'
    WHEN 2 THEN '/in/zona_/puesto_02/01_002_9_9_E14_PRE_' || c_custkey || '.pdf'
    WHEN 3 THEN '/in/zona_01/puesto_02/01_002_9_E14_' || c_custkey || '.pdf'
    ELSE '/in/zona_01/puesto_02/01_002_9_9_E15_PRE_' || c_custkey || '.pdf' END AS path
  FROM customer
), placed AS (
  SELECT c_custkey, path,
    CASE WHEN c_custkey % 5 = 0 OR c_custkey % 15 = 1 THEN '01' END AS dept, CASE WHEN c_custkey % 5 = 0 THEN '002' WHEN c_custkey % 15 = 1 THEN '777' END AS mpio,
    CASE WHEN c_custkey % 5 = 0 THEN lpad((c_custkey % 7)::VARCHAR, 2, '0') WHEN c_custkey % 15 = 1 THEN '08' END AS zona,
    CASE WHEN c_custkey % 5 = 0 THEN '03' WHEN c_custkey % 15 = 1 THEN '09' END AS puesto FROM p
)"""


@query(f"WITH {_PLACED} SELECT *, 'https://host/docs/E14/' || dept || '/' || mpio || '/' || zona || '/' || puesto || '/E14_PRE_' || c_custkey || '.pdf' AS url FROM placed")
def path_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey")
    forms = ("/in/zona_/puesto_02/01_002_9_9_E14_PRE_%d.pdf", "/in/zona_01/puesto_02/01_002_9_E14_%d.pdf", "/in/zona_01/puesto_02/01_002_9_9_E15_PRE_%d.pdf")
    path = F.when(k % 5 == 0, F.format_string("/in/01/002/zona_%02d/puesto_03/01_002_9_9_E14_PRE_%d.pdf", k % 7, k)).when(k % 5 == 1, F.format_string("/in/01_002_9_9_E14_PRE_%d.pdf", k))
    for i, form in enumerate(forms[:2], 2):
        path = path.when(k % 5 == i, F.format_string(form, k))
    files = c.withColumn("path", path.otherwise(F.format_string(forms[2], k)))
    bridge = c.where(k % 15 == 1).select(F.format_string("01_002_9_9_E14_PRE_%d.pdf", k).alias("filename"), *[F.lit(v).alias(n) for n, v in (("dept", "01"), ("mpio", "777"), ("zona", "08"), ("puesto", "09"))])
    return integrity.locate(files, bridge, "https://host")


_SIZED = """
f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'u' || doc_id END AS url, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE strlen(text) END AS local_size, n_chars, text FROM documents),
r AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 5 = 1 THEN -1 ELSE n_chars END AS remote_size, CASE WHEN doc_id % 5 = 1 AND doc_id % 11 <> 0 THEN 'TIMEOUT' END AS error FROM f),
sized AS (SELECT doc_id, url, local_size, remote_size, error,
  CASE WHEN url IS NULL THEN 'URL_NO_CONSTRUIBLE' WHEN local_size IS NULL THEN 'ERROR_LOCAL' WHEN remote_size = -1 THEN 'ERROR_DESCARGA' WHEN remote_size = 0 THEN 'TAMANIO_NO_DISPONIBLE'
       WHEN local_size = remote_size THEN 'IGUAL_TAMANIO' ELSE 'DIFERENTE_TAMANIO' END AS status FROM r)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    url = F.concat(F.lit("u"), "doc_id")
    files = d.select("doc_id", F.when(k % 11 != 0, url).alias("url"), F.when(k % 13 != 0, F.octet_length("text").cast("long")).alias("local_size"))
    remote = d.select(url.alias("url"), F.when(k % 5 == 0, F.lit(0).cast("long")).when(k % 5 == 1, F.lit(-1).cast("long")).otherwise(F.col("n_chars")).alias("remote_size"), F.when(k % 5 == 1, "TIMEOUT").alias("error"))
    return integrity.reconcile_sizes(files, remote)


@query(f"""WITH {_SIZED} SELECT *, CASE WHEN status = 'DIFERENTE_TAMANIO' THEN 'local=' || local_size || ' remote=' || remote_size ELSE coalesce(error, '') END AS note,
CASE WHEN status IN ('IGUAL_TAMANIO', 'DIFERENTE_TAMANIO') THEN round((remote_size - local_size) * 100.0::DOUBLE / local_size, 6) END AS variation_pct FROM sized""")
def size_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("doc_id", "url", "local_size", "remote_size", "error", "status", "note", "variation_pct")


@query(f"WITH {_SIZED} SELECT s.doc_id, s.status, sha256(d.text) AS sha256 FROM sized s JOIN documents d USING (doc_id) WHERE status <> 'DIFERENTE_TAMANIO'")
def two_pass_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = integrity.size_gate(_sized(spark, sf_dir)).select("doc_id", "status")
    return passed.join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "status", sha(F.col("text")).alias("sha256"))


@query(f"WITH {_SIZED} SELECT count(*) AS seen, count(*) FILTER (status <> 'DIFERENTE_TAMANIO') AS passed, count(*) FILTER (status = 'DIFERENTE_TAMANIO') AS discarded FROM sized")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.gate_counts(_sized(spark, sf_dir))


@query(f"WITH {_SIZED} SELECT CASE WHEN status IN ('IGUAL_TAMANIO', 'DIFERENTE_TAMANIO', 'TAMANIO_NO_DISPONIBLE') THEN status ELSE 'ERROR' END AS bucket, count(*) AS n FROM sized GROUP BY 1")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.bucket_counts(_sized(spark, sf_dir), F.col("status"), (integrity.SAME_SIZE, integrity.OTHER_SIZE, integrity.NO_SIZE))


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT v.doc_id, v.status AS indice_status, d.kind, d.sha, d.text FROM verdicts v JOIN d USING (doc_id))
SELECT doc_id, indice_status, CASE WHEN doc_id % 17 = 0 THEN 'URL_NO_CONSTRUIBLE' WHEN doc_id % 19 = 0 THEN 'ERROR_DESCARGA' WHEN doc_id % 3 <> 0 THEN 'IGUAL_SERVIDOR'
WHEN indice_status = 'VERIFICADA' THEN 'MANIPULADA_EN_SERVIDOR' ELSE 'DIFERENTE_SERVIDOR' END AS status FROM s""")
def server_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    url = F.concat(F.lit("u"), "doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    local = _classified(spark, sf_dir).select("doc_id", F.col("status").alias("indice_status")).join(d, "doc_id")
    local = local.select("doc_id", "indice_status", F.when(k % 17 != 0, url).alias("url"), sha(F.col("text")).alias("local_sha256"))
    remote = d.select(url.alias("url"), F.when(k % 19 != 0, sha(F.when(k % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).alias("server_sha256"), F.when(k % 19 == 0, "TIMEOUT").alias("error"))
    return integrity.reconcile_server(local, remote).select("doc_id", "indice_status", "status")


@query("SELECT page_id, strlen(html) + 9 AS length FROM pages WHERE page_id % 3 = 0")
def magic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("%pdf"), "html")).otherwise(F.col("html"))
    p = read(spark, sf_dir, "pages").select("page_id", body.cast("binary").alias("content"))
    return p.where(files.is_pdf(F.col("content"))).select("page_id", F.octet_length("content").cast("long").alias("length"))


@query(r"""WITH k AS (SELECT page_id, page_id % 10 AS k, url FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'h' || page_id || '.co' WHEN 4 THEN '::1' WHEN 5 THEN 'x' WHEN 6 THEN '' WHEN 8 THEN 'h' WHEN 9 THEN regexp_extract(url, '^[a-z]+://([^/:]*)', 1) ELSE 'h' END AS host,
(CASE k WHEN 0 THEN 9 WHEN 3 THEN 5 WHEN 4 THEN 8443 WHEN 7 THEN NULL WHEN 9 THEN 8443 ELSE 443 END)::INTEGER AS port,
CASE k WHEN 0 THEN '/x' WHEN 1 THEN '/a b' WHEN 2 THEN '/x' WHEN 3 THEN '/' WHEN 4 THEN '/p' WHEN 5 THEN '/y' WHEN 6 THEN 'no/host:1' WHEN 7 THEN '' WHEN 8 THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) END AS path FROM k""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 10
    forms = {0: F.concat(F.lit("HTTPS://User:p@H"), "page_id", F.lit(".Co:9/x?q#f")), **{i: F.lit(x) for i, x in {1: "https://h/a b", 2: "https://h:0/x?q", 3: "ftp+x://h:5/", 4: "https://[::1]:8443/p#f", 5: " \t//x/y", 6: "no/host:1", 7: "https://h:port", 8: "https://h?/no"}.items()}}
    url = F.regexp_replace("url", "^([a-z]+://[^/:]*)", "$1:8443")
    for i, form in forms.items():
        url = F.when(k == i, form).otherwise(url)
    return read(spark, sf_dir, "pages").select("page_id", url_parts(url).alias("u")).select("page_id", "u.*")


@query(r"""SELECT page_id, 'url=' || replace(url_encode(url), '%20', '+') || '&ctl00%24x+%C3%A9=' || CASE WHEN page_id % 3 = 0 THEN 'None' ELSE replace(url_encode(html || '~*é'), '%20', '+') END AS body FROM pages""")
def form_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 3 != 0, F.concat("html", F.lit("~*é")))
    return read(spark, sf_dir, "pages").select("page_id", form_encoded({"url": F.col("url"), "ctl00$x é": html}).alias("body"))


@query("""SELECT p_partkey, ltrim(CASE p_partkey % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'vv' WHEN 2 THEN '' ELSE 'v1.' END || CASE WHEN p_partkey % 4 <> 2 THEN p_size::VARCHAR ELSE '' END, 'v') > '1.3' AS newer FROM part""")
def version_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    tag = F.when(k == 0, F.concat(F.lit("v"), size)).when(k == 1, F.concat(F.lit("vv"), size)).when(k == 2, "").otherwise(F.concat(F.lit("v1."), size))
    return read(spark, sf_dir, "part").select("p_partkey", newer_version(tag, F.lit("1.3")).alias("newer"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 10 AS k, round(o_totalprice / 1000) - 100 AS delay, o_custkey % 7 AS workers FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 6, 9) THEN greatest(0.0::DOUBLE, delay) ELSE 1.0::DOUBLE END AS delay, CASE WHEN k IN (0, 9) THEN greatest(1, least(4, workers)) WHEN k IN (6, 7) THEN 4 ELSE 1 END AS workers FROM r""")
def settings_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, delay, workers = F.col("o_orderkey") % 10, F.round(F.col("o_totalprice") / 1000) - 100, F.col("o_custkey") % 7
    forms = {
        0: F.format_string('{"delay": %.1f, "workers": %d}', delay, workers), 1: F.format_string('{"delay": %.1f}', delay), 2: F.lit("{}"), 3: F.format_string('{"workers": %d', workers),
        4: F.lit('{"workers": "many", "delay": 3.5}'), 5: F.lit('{"delay": null, "workers": 3}'), 6: F.format_string('{"delay": %.1f, "workers": 99999999999}', delay),
        7: F.lit('{"workers": 1000000000000000000000000000000}'), 8: F.lit('[{"workers": 3}]'), 9: F.format_string('{"delay": "%.1f", "workers": "%d"}', delay, workers),
    }
    text = F.lit(None).cast("string")
    for i, form in forms.items():
        text = F.when(k == i, form).otherwise(text)
    r = config.captured(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text")
    bounded = config.within(F.col("delay"), F.col("workers"))
    return r.select("o_orderkey", bounded[0].alias("delay"), bounded[1].alias("workers"))


@query("SELECT page_id, 'HTTP_' || (400 + page_id % 100) || CASE WHEN page_id % 7 = 0 THEN '' ELSE ': ' || left(html, 200) END AS error FROM pages")
def http_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", ids.http_error(400 + k % 100, F.when(k % 7 != 0, F.col("html"))).alias("error"))


# --- identifiers ---------------------------------------------------------------------------------------------------

_WS = r"[\s\x0B\x85\p{Z}]"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1)::INTEGER AS linea_origen FROM documents),
s AS (SELECT *, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS clean FROM l)
SELECT doc_id, linea_origen, string_split_regex(clean, '{_WS}+')[1] AS token FROM s WHERE clean <> '' AND NOT starts_with(clean, '#')""")
def id_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return id_source.tokens(id_source.lines(d, "text", "doc_id")).select("doc_id", "linea_origen", "token")


_IDS = """
raw AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' 1.234.' || o_orderkey || ' ' WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN 'ABC' || o_orderkey WHEN 3 THEN '...'
  WHEN 4 THEN '0012' || o_orderkey WHEN 5 THEN '99999999' || o_orderkey ELSE '12,345,6' || (o_orderkey % 50) END AS token FROM orders),
n AS (SELECT *, replace(replace(replace(trim(token), '.', ''), ',', ''), ' ', '') AS norm FROM raw),
valid AS (SELECT o_orderkey, token, CASE WHEN norm = '' THEN trim(token) ELSE norm END AS nuip,
  CASE WHEN norm = '' THEN 'VACIO' WHEN NOT regexp_full_match(norm, '[0-9]+') THEN 'NO_NUMERICO' WHEN length(norm) NOT BETWEEN 6 AND 10 THEN 'LONGITUD_INVALIDA' END AS error FROM n)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text, m = k.cast("string"), k % 7
    token = F.when(m == 0, F.concat(F.lit(" 1.234."), text, F.lit(" "))).when(m == 1, text).when(m == 2, F.concat(F.lit("ABC"), text)).when(m == 3, "...").when(m == 4, F.concat(F.lit("0012"), text)).when(m == 5, F.concat(F.lit("99999999"), text)).otherwise(F.concat(F.lit("12,345,6"), (k % 50).cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", token.alias("token"))


@query(f"WITH {_IDS} SELECT *, CASE WHEN error IS NULL THEN nuip::BIGINT END AS nuip_int FROM valid")
def id_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.validate(_tokens(spark, sf_dir))


@query(f"WITH {_IDS} SELECT nuip, min(o_orderkey) AS o_orderkey FROM valid WHERE error IS NULL GROUP BY nuip")
def id_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ids.validate(_tokens(spark, sf_dir)).where("error is null").select("nuip", "o_orderkey")
    return ids.first_occurrences(v, "nuip", ("o_orderkey",))


_RESPONSES = """
r AS (SELECT event_id, CASE event_id % 9 WHEN 6 THEN 429 WHEN 7 THEN 500 WHEN 8 THEN 0 ELSE 200 END AS http_status, CASE WHEN event_id % 18 = 8 THEN 'TIMEOUT' WHEN event_id % 9 = 7 THEN 'HTTP_500: x' END AS transport_error, event_id % 9 AS kind FROM events),
classified AS (SELECT event_id, http_status, CASE kind WHEN 0 THEN 'VIVO' WHEN 1 THEN 'FALLECIDO' WHEN 2 THEN 'DESCONOCIDO' WHEN 3 THEN 'DESCONOCIDO' ELSE 'ERROR' END AS clasificacion,
  CASE kind WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'VIGENCIA_NO_MAPEADA' WHEN 3 THEN 'VIGENCIA_NO_MAPEADA' WHEN 4 THEN 'RESPUESTA_VACIA' WHEN 5 THEN 'JSON_PARSE' WHEN 6 THEN 'RATE_LIMITED' WHEN 7 THEN 'HTTP_500: x'
    ELSE CASE WHEN transport_error IS NULL THEN 'SIN_RESPUESTA' ELSE 'TIMEOUT' END END AS error,
  CASE kind WHEN 0 THEN 'Vigente (Vivo)' WHEN 1 THEN ' Cancelada por Muerte ' WHEN 2 THEN 'otra' WHEN 3 THEN 'None' ELSE '' END AS vigencia_raw, CASE WHEN kind = 0 THEN '1' ELSE '' END AS codigo, kind >= 6 AS failed FROM r)"""


def _classified_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 9
    body = F.when(k == 0, '{"vigencia":"Vigente (Vivo)","codigo":1}').when(k == 1, '{"vigencia":" Cancelada por Muerte "}').when(k == 2, '{"vigencia":"otra"}').when(k == 3, '{"vigencia":null}').when(k == 4, F.col("props"))
    body = body.when(k == 5, F.element_at(F.array(*[F.lit(x) for x in ("{}", "[]", "null", "0", "false", "<html>")]), (F.col("event_id") % 6 + 1).cast("int")))
    status = F.when(k == 6, 429).when(k == 7, 500).when(k == 8, 0).otherwise(200)
    error = F.when(F.col("event_id") % 18 == 8, "TIMEOUT").when(k == 7, "HTTP_500: x")
    return ids.classify_responses(read(spark, sf_dir, "events").select("event_id", status.alias("http_status"), body.alias("body"), error.alias("transport_error")))


@query(f"WITH {_RESPONSES} SELECT * FROM classified")
def response_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified_responses(spark, sf_dir).select("event_id", "http_status", "clasificacion", "error", "vigencia_raw", "codigo", "failed")


_ORDERED = "CASE status WHEN 'VIVO' THEN 1 WHEN 'FALLECIDO' THEN 2 WHEN 'NO_EXISTE' THEN 3 WHEN 'SIN_DATOS' THEN 4 WHEN 'INVALIDO' THEN 5 WHEN 'ERROR' THEN 6 WHEN 'DESCONOCIDO' THEN 7 ELSE 1000 END"


@query(f"""WITH {_RESPONSES}, c AS (SELECT clasificacion AS status, count(*) AS n FROM classified GROUP BY 1)
SELECT status, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct, (row_number() OVER (ORDER BY {_ORDERED}, status))::INTEGER AS place FROM c""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.status_summary(_classified_responses(spark, sf_dir), F.col("clasificacion"), ids.CLASSES)


@query("""WITH c AS (SELECT coalesce(event_type, 'DESCONOCIDO') AS status, count(*) AS n FROM events GROUP BY 1)
SELECT status, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct, (row_number() OVER (ORDER BY status))::INTEGER AS place FROM c""")
def event_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.status_summary(read(spark, sf_dir, "events"), F.col("event_type"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.rollup_counts(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"WITH {_RESPONSES} SELECT event_id, clasificacion, error FROM classified WHERE clasificacion = 'FALLECIDO' OR clasificacion = 'ERROR'")
def class_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.class_rows(_classified_responses(spark, sf_dir), "clasificacion", "FALLECIDO", "ERROR").select("event_id", "clasificacion", "error")


@query(f"""WITH {_RESPONSES}, x AS (SELECT event_id, clasificacion, row_number() OVER (PARTITION BY clasificacion ORDER BY event_id) AS place, count(*) OVER (PARTITION BY clasificacion) AS total FROM classified)
SELECT event_id, clasificacion, place::INTEGER AS place, greatest(0, total - CASE clasificacion WHEN 'FALLECIDO' THEN 500 ELSE 50 END) AS more FROM x
WHERE (clasificacion = 'FALLECIDO' AND place <= 500) OR (clasificacion IN ('ERROR', 'INVALIDO') AND place <= 50)""")
def capped_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified_responses(spark, sf_dir).select("event_id", "clasificacion")
    return ids.capped(rows, "clasificacion", {"FALLECIDO": 500, "INVALIDO": 50, "ERROR": 50}, ("event_id",))


@query(f"WITH {_IDS} SELECT nuip, 'INVALIDO' AS clasificacion, error FROM valid WHERE error IS NOT NULL UNION ALL SELECT DISTINCT nuip, 'PENDIENTE', NULL FROM valid WHERE error IS NULL")
def results_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir).withColumns({"archivo_origen": F.lit("orders"), "linea_origen": F.col("o_orderkey")})
    queue, rejects = ids.queue_and_rejects(t)
    return rejects.select("nuip", "clasificacion", "error").unionByName(queue.select("nuip", F.lit("PENDIENTE").alias("clasificacion"), F.lit(None).cast("string").alias("error")))


@query("""SELECT c_custkey, c_name, o.o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1) o ON c_custkey = o_custkey WHERE c_custkey % 10 <> 0""")
def combined_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 0, "TIMEOUT").alias("error"))
    last = state.latest(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice"), ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return ids.combined_profile(names, last.select("c_custkey", "o_totalprice"), "c_custkey").select("c_custkey", "c_name", "o_totalprice")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_name AS n, c_mktsegment AS m FROM customer)
SELECT c_custkey, line AS linea_origen, token FROM (
  SELECT c_custkey, 2 AS line, CASE k WHEN 0 THEN n || chr(10) || 'x, "q"' ELSE m END AS token FROM c WHERE k < 2 UNION ALL
  SELECT c_custkey, 4, 'short' FROM c WHERE k = 0 UNION ALL
  SELECT c_custkey, 1, n FROM c WHERE k = 2 UNION ALL SELECT c_custkey, 2, m FROM c WHERE k = 2 UNION ALL
  SELECT c_custkey, 1, 'a"b' FROM c WHERE k = 3)""")
def id_csv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, m = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")
    texts = (
        F.concat(F.lit('\ufeffx, Documento ,y\r\n1,"'), n, F.lit('\nx, ""q""",2\r\n\r\nshort\r\n')),
        F.concat(F.lit("NUIP;z,cc\n1,"), m),
        F.concat(n, F.lit(",1\n"), m, F.lit(",2\n")),
        F.lit('a"b,"c'),
    )
    text = F.when(k == 0, texts[0]).when(k == 1, texts[1]).when(k == 2, texts[2]).otherwise(texts[3])
    return id_source.csv_tokens(read(spark, sf_dir, "customer").select("c_custkey", text.alias("value")), "c_custkey")


@query("""SELECT n_name AS filename, lpad(n_regionkey::VARCHAR, 2, '0') AS dept, 'm' || n_nationkey AS mpio, 'z' AS zona, lpad(n_nationkey::VARCHAR, 3, '0') AS puesto FROM nation WHERE n_nationkey % 4 <> 3""")
def index_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    place = F.when(k % 4 == 3, F.format_string("%02d/m%d", "n_regionkey", k)).otherwise(F.format_string("%02d/m%d/z/%03d", "n_regionkey", k, k))
    entry = F.concat(F.lit('"'), "n_name", F.lit('":"'), place, F.lit('"'))
    doc = read(spark, sf_dir, "nation").agg(F.concat(F.lit('{"by_location":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value"))
    return index_source.locations(doc)


@query("""SELECT n_name AS filename, i AS place, CASE WHEN n_nationkey % 3 = 0 THEN 'v' || i || '-' || n_nationkey WHEN i = 0 AND n_nationkey % 3 = 1 THEN 'l' || n_nationkey ELSE 's' || n_nationkey END AS sha256,
CASE WHEN n_nationkey % 3 = 0 THEN 'note ' || i WHEN i = 0 AND n_nationkey % 3 = 1 THEN 'version original' ELSE 'version servidor post-modificacion' END AS note
FROM nation, (VALUES (0), (1)) t(i) WHERE n_nationkey % 3 < 2 OR i = 0""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    new = F.format_string('{"versions":[{"sha256":"v0-%d","note":"note 0"},{"sha256":"v1-%d","note":"note 1"}]}', k, k)
    old, only = F.format_string('{"local_sha256":"l%d","server_sha256":"s%d"}', k, k), F.format_string('{"versions":[],"local_sha256":"","server_sha256":"s%d"}', k)
    entry = F.concat(F.lit('"'), "n_name", F.lit('":'), F.when(k % 3 == 0, new).when(k % 3 == 1, old).otherwise(only))
    doc = read(spark, sf_dir, "nation").agg(F.concat(F.lit('{"known_dif":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("value"))
    return index_source.known_versions(doc).select("filename", F.posexplode("versions").alias("place", "v")).select("filename", "place", "v.sha256", "v.note")


@query("SELECT s_name AS filename, 'https://host/' || s_suppkey AS url FROM supplier")
def index_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('"'), "s_name", F.lit('":"https://host/'), F.col("s_suppkey").cast("string"), F.lit('"'))
    s = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 7).alias("part")).agg(F.concat(F.lit('{"_meta":"{}",'), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    return index_source.urls(s)


# --- state ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, mode FROM orders, (VALUES ('online'), ('size'), ('both')) m(mode) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
AND l_returnflag IN ('A', 'N') AND mode = CASE l_linenumber % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'size' ELSE 'both' END)""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.col("l_linenumber") % 3
    progress = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(flag == "A", "ok").when(flag == "N", "invalid").otherwise("err").alias("bucket"), F.when(n == 0, "online").when(n == 1, "size").otherwise("both").alias("mode"))
    return state.pending(read(spark, sf_dir, "orders").select("o_orderkey"), progress, "o_orderkey", modes=("online", "size", "both"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unconverted(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT DISTINCT event_type AS bucket, user_id AS member FROM events")
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.progress_rows(read(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"), F.col("user_id").alias("member")), "bucket", "member")


@query("SELECT arg_max(event_type, (ts, event_id)) AS bucket, user_id AS member FROM events GROUP BY user_id")
def progress_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"), F.col("user_id").alias("member"), "ts", "event_id")
    return state.moved_between(e, "bucket", "member", ["ts", "event_id"])


@query("SELECT user_id, event_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) WHERE place % 10 = 0")
def checkpoint_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.every_nth(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 10).drop("ts")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, arg_min(event_id, (value, event_id)) AS run_start, count(*) AS run_length, count(*) // 3 AS trips FROM r WHERE event_type = 'error' GROUP BY user_id, island""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.failure_runs(read(spark, sf_dir, "events"), "user_id", ["value", "event_id"], F.col("event_type") == "error")


_LIMITED = """
r AS (SELECT doc_id, CASE WHEN n_chars % 53 = 0 THEN 429 WHEN n_chars % 2 = 0 THEN 0 WHEN n_chars % 7 = 0 THEN 503 ELSE 200 END AS status FROM documents),
f AS (SELECT *, status = 0 OR status >= 500 AS failed, status = 429 AS limited FROM r),
g AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1 AS before FROM g),
p AS (SELECT *, CASE WHEN failed THEN before % 3 + 1 ELSE 0 END AS fails, before > 0 AND before % 3 = 0 AS pause_before FROM h),
s AS (SELECT *, count(*) OVER w * 1.0::DOUBLE + 60.0::DOUBLE * (count(*) FILTER (pause_before) OVER w + count(*) FILTER (limited) OVER w - limited::INTEGER) AS sent_s FROM p WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"""


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the requests of one session."""
    n = F.col("n_chars")
    status = F.when(n % 53 == 0, 429).when(n % 2 == 0, 0).when(n % 7 == 0, 503).otherwise(200)
    requests = read(spark, sf_dir, "documents").select("doc_id", status.alias("status"))
    return limiter.limiter(requests, ["doc_id"], limiter.transport_failed(F.col("status"), F.lit("")), F.col("status") == limiter.LIMITED_STATUS)


@query(f"WITH {_LIMITED} SELECT doc_id, run, fails, pause_before, limited AS pause_after, sent_s FROM s")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir).select("doc_id", "run", "fails", "pause_before", "pause_after", "sent_s")


@query(f"""WITH {_LIMITED}, q AS (SELECT doc_id, 'fallos' AS kind, sent_s - 60 AS starts_s FROM s WHERE pause_before UNION ALL SELECT doc_id, 'limite', sent_s FROM s WHERE limited)
SELECT *, starts_s + 60 AS ends_s FROM q""")
def limiter_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.pauses(_limited(spark, sf_dir)).select("doc_id", "kind", "starts_s", "ends_s")


@query("""WITH RECURSIVE c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, n_chars % 5 < 2 OR doc_id // 150 % 3 = 1 AS bad FROM documents),
walk(i, fails, since, fallback) AS (  -- before call i: failures in a row, calls on the fallback, whether on it
  SELECT 1::BIGINT, 0, 0, false UNION ALL
  SELECT i + 1, CASE WHEN bad AND NOT now THEN (CASE WHEN w.fallback THEN 0 ELSE fails END) + 1 ELSE 0 END, s, now FROM (
    SELECT w.*, c.bad, CASE WHEN w.fallback OR fails >= 3 THEN (CASE WHEN w.fallback THEN since ELSE 0 END) + 1 ELSE since END AS s,
      (w.fallback OR fails >= 3) AND NOT (((CASE WHEN w.fallback THEN since ELSE 0 END) + 1) % 50 = 0 AND NOT bad) AS now FROM walk w JOIN c USING (i)) w)
SELECT doc_id, CASE WHEN n.fallback THEN 'fallback' ELSE 'primary' END AS transport FROM c JOIN walk n ON n.i = c.i + 1""")
def transport_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the calls of one session."""
    k, n = F.col("doc_id"), F.col("n_chars")
    calls = read(spark, sf_dir, "documents").select("doc_id", ((n % 5 < 2) | (F.floor(k / 150) % 3 == 1)).alias("bad"))
    return state.transports(calls, [], ["doc_id"], "bad").select("doc_id", "transport")


@query(f"WITH {_LIMITED} SELECT run, min(doc_id) AS run_start, count(*) AS run_length, count(*) // 3 AS trips FROM s WHERE failed GROUP BY run")
def limiter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.runs(_limited(spark, sf_dir), at="doc_id")


@query("""SELECT user_id, event_id, event_type, before, place::INTEGER AS place FROM (SELECT *, row_number() OVER w AS place, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before <> event_type""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return state.changes(e, "user_id", ["ts", "event_id"], "event_type").drop("ts")


_MOVES = """
f AS (SELECT c_custkey, 'f' || (c_custkey - c_custkey % 3) || '.pdf' AS filename, CASE WHEN n.n_nationkey < 20 THEN n.n_name END AS dept_name, CASE WHEN c_custkey // 3 % 9 <> 0 THEN 'p' || (c_custkey // 3 % 4) END AS puesto
  FROM customer JOIN nation n ON c_custkey // 3 % 25 = n.n_nationkey),
m AS (SELECT *, '/b/' || dept_name || '/m/z/' || puesto || '/' || filename AS organized FROM f),
located AS (SELECT *, CASE WHEN c_custkey % 8 = 0 AND organized IS NOT NULL THEN organized WHEN c_custkey % 2 = 0 THEN '/b/in-' || (7 - c_custkey % 3) || '/' || filename ELSE '/b/in/' || (7 - c_custkey % 3) || '/' || filename END AS path FROM m),
present AS (SELECT path FROM located UNION SELECT organized FROM located WHERE c_custkey % 36 = 0),
queue AS (SELECT c_custkey, row_number() OVER (PARTITION BY organized ORDER BY string_split(path, '/')) AS turn FROM located
  WHERE organized IS NOT NULL AND organized <> path AND organized NOT IN (SELECT path FROM present WHERE path IS NOT NULL)),
plan AS (SELECT located.c_custkey, filename, organized, path,
  CASE WHEN organized IS NULL THEN 'sin_patron' WHEN organized = path THEN 'en_sitio' WHEN turn = 1 THEN 'movida' ELSE 'conflicto' END AS outcome FROM located LEFT JOIN queue USING (c_custkey))"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    g = F.floor(k / 3)
    c = read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), g % 25 == F.col("n_nationkey"))
    f = c.select("c_custkey", F.format_string("f%d.pdf", g * 3).alias("filename"), F.lit("/b").alias("base"), F.when(F.col("n_nationkey") < 20, F.col("n_name")).alias("dept_name"), F.lit("m").alias("mpio"), F.lit("z").alias("zona"), F.when(g % 9 != 0, F.format_string("p%d", g % 4)).alias("puesto"))
    dest = F.when(F.col("dept_name").isNotNull() & F.col("puesto").isNotNull(), F.concat_ws("/", "base", "dept_name", "mpio", "zona", "puesto", "filename"))
    path = F.when((k % 8 == 0) & dest.isNotNull(), dest).when(k % 2 == 0, F.format_string("/b/in-%d/%s", 7 - k % 3, "filename")).otherwise(F.format_string("/b/in/%d/%s", 7 - k % 3, "filename"))
    f = f.withColumn("path", path)
    present = f.select("path").unionByName(f.where((k % 36 == 0) & dest.isNotNull()).select(dest.alias("path")))
    return state.plan_moves(f, present)


@query(f"WITH {_MOVES} SELECT * FROM plan")
def organize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("c_custkey", "filename", "organized", "path", "outcome")


@query(f"""WITH {_MOVES} SELECT count(*) FILTER (outcome = 'movida') AS moved, count(*) FILTER (outcome = 'sin_patron') AS no_pattern, count(*) FILTER (outcome = 'conflicto') AS conflict,
count(*) FILTER (outcome = 'en_sitio') AS in_place FROM plan""")
def move_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.move_counts(_moves(spark, sf_dir))


@query(f"WITH {_MOVES} SELECT filename, organized AS source, path AS target, CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'revertida' END AS outcome FROM plan WHERE outcome = 'movida'")
def manifest_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _moves(spark, sf_dir).where("outcome = 'movida'")
    manifest = moved.select("filename", F.col("path").alias("original"), "organized")
    return state.revert_plan(manifest, moved.where("c_custkey % 5 <> 0").select(F.col("organized").alias("path")))


# --- text, tables, certificates ------------------------------------------------------------------------------------


_HELD = " OR ".join(f"contains(lower(text), '{w}')" for w in tls.KEYWORDS)


@query(f"""WITH d AS (SELECT doc_id, coalesce({_HELD}, false) AS hit FROM documents)
SELECT doc_id, hit, CASE WHEN hit THEN 'INTERCEPTACION_LOCAL' WHEN doc_id % 4 = 0 THEN 'CADENA_AUTOFIRMADA_DESCONOCIDA' WHEN doc_id % 4 = 1 THEN 'CADENA_INCOMPLETA_SERVIDOR' WHEN doc_id % 4 = 2 THEN 'OK' ELSE 'DESCONOCIDO' END AS likely_cause FROM d""")
def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    o = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("issuer_cn"), F.when(k == 0, F.col("text")).otherwise("host").alias("subject_cn"), F.when(k == 1, "Unable to get local issuer certificate").otherwise("").alias("verify_error"), (k == 2).alias("connected"))
    return tls.diagnose(o).select("doc_id", F.col("intercepted").alias("hit"), "likely_cause")


_ENDPOINTS = ", ".join(f"('{key}', '{label}', '{url}')" for key, label, url in tls.ENDPOINTS)


@query(f"WITH e(key, label, url) AS (VALUES {_ENDPOINTS}) SELECT e.key, e.label, e.url, count(event_id) AS n FROM e LEFT JOIN events ON e.key = (user_id % 8)::VARCHAR GROUP BY ALL")
def endpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return tls.endpoints(spark).join(seen, "key", "left").select("key", "label", "url", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH c AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (30 + o_custkey % 300)::INTEGER AS b, DATE '1997-06-01' AS t FROM orders)
SELECT o_orderkey, 'desde ' || strftime(a, '%Y-%m-%d') || ' hasta ' || strftime(b, '%Y-%m-%d') AS dates, datediff('day', t, b)::INTEGER AS days_left, t BETWEEN a AND b AS valid_then FROM c""")
def certificate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    began = F.to_date("o_orderdate")
    c = read(spark, sf_dir, "orders").select("o_orderkey", began.alias("not_before"), F.date_add(began, (30 + F.col("o_custkey") % 300).cast("int")).alias("not_after"), F.lit("1997-06-01").cast("date").alias("checked"))
    return tls.validity(c, "checked").select("o_orderkey", "dates", "days_left", "valid_then")


@query(r"""SELECT page_id, regexp_extract(html, 'name="description"[^>]*value="([^"]*)"', 1) AS field, trim(regexp_extract(html, 'id="main"[^>]*>([^<]+)<', 1)) AS by_id,
regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(html, '(?i)>\s*AND\s*<[^>]*>\s*([^<]+)', 1)) AS labelled FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<td>And</td> value ' || page_id || ' <i>' ELSE '' END AS html FROM pages)""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    tail = F.when(F.col("page_id") % 3 == 0, F.format_string("<td>And</td> value %d <i>", "page_id")).otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", F.concat("html", tail).alias("html")).select("page_id", tables.form_field(h, "description").alias("field"), tables.text_by_id(h, "main").alias("by_id"), F.regexp_extract(h, '<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, 'href="([^"]*)"', 1).alias("href"), tables.value_by_label(h, "AND").alias("labelled"))


@query("SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN '' END, ''), nullif(CASE WHEN page_id % 2 = 0 THEN url END, ''), '') AS text FROM pages")
def text_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", tables.first_text(F.when(k % 3 == 0, F.col("html")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.col("url"))).alias("text"))


def _conversation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    blank = F.col("turn") % 5 == 0
    cells = F.array(F.when(~blank, F.col("role")), F.when(blank, " ").otherwise(F.col("text")))
    rows = c.groupBy("conv_id", (F.col("turn") % 2 + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("turn", cells.alias("cells")))).alias("r"))
    return rows.select(F.col("conv_id").alias("doc"), "page", F.lit(1).alias("ord"), F.transform("r", lambda x: x["cells"]).alias("rows"))


@query("""WITH c AS (SELECT conv_id AS doc, (turn % 2 + 1)::INTEGER AS page, turn, role, text FROM conversations WHERE turn % 5 <> 0)
SELECT doc, page, (dense_rank() OVER (PARTITION BY doc ORDER BY page))::INTEGER AS table_no, (row_number() OVER (PARTITION BY doc, page ORDER BY turn))::INTEGER AS row_no, role AS c1, text AS c2 FROM c""")
def table_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.explode_tables(_conversation_tables(spark, sf_dir))
    return t.select("doc", "page", "table_no", "row_no", F.col("cells")[0].alias("c1"), F.col("cells")[1].alias("c2"))


@query("""WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "x"' ELSE '' END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS b, p_type || CASE WHEN p_partkey % 7 = 0 THEN chr(10) || 'y ' ELSE '' END AS c FROM part),
q AS (SELECT p_partkey, a, coalesce(b, '') AS b, trim(replace(c, chr(10), ' ')) AS c FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(a, '[",]') THEN '"' || replace(a, '"', '""') || '"' ELSE a END || ',' || CASE WHEN regexp_matches(b, '[",]') THEN '"' || replace(b, '"', '""') || '"' ELSE b END || ',' || CASE WHEN regexp_matches(c, '[",]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS line FROM q""")
def table_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = F.array(F.concat("p_name", F.when(k % 3 == 0, ', "x"').otherwise("")), F.when(k % 5 != 0, F.col("p_brand")), F.concat("p_type", F.when(k % 7 == 0, "\ny ").otherwise("")))
    return read(spark, sf_dir, "part").select("p_partkey", csv_line(cells).alias("line"))


@query("""SELECT count(*) AS total, count(*) FILTER (n_chars >= 500) AS ok, count(*) FILTER (n_chars BETWEEN 100 AND 499) AS empty, count(*) FILTER (n_chars < 100) AS fail,
sum(doc_id % 3)::BIGINT AS embedded, sum(doc_id % 2)::BIGINT AS csv_files, (max(doc_id + n_chars % 60) - min(doc_id))::BIGINT AS elapsed_s FROM documents""")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    n = F.col("n_chars")
    times = F.timestamp_seconds(1_700_000_000 + F.col("doc_id")), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") + n % 60)
    outcome = F.when(n >= 500, "ok").when(n >= 100, "empty").otherwise("fail")
    rows = d.select(outcome.alias("outcome"), (F.col("doc_id") % 3).alias("embedded"), (F.col("doc_id") % 2).alias("csv_files"), times[0].alias("started"), times[1].alias("ended"))
    return summaries.conversion_totals(rows, started="started", ended="ended")


_GAP = "chr(10) || chr(10) ||"


@query(f"""WITH c AS (SELECT DISTINCT conv_id AS doc, turn % 2 AS page FROM conversations WHERE turn % 5 <> 0)
SELECT doc, count(*) AS n, {_GAP} '---' || {_GAP} '## Tablas detectadas (CSV embebido)' || {_GAP} '_' || count(*) || ' tabla(s)' AS opening FROM c GROUP BY doc""")
def tables_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.table_section(_conversation_tables(spark, sf_dir))
    return t.select("doc", "n", F.regexp_extract("section", r"(?s)^(.*? tabla\(s\))", 1).alias("opening"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE p_brand END AS cn FROM part")
def certificate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    org = F.array(entry("organizationName", F.col("p_type")))
    rdns = F.when(F.col("p_partkey") % 3 == 0, F.array(org, F.array(entry("commonName", F.col("p_name")), entry("commonName", F.col("p_type"))))).when(F.col("p_partkey") % 3 == 1, F.array(org)).otherwise(F.array(F.array(entry("commonName", F.col("p_brand"))), org))
    return read(spark, sf_dir, "part").select("p_partkey", tls.common_name(rdns).alias("cn"))


# --- rules over sheets ---------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS k, sum(l_quantity) AS parts, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT k, n, parts, parts + CASE k % 6 WHEN 1 THEN 4 WHEN 2 THEN 31 WHEN 3 THEN -31 ELSE 0 END AS total, CASE k % 5 WHEN 1 THEN 0 WHEN 2 THEN parts + 2 WHEN 3 THEN parts - 40 ELSE parts END AS urna,
  CASE k % 4 WHEN 1 THEN parts - 1 WHEN 2 THEN parts - 50 ELSE parts + 90 END AS habilitados, CASE WHEN k % 11 = 0 THEN -1 ELSE 0 END AS least FROM s)
SELECT k AS o_orderkey, total - parts AS diff, CASE WHEN least < 0 THEN 'genuina' WHEN urna = 0 THEN 'lectura'
  WHEN greatest(abs(total - parts), abs(urna - parts), urna - habilitados) > 30 THEN 'lectura' WHEN total <> parts OR urna <> parts OR urna > habilitados THEN 'genuina' ELSE 'sin alerta' END AS signal FROM t""")
def arith_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("parts"))
    k, p = F.col("o_orderkey"), F.col("parts")
    sheets = s.withColumns({
        "total": p + F.when(k % 6 == 1, 4).when(k % 6 == 2, 31).when(k % 6 == 3, -31).otherwise(0),
        "urna": F.when(k % 5 == 1, F.lit(0)).when(k % 5 == 2, p + 2).when(k % 5 == 3, p - 40).otherwise(p),
        "habilitados": F.when(k % 4 == 1, p - 1).when(k % 4 == 2, p - 50).otherwise(p + 90),
        "least": F.when(k % 11 == 0, -1).otherwise(0),
    })
    return acta.arithmetic(sheets).select("o_orderkey", "diff", "signal")


@query("""WITH p AS (SELECT o_custkey, median(o_totalprice) AS peer FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice / peer, 6) AS ratio FROM orders JOIN p USING (o_custkey)""")
def ratio_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acta.ratio_vs_peers(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice")).select("o_orderkey", "ratio")


@query("""WITH p AS (SELECT o_custkey, avg(o_totalprice) AS peer FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice / peer, 6) AS ratio FROM orders JOIN p USING (o_custkey)""")
def ratio_vs_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acta.ratio_vs_peers(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice"), "mean").select("o_orderkey", "ratio")


@query("""WITH s AS (SELECT o_orderkey AS k, (o_custkey % 3 - 1) * 5 AS diff FROM orders), t AS (SELECT k, diff, CASE WHEN diff <> 0 THEN 'genuina' ELSE 'sin alerta' END AS signal,
  CASE k % 5 WHEN 0 THEN 'revisada' WHEN 1 THEN 'en revisión' END AS review FROM s)
SELECT k AS o_orderkey, signal, CASE WHEN review IS NOT NULL THEN review WHEN diff = 0 THEN 'sin alerta' ELSE 'alerta' END AS light,
CASE WHEN review = 'revisada' THEN CASE WHEN diff = 0 THEN 'Mesa Limpia' ELSE 'Posible Fraude' END END AS outcome FROM t""")
def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sheets = acta.arithmetic(o.select("o_orderkey", (100 + (F.col("o_custkey") % 3 - 1) * 5).alias("total"), F.lit(100).alias("parts")))
    reviews = o.where(k % 5 < 2).select("o_orderkey", F.when(k % 5 == 0, "revisada").otherwise("en revisión").alias("review"))
    return acta.traffic_light(sheets, reviews, "o_orderkey").select("o_orderkey", "signal", "light", "outcome")


@query("""WITH c AS (SELECT o_orderkey AS k, o_custkey % 10 AS a, (o_custkey // 10) % 10 AS b, o_orderkey % 4 AS h, (o_orderkey % 100)::DOUBLE / 100 AS conf FROM orders)
SELECT k AS o_orderkey, CASE WHEN h = 0 THEN 'h' WHEN conf >= 0.7 THEN a::VARCHAR WHEN h = 1 THEN 's' END AS digit, CASE WHEN h = 0 THEN 'persona' WHEN conf >= 0.7 THEN 'modelo' WHEN h = 1 THEN 'segundo' END AS source,
CASE WHEN h = 0 OR conf >= 0.7 OR h = 1 THEN NULL WHEN conf >= 0.5 THEN a || ',' || b || ',x' WHEN conf > 0.2 THEN b || ',' || a || ',x' WHEN conf > 0.1 THEN b || ',x,' || a ELSE b || ',x,y' END AS open FROM c""")
def settled_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, conf = F.col("o_orderkey"), (F.col("o_orderkey") % 100).cast("double") / 100
    reading = lambda digit, c: F.struct(digit.alias("digit"), c.alias("conf"))
    best, second = (F.col("o_custkey") % 10).cast("string"), (F.floor(F.col("o_custkey") / 10) % 10).cast("string")
    candidates = F.array(reading(F.lit("y"), F.lit(0.1)), reading(F.lit("x"), F.lit(0.2)), reading(best, conf), reading(second, F.lit(0.4999)))
    human, other = F.when(k % 4 == 0, "h"), F.when(k % 4 == 1, "s")
    d = acta.settled_digit(candidates, human, other)
    return read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.digit", "d.source", F.array_join("d.open", ",").alias("open"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 0.5::DOUBLE + coalesce(CASE WHEN l_linenumber > 1 THEN l_discount END, 0) * 2.0::DOUBLE AS score FROM lineitem")
def strike_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").withColumn("second", F.when(F.col("l_linenumber") > 1, F.col("l_discount")))
    return x.select("l_orderkey", "l_linenumber", acta.weighted_score({"l_quantity": 0.5, "second": 2.0}).alias("score"))


@query("SELECT l_suppkey, count(*) AS n, round(stddev_samp(l_quantity), 6) AS deviation, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr FROM lineitem GROUP BY 1")
def group_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acta.dispersion(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


@query("WITH p AS (SELECT median(n_chars) AS peer FROM documents) SELECT doc_id, round(n_chars / peer, 6) AS ratio FROM documents, p")
def ratio_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in one group."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit("all").alias("scope"))
    return acta.ratio_vs_peers(d, "scope", F.col("n_chars")).select("doc_id", "ratio")


@query("""WITH q AS (SELECT source, count(n_chars) AS n, quantile_cont(n_chars, 0.05) AS low, quantile_cont(n_chars, 0.95) AS high FROM documents GROUP BY 1)
SELECT doc_id, n, round(low, 6) AS low, round(high, 6) AS high FROM documents JOIN q USING (source) WHERE n_chars < low OR n_chars > high""")
def outside_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beyond the percentiles of their source, of which one may have most rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").where("source is not null")
    q = quantiles.quantiles(d, "source", "n_chars", {"low": 0.05, "high": 0.95})
    return scan.join_hot(d, q.withColumn("rows", F.col("n")), "source", "rows", d.count()).where("n_chars < low or n_chars > high").select("doc_id", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT l_suppkey, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY 1")
def group_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acta.correlation(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


@query("""SELECT r_name, n_name, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS flagged, grouping(r_name, n_name)::BIGINT AS level, round(count(*) FILTER (c_acctbal < 0) / count(*), 6) AS rate
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def geo_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return acta.geo_rate(c, "r_name", "n_name", flagged=F.col("c_acctbal") < 0)


_SNAPS = """a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 10 <> 0 GROUP BY 1)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    count = lambda until, rows: rows.where(F.col("ts") < F.to_timestamp_ntz(F.lit(until))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return count("2024-01-05 00:00:00", e), count("2024-01-20 00:00:00", e.where("user_id % 10 <> 0"))


@query(f"""WITH {_SNAPS} SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS a, b.n AS b, CASE WHEN a.n IS NULL THEN 'nueva' WHEN b.n IS NULL THEN 'retirada' WHEN a.n = b.n THEN 'igual' ELSE 'cambiada' END AS change,
round((b.n - a.n) * 100.0::DOUBLE / a.n, 6) AS variation_pct FROM a FULL JOIN b ON a.user_id = b.user_id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acta.snapshot_diff(*_snapshots(spark, sf_dir), "user_id", "n")


@query(f"""WITH {_SNAPS}, div AS (SELECT a.user_id, a.n AS was FROM a LEFT JOIN b ON a.user_id = b.user_id WHERE b.n IS NULL OR a.n <> b.n), now AS (SELECT user_id, count(*) AS now FROM events WHERE user_id % 7 <> 0 AND event_type <> 'error' GROUP BY 1)
SELECT div.user_id, was, now.now, CASE WHEN now.now IS NULL THEN 'INACCESIBLE' WHEN was = now.now THEN 'ahora igual' ELSE 'sigue diferente' END AS seguimiento FROM div LEFT JOIN now ON div.user_id = now.user_id""")
def recheck_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = acta.snapshot_diff(*_snapshots(spark, sf_dir), "user_id", "n").where("a is not null and change in ('cambiada', 'retirada')").select("user_id", F.col("a").alias("was"))
    now = read(spark, sf_dir, "events").where("user_id % 7 <> 0 and event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("now"))
    return integrity.recheck(diff, now, "user_id", "was", "now")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v FROM lineitem), c AS (SELECT * FROM x WHERE l_linenumber = 1), t AS (SELECT * FROM x WHERE l_linenumber = 2), d AS (SELECT * FROM x WHERE l_linenumber = 3),
k AS (SELECT DISTINCT l_orderkey FROM x WHERE l_linenumber <= 3)
SELECT k.l_orderkey, c.v AS c, t.v AS t, d.v AS d, CASE WHEN c.v IS NULL OR t.v IS NULL OR d.v IS NULL THEN 'incompleta' WHEN c.v = t.v AND c.v = d.v THEN 'iguales' WHEN t.v = d.v THEN 'difiere_c' WHEN c.v = d.v THEN 'difiere_t' WHEN c.v = t.v THEN 'difiere_d' ELSE 'todas_difieren' END AS verdict
FROM k LEFT JOIN c ON k.l_orderkey = c.l_orderkey LEFT JOIN t ON k.l_orderkey = t.l_orderkey LEFT JOIN d ON k.l_orderkey = d.l_orderkey""")
def copy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    copies = [x.where(F.col("l_linenumber") == i).select("l_orderkey", "l_returnflag") for i in (1, 2, 3)]
    return acta.compare_copies(*copies, "l_orderkey", "l_returnflag")


@query("""WITH m AS (SELECT c_nationkey, median(c_acctbal) AS middle FROM customer GROUP BY 1), z AS (SELECT c_custkey // 3 AS zone, round(c_acctbal - middle) AS delta FROM customer JOIN m USING (c_nationkey))
SELECT zone, count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down, sum(sign(delta))::BIGINT AS bias FROM z WHERE delta <> 0 GROUP BY 1 HAVING count(*) >= 2 AND (min(delta) > 0 OR max(delta) < 0)""")
def directional_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    middle = c.groupBy("c_nationkey").agg(F.median("c_acctbal").alias("middle"))
    deltas = c.join(middle, "c_nationkey").select(F.floor(F.col("c_custkey") / 3).alias("zone"), F.round(F.col("c_acctbal") - F.col("middle")).alias("delta"))
    return acta.directional_bias(deltas, "zone", "delta")


@query("SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 50 AND s_nationkey = c_nationkey)")
def undesignated(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("juror"), F.col("s_nationkey").alias("place"))
    signed = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 50).alias("juror"), F.col("c_nationkey").alias("place"))
    return acta.undesignated(signed, named, ["juror", "place"]).select("c_custkey", "c_nationkey")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, before, highest FROM (SELECT *, lag(l_linenumber) OVER w AS before, max(l_linenumber) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS highest FROM lineitem
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber)) WHERE l_linenumber < before""")
def version_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return acta.version_reversions(x, "l_partkey", ["l_orderkey", "l_linenumber"], "l_linenumber")


@query("SELECT lang, count(*) AS n, count(q.doc_id) AS covered, round(count(q.doc_id) / count(*), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) q ON d.doc_id = q.doc_id GROUP BY lang")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    return summaries.coverage(d, "lang", F.coalesce("there", F.lit(False)))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return acta.top_k(x, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.tumbling_counts(read(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH c AS (SELECT t AS date, doc_id, n_chars + CASE WHEN doc_id % 4 = t % 4 THEN t ELSE doc_id % 2 * (t // 3) END AS size FROM documents, range(1, 6) AS r(t) WHERE (doc_id + t) % 6 <> 0),
b AS (SELECT *, CASE WHEN lag(date) OVER w = date - 1 AND lag(size) OVER w = size THEN 0 ELSE 1 END AS begins FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY date)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY date) AS run FROM b)
SELECT doc_id, size, 'd' || min(date) AS valid_from, CASE WHEN max(date) < 5 THEN 'd' || (max(date) + 1) END AS valid_to FROM r GROUP BY doc_id, run, size""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five captures of an index, merged one after the other."""
    folder, k = scratch.scratch_folder(spark), F.col("doc_id")
    for t in range(1, 6):
        d = read(spark, sf_dir, "documents").where((k + t) % 6 != 0)
        size = F.col("n_chars") + F.when(k % 4 == t % 4, t).otherwise(k % 2 * (t // 3))
        history.merge(folder, d.select("doc_id", size.alias("size")), "doc_id", f"d{t}")
    return history.history(spark, folder)
