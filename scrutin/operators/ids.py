"""Identifier lists: validation, first occurrence, classification of captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import id_error, non_empty, normalized_id, strip

# Status texts of the service and their classes.
CLASS_OF = {"Vigente (Vivo)": "VIVO", "Cancelada por Muerte": "FALLECIDO", "Cedula no Existe": "NO_EXISTE", "Sin datos para consultar": "SIN_DATOS"}
MOST_BODY = 200  # characters of an error's body
CLASSES = ("VIVO", "FALLECIDO", "NO_EXISTE", "SIN_DATOS", "INVALIDO", "ERROR", "DESCONOCIDO")


def validate(rows: DataFrame, token: str = "token") -> DataFrame:
    """Adds nuip (normalised; for an empty one the stripped token), nuip_int (the service's integer, leading zeros lost)
    and error (null if valid)."""
    n = normalized_id(F.col(token))
    return rows.withColumns({"nuip": F.coalesce(non_empty(n), strip(F.col(token))), "error": id_error(n)}).withColumn("nuip_int", F.when(F.col("error").isNull(), F.expr("try_cast(nuip as bigint)")))


def first_occurrences(rows: DataFrame, key: str = "nuip", order: tuple[str, ...] = ("archivo_origen", "linea_origen")) -> DataFrame:
    """The first row of each key in file order. min_by with partial aggregation: a key that very many rows have is
    reduced before the shuffle, and ties don't depend on arrival."""
    others = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*").select(*rows.columns)


def queue_and_rejects(rows: DataFrame, token: str = "token") -> tuple[DataFrame, DataFrame]:
    """Valid IDs once each, and every rejected row (rejects are not deduplicated)."""
    v = validate(rows, token)
    return first_occurrences(v.where("error is null")), v.where("error is not null").withColumn("clasificacion", F.lit("INVALIDO"))


def classify_responses(rows: DataFrame) -> DataFrame:
    """rows(http_status, body, transport_error, ...) plus clasificacion, error, vigencia_raw, codigo, fecha_consulta and
    failed (what the failure counter counts).

    In order: 429, a transport error, no response, HTTP errors, an unusable body, a known status text, an unknown one, an
    empty one. The body's shape comes first: empty objects, arrays and scalars are unparseable, a filled array or a
    non-zero scalar is a worker error, and a present null reads as "None"."""
    # A select for each step: what several later expressions use is computed once and generated code stays small.
    s = F.col("http_status")
    r = rows.withColumn("_v", F.try_parse_json("body"))
    r = r.withColumns({"_shape": F.schema_of_variant("_v"), "_text": F.try_variant_get("_v", "$.vigencia", "string"), "_code": F.try_variant_get("_v", "$.codigo", "string"), "_date": F.try_variant_get("_v", "$.fecha", "string")})
    shape = F.col("_shape")
    r = r.withColumn("_object", F.coalesce(shape.startswith("OBJECT<"), F.lit(False)))
    none = F.col("_text").isNull() & shape.rlike(r"[<\s]`?vigencia`?: VOID")
    zero = ~F.col("_object") & ~shape.startswith("ARRAY<") & strip(F.col("body")).isin("0", "0.0", "-0", "false", '""')
    r = r.withColumns({
        "vigencia_raw": F.coalesce(F.when(F.col("_object"), F.when(none, "None").otherwise(F.col("_text"))), F.lit("")),
        "_falsy": shape.isNull() | shape.isin("OBJECT<>", "ARRAY<VOID>", "VOID") | zero,
        "_local": F.when(s == 429, "RATE_LIMITED").otherwise(non_empty(F.col("transport_error"))),
        "codigo": F.coalesce(F.when(F.col("_object"), F.col("_code")), F.lit("")),
        "fecha_consulta": F.coalesce(F.when(F.col("_object"), F.col("_date")), F.lit("")),
        "failed": F.coalesce(non_empty(F.col("transport_error")).isNotNull() | (s == 429) | (s == 0) | (s >= 500), F.lit(False)),
    })
    r = r.withColumn("_clean", strip(F.col("vigencia_raw")))
    known = F.create_map(*[F.lit(x) for pair in CLASS_OF.items() for x in pair])
    r = r.withColumn("_known", F.try_element_at(known, F.col("_clean")))
    known_text = F.col("_known")
    rule = F.when(F.col("_local").isNotNull(), 1).when(s == 0, 2).when(s >= 400, 3).when(F.col("_falsy"), 4).when(~F.col("_object"), 5)
    rule = rule.when(known_text.isNotNull(), 6).when(F.col("_clean") != "", 7).otherwise(8)
    # Arrays by the rule's number: a filter on the class that is pushed down repeats the rule once, not once for each case.
    errors = F.array(F.col("_local"), F.lit("SIN_RESPUESTA"), F.concat(F.lit("HTTP_"), s.cast("string")), F.lit("JSON_PARSE"), F.lit("WORKER"), F.lit(""), F.lit("VIGENCIA_NO_MAPEADA"), F.lit("RESPUESTA_VACIA"))
    labels = F.array(*[F.lit("ERROR")] * 5, known_text, F.lit("DESCONOCIDO"), F.lit("ERROR"))
    r = r.withColumn("_rule", rule)
    r = r.withColumns({"error": F.element_at(errors, F.col("_rule")), "clasificacion": F.element_at(labels, F.col("_rule"))})
    return r.drop(*[c for c in r.columns if c.startswith("_")])


def http_error(status: Column, body: Column, most: int = MOST_BODY) -> Column:
    """The text of an HTTP error: its number and the first characters of its body, if there is one."""
    return F.concat(F.lit("HTTP_"), status.cast("string"), F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(": "), F.substring(body, 1, most))).otherwise(""))


def as_text(rows: DataFrame) -> DataFrame:
    """Every column as text, null as empty: the form of the CSV sink."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def combined_profile(names: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Name records without an error, with their status where there is one."""
    return names.where("error is null or error = ''").drop("error").join(status, key, "left")


def capped(rows: DataFrame, by: str, caps: dict[str, int], order: tuple[str, ...]) -> DataFrame:
    """The first rows of each class up to its cap, with `place` and `more` (how many the cap left out).

    The filter by the largest cap is a literal, so each task keeps only that many rows of a class before the shuffle."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col(by))
    total = rows.where(F.col(by).isin(*caps)).groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    heads = rows.where(F.col(by).isin(*caps)).withColumn("place", place).where(F.col("place") <= max(caps.values()))
    return heads.where(F.col("place") <= cap).join(total, by).withColumn("more", F.greatest(F.lit(0), F.col("total") - cap)).drop("total")
