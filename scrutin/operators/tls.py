"""Causes of certificate observations."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Issuers of products that inspect traffic, and phrases of verification errors.
KEYWORDS = (
    "kaspersky", "eset", "avast", "avg", "mcafee", "norton", "bitdefender", "fortinet", "fortigate", "zscaler", "netskope", "cisco umbrella",
    "sonicwall", "forcepoint", "websense", "sophos", "trendmicro", "trend micro", "gdata", "malwarebytes", "ssl inspection", "deep packet",
    "content filter", "proxy", "web filter", "surfshark", "nordvpn",
)
# The endpoints, by key, label and URL.
ENDPOINT_SCHEMA = "key string, label string, url string"
ENDPOINTS = (
    ("1", "E14C segunda vuelta  (escrutinios2vuelta...)", "https://escrutinios2vueltapresidente2026.registraduria.gov.co/data/index.json"),
    ("2", "E14C primera vuelta  (escrutinios...)", "https://escrutiniospresidente2026.registraduria.gov.co/data/index.json"),
    ("3", "E14D segunda vuelta  (e14segundavueltapresidente...)", "https://e14segundavueltapresidente.registraduria.gov.co/home"),
    ("4", "E14T segunda vuelta  (e14segundavueltapresidentet...)", "https://e14segundavueltapresidentet.registraduria.gov.co/home"),
    ("5", "E14D primera vuelta  (divulgacione14presidente...)", "https://divulgacione14presidente.registraduria.gov.co/home"),
    ("6", "E14T primera vuelta  (divulgacione14presidentet...)", "https://divulgacione14presidentet.registraduria.gov.co/home"),
)


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENDPOINTS, ENDPOINT_SCHEMA)


def contains_any(lowered: Column, words: tuple[str, ...] = KEYWORDS, whole_words: bool = False) -> Column:
    """Bare substrings, as specified ("reset" holds "eset"), of a text that is in lower case already; whole_words is the
    strict form. A plain OR stops at the first hit and stays in generated code."""
    if whole_words:
        return lowered.rlike(r"\b(" + "|".join(words) + r")\b")
    return reduce(operator.or_, [F.contains(lowered, F.lit(w)) for w in words])


def self_signed(subject: Column, issuer: Column) -> Column:
    return (F.coalesce(subject, F.lit("")) != "") & (subject == issuer)


def common_name(rdns: Column) -> Column:
    """The first commonName of array<array<struct<k, v>>>, else an empty string."""
    return F.coalesce(F.get(F.filter(F.flatten(rdns), lambda x: x["k"] == "commonName"), F.lit(0))["v"], F.lit(""))


def likely_cause(intercepted: Column, signed_itself: Column, error: Column, connected: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(intercepted, "INTERCEPTACION_LOCAL")
        .when(signed_itself | e.contains("self-signed"), "CADENA_AUTOFIRMADA_DESCONOCIDA")
        .when(e.contains("unable to get local issuer"), "CADENA_INCOMPLETA_SERVIDOR")
        .when(connected, "OK")
        .otherwise("DESCONOCIDO")
    )


def diagnose(observations: DataFrame) -> DataFrame:
    """observations(subject_cn, issuer_cn, verify_error, connected, ...) plus self_signed, intercepted and likely_cause.

    A select for each step: the issuer is lowered once and tested once."""
    o = observations.withColumns({"self_signed": self_signed(F.col("subject_cn"), F.col("issuer_cn")), "_issuer": F.lower(F.coalesce("issuer_cn", F.lit("")))})
    o = o.withColumn("intercepted", contains_any(F.col("_issuer"))).drop("_issuer")
    return o.withColumn("likely_cause", likely_cause(F.col("intercepted"), F.col("self_signed"), F.col("verify_error"), F.coalesce("connected", F.lit(False))))


def validity(certificates: DataFrame, checked: str, not_before: str = "not_before", not_after: str = "not_after") -> DataFrame:
    """certificates(not_before, not_after, checked) plus `dates` as shown to people, days_left (negative: expired) and
    valid_then: whether the time of the check is within both."""
    shown = [F.date_format(c, "yyyy-MM-dd") for c in (not_before, not_after)]
    valid = F.col(checked).between(F.col(not_before), F.col(not_after))
    return certificates.withColumns({"dates": F.format_string("desde %s hasta %s", *shown), "days_left": F.datediff(not_after, checked), "valid_then": valid})
