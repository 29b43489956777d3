"""Extracted tables and HTML fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import csv_line, non_empty, strip


def clean_rows(rows: Column) -> Column:
    """rows array<array<string>> without those whose cells are all blank or null."""
    return F.filter(rows, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))


def explode_tables(tables: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("page", "ord")) -> DataFrame:
    """(doc, table_no, page, row_no, cells): tables numbered over a document's pages, blank ones dropped before."""
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).where(F.size("rows") > 0)
    t = t.withColumn("table_no", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
    return t.select(doc, "table_no", "page", F.posexplode("rows").alias("at", "cells")).select(doc, "table_no", "page", (F.col("at") + 1).alias("row_no"), "cells")


def table_csv(rows: Column) -> Column:
    """A table as CSV text."""
    return F.rtrim(F.array_join(F.transform(rows, csv_line), "\n"), F.lit("\n"))


def table_section(tables: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, n, section): the Markdown section of a document's tables. One document's tables are gathered, no more."""
    # Headings and their forms.
    head = "\n\n---\n\n## Tablas detectadas (CSV embebido)\n\n_%d tabla(s) extraida(s) con pdfplumber._\n"
    block = "\n\n### Tabla %d (pagina %d)\n\n```csv\n%s\n```\n"
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).where(F.size("rows") > 0)
    t = t.withColumn("k", F.row_number().over(Window.partitionBy(doc).orderBy("page", "ord")))
    t = t.withColumn("block", F.format_string(block, "k", "page", table_csv(F.col("rows"))))
    parts = F.array_sort(F.collect_list(F.struct("k", "block")))
    return t.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["block"]), "").alias("blocks")).select(doc, "n", F.concat(F.format_string(head, "n"), "blocks").alias("section"))


def first_text(*candidates: Column) -> Column:
    """The first that is not null or empty, else an empty string."""
    return F.coalesce(*[non_empty(c) for c in candidates], F.lit(""))


# The patterns by which fields are read.
def form_field(html: Column, name: str) -> Column:
    return F.regexp_extract(html, f'name="{re.escape(name)}"[^>]*value="([^"]*)"', 1)


def text_by_id(html: Column, element: str) -> Column:
    return strip(F.regexp_extract(html, f'id="{re.escape(element)}"[^>]*>([^<]+)<', 1))


def value_by_label(html: Column, label: str) -> Column:
    return strip(F.regexp_extract(html, rf"(?i)>\s*{re.escape(label)}\s*<[^>]*>\s*([^<]+)", 1))


def unconverted(docs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return docs if force else docs.join(done.select(key).distinct(), key, "left_anti")
