"""Markdown reports: small aggregates come from Spark, the text is put together on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity
from ..operators.ids import CLASSES, capped
from ..operators.summaries import status_summary


def percent(n: int, total: int) -> str:
    """Two decimals by Python's own rounding, which the JVM's differs from in ties."""
    return f"{n / total * 100:.2f}%" if total else "0.00%"


def markdown_table(head: Sequence[str], rows: Iterable[Sequence], right: Sequence[int] = ()) -> list[str]:
    rule = "|".join("---:" if i in right else "---" for i in range(len(head)))
    return [f"| {' | '.join(head)} |", f"|{rule}|", *(f"| {' | '.join('' if x is None else str(x) for x in r)} |" for r in rows)]


def counts_section(rows: DataFrame, column: str, order: Sequence[str] = ()) -> list[str]:
    """Counts and shares in the fixed order, then a total row, always 100%."""
    found = status_summary(rows, F.col(column), tuple(order)).orderBy("place").collect()  # a row for each status
    total = sum(r.n for r in found)
    body = [(r.status, f"{r.n:,}", percent(r.n, total)) for r in found]
    return markdown_table(("Estado", "Cantidad", "Porcentaje"), [*body, ("**Total**", f"**{total:,}**", "**100%**")], right=(1, 2))


def id_report(results: DataFrame, title: str = "Consulta de vigencia", caps: dict[str, int] | None = None) -> str:
    """Classes, then the first rows of some classes with what was left out. At most the caps' rows reach the driver."""
    caps = caps or {"FALLECIDO": 500, "INVALIDO": 50, "ERROR": 50}
    out = [f"# {title}", "", *counts_section(results, "clasificacion", CLASSES)]
    shown = capped(results, "clasificacion", caps, ("archivo_origen", "linea_origen")).orderBy("clasificacion", "place").collect()
    for name in caps:
        own = [r for r in shown if r.clasificacion == name]
        out += ["", f"## {name}", ""]
        if not own:
            out.append("Ninguno.")
            continue
        out += markdown_table(("NUIP", "Detalle", "Linea"), [(r.nuip, r.error or r.vigencia_raw, r.linea_origen) for r in own])
        if own[0].more:
            out.append(f"| ... | ({own[0].more} mas) | |")
    return "\n".join(out) + "\n"


#: Rows of a section at most; the rest is counted in a last row. write_detail has them all.
MOST_ROWS = 5_000


def detail(title: str, rows: DataFrame, columns: Sequence[str], most: int = MOST_ROWS, head: Sequence[str] = ()) -> list[str]:
    """A section of the first rows by all columns, and how many more there are; at most `most` reach the driver."""
    shown = rows.select(*columns).orderBy(*columns).limit(most + 1).collect()
    more = rows.count() - most if len(shown) > most else 0
    body = [*shown[:most], *([(f"... ({more:,} mas)", *[""] * (len(columns) - 1))] if more else [])]
    return ["", f"## {title}", "", *markdown_table(head or columns, body)]


def verdict_report(verdicts: DataFrame, title: str, detailed: Sequence[str], columns: Sequence[str], most: int = MOST_ROWS) -> str:
    """Counts by status and the first rows of the detailed statuses."""
    out = [f"# {title}", "", *counts_section(verdicts, "status")]
    for status in detailed:
        out += detail(status, verdicts.where(F.col("status") == status), columns, most)
    return "\n".join(out) + "\n"


def write_detail(verdicts: DataFrame, path: str, detailed: Sequence[str]) -> None:
    """All rows of the detailed statuses as a table, a folder for each status."""
    verdicts.where(F.col("status").isin(*detailed)).write.mode("overwrite").partitionBy("status").parquet(path)


def hash_report(verdicts: DataFrame, most: int = MOST_ROWS) -> str:
    noted = verdicts.where((F.col("status") == integrity.VERIFIED) & (F.col("note") != ""))
    rest = verdict_report(verdicts, "Verificacion de hashes", (integrity.ALTERED, integrity.UNKNOWN), ("filename", "sha256", "note"), most)
    return rest + "\n".join(detail("VERIFICADA con nota", noted, ("filename", "note"), most)) + "\n"


def size_report(sized: DataFrame) -> str:
    return verdict_report(sized, "Verificacion de tamanios", (integrity.OTHER_SIZE, integrity.NO_SIZE, integrity.FETCH_ERROR), ("path", "local_size", "remote_size", "note"))


def server_report(verdicts: DataFrame) -> str:
    return verdict_report(verdicts, "Verificacion contra el servidor", (integrity.TAMPERED, integrity.DIFFERENT, integrity.FETCH_ERROR), ("path", "url"))


def tls_report(observations: DataFrame, most: int = MOST_ROWS) -> str:
    """Counts by status, then the platforms; those beyond `most` are counted in a last row."""
    counts = observations.groupBy("status").count().orderBy("status").collect()  # a row for each status
    rows = detail("Plataformas", observations, ("label", "url", "status", "issuer_cn", "subject_cn"), most, ("Plataforma", "URL", "Estado", "Emisor", "Sujeto"))
    return "\n".join(["# Certificados", "", *(f"- {r.status}: {r['count']}" for r in counts), *rows]) + "\n"


def write_report(text: str, folder: str, name: str, now: datetime | None = None) -> tuple[str, str]:
    """Saved twice: under the minute's stamp, and as the latest. A byte order mark opens both."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M")
    paths = f"{folder}/{name}_{stamp}.md", f"{folder}/{name}.md"
    for p in paths:
        with open(p, "w", encoding="utf-8-sig") as f:
            f.write(text)
    return paths
