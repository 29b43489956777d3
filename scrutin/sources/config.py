"""Run settings: typed defaults, defaults where a saved file is corrupt, bounds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and bounds.
MOST_WORKERS = 4


@dataclass(frozen=True)
class Settings:
    delay: float = 1.0
    workers: int = 1
    ip_mode: str = "vacio"
    ip_value: str = ""
    last_input_path: str = "cedulas.txt"


def load(text: str | None) -> Settings:
    """Settings of a JSON text: what it leaves out has its default; one that is corrupt, or holds a value of no use, gives
    all defaults."""
    try:
        data = json.loads(text) if text is not None else {}
        default = asdict(Settings())
        return Settings(**{k: type(v)(data.get(k, v)) for k, v in default.items()})
    except (AttributeError, TypeError, ValueError):
        return Settings()


def dump(settings: Settings) -> str:
    return json.dumps(asdict(settings), ensure_ascii=False, indent=2)


def given(settings: Settings, *, delay: float | None = None, workers: int | None = None, ip: str | None = None) -> Settings:
    """Settings with what was given on the command line, within bounds."""
    if delay is not None:
        settings = replace(settings, delay=max(0.0, delay))
    if workers is not None:
        settings = replace(settings, workers=max(1, min(MOST_WORKERS, workers)))
    return settings if ip is None else replace(settings, ip_mode="manual", ip_value=ip)


def within(delay: Column, workers: Column) -> tuple[Column, Column]:
    """The same bounds for columns of settings of many runs."""
    return F.greatest(F.lit(0.0), delay), F.greatest(F.lit(1), F.least(F.lit(MOST_WORKERS), workers)).cast("int")


def captured(rows: DataFrame, text: str) -> DataFrame:
    """rows(text: a JSON document) plus delay and workers (long) as `load` gives them: their defaults where they are left out,
    all defaults where the text is corrupt, no object, or has a value for one of them that is of no use, null included. Whole
    numbers beyond a long are the nearest long."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # the parser ignores what comes after a value
    v = F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    delay, workers, number = (F.try_variant_get(v, f"$.{k}", t) for k, t in (("delay", "double"), ("workers", "bigint"), ("workers", "double")))
    is_text = F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.workers", "variant")), F.lit("")), F.lit("STRING"))
    bound = F.lit(9.2e18)
    workers = F.coalesce(workers, F.when(~is_text & number.isNotNull() & ~F.isnan(number), F.greatest(-bound, F.least(bound, number)).cast("long")))
    lacks = lambda k, value: F.array_contains(keys, k) & value.isNull()
    usable = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)) & ~lacks("delay", delay) & ~lacks("workers", workers)
    return rows.withColumns({"delay": F.coalesce(F.when(usable, delay), F.lit(Settings.delay)), "workers": F.coalesce(F.when(usable, workers), F.lit(Settings.workers).cast("long"))})
