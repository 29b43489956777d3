"""Text helpers whose results must match plain Python semantics on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ID length bounds, ID error codes.
ID_MIN, ID_MAX = 6, 10
EMPTY, NOT_NUMERIC, BAD_LENGTH = "VACIO", "NO_NUMERICO", "LONGITUD_INVALIDA"


def strip(c: Column) -> Column:
    """Without any Unicode white space at either end (trim() knows U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def first_token(c: Column) -> Column:
    return F.get(F.split(strip(c), r"(?U)\s+"), F.lit(0))


def normalized_id(c: Column) -> Column:
    return F.translate(strip(c), "., ", "")


def id_error(normalized: Column) -> Column:
    """Null for a valid ID. Digits are ASCII: other scripts' digits count as not numeric."""
    return (
        F.when(F.coalesce(normalized, F.lit("")) == "", EMPTY)
        .when(~normalized.rlike("^[0-9]+$"), NOT_NUMERIC)
        .when(~F.char_length(normalized).between(ID_MIN, ID_MAX), BAD_LENGTH)
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, up: int = 1) -> Column:
    """The name of the folder `up` levels above; null where there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(-1 - up))


def stem(name: Column) -> Column:
    """Without the last suffix; a name that only starts with a dot has none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def path_parts(path: Column) -> Column:
    """For ordering: paths are compared part by part, so a folder's files come before those of longer names beside it."""
    return F.split(path, "/")


def url_parts(url: Column) -> Column:
    """struct(host, port, path) of any text (null: empty): host in lower case or empty; port 443 where there is none or 0, null where it is
    no port; brackets of an address and what names a user are left out. White space before, tabs and line ends don't count."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    place = F.regexp_extract(F.regexp_extract(rest, "^//([^/?#]*)", 1), "([^@]*)$", 1)
    bracketed = F.regexp_extract(place, r"\[([^\]]*)", 1)
    host = F.when(F.contains(place, F.lit("[")), bracketed).otherwise(F.substring_index(place, ":", 1))
    port = F.when(F.contains(place, F.lit("[")), F.regexp_extract(place, r"\[[^\]]*\][^:]*:(.*)$", 1)).otherwise(F.regexp_extract(place, "^[^:]*:(.*)$", 1))
    number = F.when(port.rlike("^[0-9]+$"), F.nullif(F.ltrim(port, F.lit("0")), F.lit("")))
    number = F.when((port == "") | (port.rlike("^0+$")), 443).when(F.char_length(number) <= 5, number.cast("int"))
    zone = F.substr(host, F.char_length(F.substring_index(host, "%", 1)) + 1)
    path = F.regexp_extract(F.regexp_replace(rest, "^//[^/?#]*", ""), "^([^?#]*)", 1)
    return F.struct(F.concat(F.lower(F.substring_index(host, "%", 1)), zone).alias("host"), F.when(number <= 65535, number).alias("port"), path.alias("path"))


def form_encoded(fields: dict[str, Column]) -> Column:
    """The body of a form: name=value pairs in order, percent-encoded but for letters, digits and _.-~, spaces as plus signs. A
    null value is written None."""
    def quoted(c):
        return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.concat_ws("&", *[F.concat(quoted(F.lit(k)), F.lit("="), quoted(F.coalesce(c.cast("string"), F.lit("None")))) for k, c in fields.items()])


def newer_version(tag: Column, current: Column) -> Column:
    """Whether a release's tag, without leading v's, comes after a version, both compared as text; an empty one doesn't."""
    return F.coalesce((F.ltrim(tag, F.lit("v")) != "") & (F.ltrim(tag, F.lit("v")) > current), F.lit(False))


def csv_line(cells: Column) -> Column:
    """An array of strings as a CSV row, quoted only where needed; null cells are empty, line breaks become spaces and
    cells are stripped. A row of one empty cell is written as two quotes."""
    clean = F.transform(cells, lambda x: strip(F.translate(F.coalesce(x, F.lit("")), "\n\r", "  ")))
    quoted = F.transform(clean, lambda x: F.when(x.rlike('[",]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    line = F.array_join(quoted, ",")
    return F.when((F.size(cells) == 1) & (line == ""), '""').otherwise(line)
