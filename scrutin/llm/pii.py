"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, plus signs before digits, dotted digits, runs of
digits, and cue words of identifiers. A deterministic parser for each kind then expands an anchor to the boundaries of
what surrounds it and validates that. Every parser reads each character a bounded number of times, so a long run without
an end costs linear time.

Kinds: email, ip, card and phone are the base; url_user (a URL that carries user information before its host), iban
(valid by its check digits) and account (a number after a cue word, where no base span is) are added."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

# Kinds in the order in which spans at one start are listed, cue words and schemes.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "iban", "account")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "social security", "tax id")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")

DIGITS = frozenset("0123456789")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"[\x20().0-9-]*")
AUTHORITY = re.compile(r"[^\s/@:?#]+(?::[^\s/@?#]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
AFTER_CUE = re.compile(r"(?:\s{0,3}(?:number|no\.?|nr\.?|id|#))?\s{0,3}[:=#]?\s{0,3}([0-9](?:[\x20-]?[0-9]){5,})(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE)
IBAN_START = re.compile(r"[A-Z](?=[A-Z][0-9]{2})")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: An IBAN starts at most so many characters after its cue.
IBAN_WITHIN = 60
#: Other characters keep their place: str.lower would make two of some.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("://", ("://", 3))
    for x in "0123456789":
        a.add_word("+" + x, ("+", 2))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", (".", 3))
            for gap in ("", " ", "-"):
                a.add_word(f"{x}{gap}{y}", ("9", len(gap) + 2))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def iban_valid(code: str) -> bool:
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str, at: int) -> list[tuple[int, int]]:
    """All valid IBANs that start within IBAN_WITHIN characters from `at`, wherever they end, but those inside another."""
    out = []
    for begin in IBAN_START.finditer(text, at, at + IBAN_WITHIN + 3):
        found = IBAN.match(text, begin.start())
        code = found[0].replace(" ", "") if found else ""
        left, stop = next((n for n in range(len(code), 14, -1) if iban_valid(code[:n])), 0), begin.start()
        while left:
            left -= text[stop] != " "
            stop += 1
        if stop > max(begin.start(), out[-1][1] if out else 0):
            out.append((begin.start(), stop))
    return out


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """From an at-sign: left over the local part (not before `least`), right over the domain."""
    start = at
    while start > least and LOCAL.match(text[start - 1]):
        start -= 1
    found = start < at and DOMAIN.match(text, at + 1)
    return (start, found.end()) if found else None


def _digits_left(text: str, at: int, least: int, gaps: str) -> int:
    """The start of the run of digits, with single gap characters between digits, that holds the digit at `at`."""
    while at > least:
        if text[at - 1] in DIGITS:
            at -= 1
        elif text[at - 1] in gaps and at - 1 > least and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end) of a text in code points, by start, then kind as listed. Null: none."""
    text = text or ""
    spans: list[Span] = []
    email_to = dotted_to = number_to = phone_to = url_to = cue_to = 0
    iban_at = []
    for end, (what, length) in anchors().iter(text.translate(LOWER)):
        at = end - length + 1
        if what == "@":
            if at >= email_to and (found := _email(text, at, email_to)):
                spans.append(("email", *found))
                email_to = found[1]
        elif what == ".":
            if at >= dotted_to:
                run = DOTTED.match(text, _digits_left(text, at, dotted_to, ""))
                dotted_to, parts, start = run.end(), run[0].split("."), run.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in four):
                        spans.append(("ip", start, start + len(".".join(four))))
                    start += len(".".join(four)) + 1
        elif what == "9":
            if at >= number_to:
                run = NUMBER.match(text, _digits_left(text, at, number_to, " -"))
                number_to, digits = run.end(), run[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *run.span()))
        elif what == "+":
            if at >= phone_to:
                run = PHONE.match(text, at + 2)
                stop = run.end()
                while stop > at + 2 and text[stop - 1] not in DIGITS:
                    stop -= 1
                if stop > at + 3:
                    phone_to = stop
                    if 10 <= sum(x in DIGITS for x in text[at:stop]) <= 15:
                        spans.append(("phone", at, stop))
        elif what == "://":
            if at >= url_to and (scheme := next((x for x in SCHEMES if text[max(0, at + 3 - len(x)) : at + 3].lower() == x), None)) and (found := AUTHORITY.match(text, at + 3)):
                url_to = found.end()
                spans.append(("url_user", at + 3 - len(scheme), url_to))
        elif at >= cue_to:
            cue_to = end + 1
            iban_at.append(end + 1)
    if iban_at:
        taken = sorted((a, b) for _, a, b in spans)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for at in iban_at:
            ibans = _ibans(text, at)
            spans += [("iban", *x) for x in ibans]
            if found := AFTER_CUE.match(text, at):
                begin, end = found.span(1)
                before = bisect_left(starts, end)  # so many spans begin before the number ends
                if not (before and reach[before - 1] > begin) and not any(a < end and begin < b for a, b in ibans):
                    spans.append(("account", begin, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None) -> str | None:
    """The text with each span as [KIND]; overlapping spans become one, named by the first."""
    if text is None:
        return None
    out, to, kind, start = [], 0, None, 0
    for k, a, b in [*find(text), (None, len(text) + 1, len(text) + 1)]:
        if kind and a < stop:  # noqa: F821
            stop = max(stop, b)  # noqa: F821
            continue
        if kind:
            out += [text[to:start], f"[{kind.upper()}]"]
            to = stop  # noqa: F821
        kind, start, stop = k, a, b
    return "".join(out) + text[to:]


@F.pandas_udf(T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))
def _report(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for spans in map(find, texts):
        base = [s for s in spans if s[0] in BASE]
        kinds = [s[0] for s in base]
        rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    return pd.DataFrame(rows, columns=[*[f"n_{k}" for k in BASE], "base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


#: Not deterministic for the planner only, which so never runs them twice for a row.
report, redact = _report.asNondeterministic(), _redact.asNondeterministic()


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row; map-only.

    Null and empty texts have no spans (the hash is that of an empty string). Ids are passed on as they are, null or
    repeated. Other columns, whatever their names, are not read."""
    return docs.select(F.col(f"`{id_col}`").alias(id_col), report(F.col(f"`{text_col}`")).alias("r")).select(id_col, "r.*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
