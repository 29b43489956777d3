"""One huge JSON object read by byte ranges, so that its members come from many tasks.

Whether a byte lies in a string, and how deep, depends on all bytes before it. A first pass takes from each range whether
it holds an odd number of quotes, and how deep it leads if it begins outside a string or inside one; running totals over
the ranges then give each its beginning. A second pass finds where the sections begin, and a third reads the members that
start in each range, running on beyond its end where a member does."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running
from .listing import file_system, list_files
from .scratch import written

#: Bytes of a range; of what is read at first beyond one, or before one.
RANGE, NEAR = 4 << 20, 1 << 16
#: Sections of an object, and bytes of a section's name, at most: more is refused.
MOST_SECTIONS = 10_000
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_BLANK = np.isin(np.arange(256), list(b" \t\r\n"))
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)


class Marks:
    """Quotes that open or close strings, and brackets outside strings with the depth after each."""

    def __init__(self, data: bytes, inside: bool = False, depth: int = 0, backslashes: int = 0):
        self.bytes = a = np.frombuffer(data, np.uint8)
        quotes, slash = np.nonzero(a == ord('"'))[0], a == ord("\\")
        if backslashes or slash.any():  # a quote after an odd run of backslashes is part of its string
            last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(a))))
            before = np.where(quotes > 0, last[quotes - 1], -1)
            run = quotes - 1 - before + np.where(before < 0, backslashes, 0)
            quotes = quotes[run % 2 == 0]
        self.quotes, self.inside, self.depth = quotes, inside, depth
        at = np.nonzero(_STEP[a])[0]
        outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
        self.hidden = int(_STEP[a[at[~outside]]].sum(dtype=np.int64))
        self.brackets = at[outside]
        self.after = depth + np.cumsum(_STEP[a[self.brackets]], dtype=np.int64)

    def depth_at(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.depth], self.after])[np.searchsorted(self.brackets, at)]

    def ends(self, level: int) -> np.ndarray:
        """Where members at the level end: commas there, and the bracket that closes it."""
        commas = np.nonzero(self.bytes == ord(","))[0]
        commas = commas[(np.searchsorted(self.quotes, commas) + self.inside) % 2 == 0]
        closing = self.brackets[(self.after == level - 1) & (_STEP[self.bytes[self.brackets]] < 0)]
        return np.sort(np.concatenate([commas[self.depth_at(commas) == level], closing]))

    def starts(self, level: int, before: int) -> np.ndarray:
        """The opening quotes of the keys at the level. before: the last byte before that isn't blank, 0 at a file's start."""
        opening = self.quotes[(np.arange(len(self.quotes)) + self.inside) % 2 == 0]
        opening = opening[self.depth_at(opening) == level]
        last = np.maximum.accumulate(np.where(_BLANK[self.bytes], -1, np.arange(len(self.bytes)))) if len(self.bytes) else np.zeros(0, int)
        at = np.where(opening > 0, last[opening - 1], -1) if len(opening) else opening
        found = np.where(at >= 0, self.bytes[at], before) if len(opening) else opening
        return opening[np.isin(found, [0, ord("{"), ord(",")])]


def _before(f, start: int, skip) -> tuple[int, int]:
    """How many bytes right before `start` `skip` accepts, and the byte before those (0: there is none)."""
    n, at, size = 0, start, NEAR
    while at > 0:
        near = max(0, at - size)
        f.seek(near)
        block = f.read(at - near)
        for b in reversed(block):
            if not skip(b):
                return n, b
            n += 1
        at, size = near, size * 2
    return n, 0


def _ranges(batch: pa.RecordBatch, size: int):
    for row in batch.to_pylist():
        system, at = file_system(row["path"])
        with system.open_input_file(at) as f:
            f.seek(row["start"])
            data = f.read(size)
            yield row, f, data, _before(f, row["start"], lambda b: b == ord("\\"))[0]


def _outlines(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, _, data, slashes in _ranges(batch, size):
            m = Marks(data, backslashes=slashes)
            rows.append((row["path"], row["start"], len(m.quotes) % 2, int(m.after[-1]) if len(m.after) else 0, m.hidden))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "start", "odd", "outside", "inside"])


def _sections(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, f, data, slashes in _ranges(batch, size):
            m = Marks(data, bool(row["odd"]), row["depth"], slashes)
            opens = m.brackets[(m.after == 2) & (_STEP[m.bytes[m.brackets]] > 0)]
            for at in opens.tolist():
                end = row["start"] + at
                f.seek(max(0, end - NEAR))
                name = _NAME.search(f.read(end - max(0, end - NEAR)))
                rows.append((row["path"], end, json.loads(b'"' + name[1] + b'"') if name else None, data[at : at + 1] == b"{"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["path", "at", "name", "is_object"])


def _member(f, data: bytes, begin: int, at: int, ends: np.ndarray, level: int) -> bytes:
    """The text of the member that starts at data[at]; data begins at byte `begin` of the file."""
    k = np.searchsorted(ends, at)
    if k < len(ends):
        return data[at : ends[k]]
    text, size = data[at:], NEAR
    while True:
        f.seek(begin + at + len(text))
        more = f.read(size)
        text, size = text + more, size * 2
        found = Marks(text, False, level).ends(level)
        if len(found):
            return text[: found[0]]
        if not more:
            return text


def _parsed(text: bytes) -> tuple[str, str | None]:
    """Key and value of a member: a string as it is, null as null, anything else as its JSON text."""
    text = text.decode("utf-8")
    key, end = json.decoder.scanstring(text, 1)
    value = text[end:].lstrip(" \t\r\n").removeprefix(":").strip(" \t\r\n")
    return key, json.loads(value) if value.startswith('"') else None if value == "null" else value


def members(spark: SparkSession, path: str, level: int = 2, size: int = RANGE) -> DataFrame:
    """(section, key, value) of the members of a JSON object.

    level 2: those of the objects in the object, by section, and its members that are no objects, section null. level 1: its
    own members, section null. path: a file, or a folder whose files, in name order, are one document that is cut between
    members. Strings are values as they are, null is null, others are their JSON text; a repeated key has each of its rows.
    The text must be valid JSON in UTF-8; an empty file has no rows. A task holds a range and the members that start in it."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    files = spark.createDataFrame([(path, info.size)], "path string, length long") if info.is_file else list_files(spark, path, recursive=False, suffix="").where(~F.col("filename").rlike("^[._]")).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = written(ranges, "ranges")
    n = max(spark.sparkContext.defaultParallelism, ranges.count() // 16)
    outlines = written(ranges.repartition(n, "path", "start").mapInArrow(partial(_outlines, size), "path string, start long, odd long, outside long, inside long"), "outlines")
    begun = running(outlines, ["path"], ["start"], {"odds": ("xor", F.col("odd"))}).withColumn("odd", F.col("odds").bitwiseXOR(F.col("odd")))
    step = F.when(F.col("odd") == 1, F.col("inside")).otherwise(F.col("outside"))
    begun = running(begun.withColumn("step", step), [], ["path", "start"], {"depth": ("sum", F.col("step"))})
    begun = written(begun.select("path", "start", "odd", (F.col("depth") - F.col("step")).alias("depth")).repartition(n, "path", "start"), "begun")
    sections: list[tuple] = []
    if level == 2:
        found = begun.mapInArrow(partial(_sections, size), "path string, at long, name string, is_object boolean").limit(MOST_SECTIONS + 1).collect()
        if len(found) > MOST_SECTIONS:
            raise ValueError(f"more than {MOST_SECTIONS} sections: read such an object by level 1")
        sections = sorted(tuple(r) for r in found)
    places = [s[:2] for s in sections]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, f, data, slashes in _ranges(batch, size):
                m = Marks(data, bool(row["odd"]), row["depth"], slashes)
                last = _before(f, row["start"], lambda b: _BLANK[b])[1]
                rows = []
                for depth in range(1, level + 1):
                    ends = m.ends(depth)
                    for at in m.starts(depth, last).tolist():
                        section = None
                        if depth == 2:
                            place = bisect_right(places, (row["path"], row["start"] + at)) - 1
                            section, is_object = sections[place][2:]
                            if not is_object:
                                continue
                        elif level == 2 and _opens(m, f, row["start"], at):
                            continue
                        rows.append((section, *_parsed(_member(f, data, row["start"], at, ends, depth))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["section", "key", "value"])

    return begun.mapInArrow(read, "section string, key string, value string")


def _opens(m: Marks, f, begin: int, at: int) -> bool:
    """Whether the value of the key at `at` is an object."""
    k = np.searchsorted(m.quotes, at)
    if k + 1 < len(m.quotes):
        rest = m.bytes[m.quotes[k + 1] + 1 : m.quotes[k + 1] + 257].tobytes()
        if text := rest.lstrip(b" \t\r\n:"):
            return text[:1] == b"{"
    size = NEAR
    while True:
        f.seek(begin + at)
        text = f.read(size)
        found = Marks(text)
        if len(found.quotes) > 1 and (rest := text[found.quotes[1] + 1 :].lstrip(b" \t\r\n:")) or len(text) < size:
            return len(found.quotes) > 1 and rest[:1] == b"{"
        size *= 2
