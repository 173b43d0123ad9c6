"""JSON files that hold one big array, read by byte ranges.

Where a range begins, nobody knows whether it stands in a string. So every range is walked first for each state it may begin
in: outside of strings, inside, or behind a backslash. What it leads to is two small numbers a state; strung together along
a file they give the true state and depth at the start of each range. Then each range yields the records that begin in it,
and reads on past its end for the last.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_BYTES = 32 << 20
MORE = 1 << 16  # bytes read at once behind a range
TASK_BYTES = 4 << 20  # small ranges share a task up to about so many bytes, one range after the other
OUTSIDE, INSIDE, ESCAPED = range(3)
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["{}\[\]]', re.S)  # a quote by itself: a string without an end
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)


def _open_state(data: bytes, start: int) -> int:
    """State after an open string's content from `start` on."""
    tail = data[start:]
    return ESCAPED if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else INSIDE


class Walk:
    """Brackets outside of strings as (place, byte); `state` is that of the end once they are through."""

    def __init__(self, data: bytes, state: int):
        self.data, self.state = data, state

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        data, at = self.data, 0
        if not data:
            return
        if self.state != OUTSIDE:
            at = 1 if self.state == ESCAPED else 0
            rest = _REST.match(data, at)
            if rest is None:
                self.state = _open_state(data, at)
                return
            at = rest.end()
        self.state = OUTSIDE
        for m in _TOKEN.finditer(data, at):
            piece = m.group()
            if piece == b'"':
                self.state = _open_state(data, m.end())
                return
            if len(piece) == 1:
                yield m.start(), piece


def _opened(path: str):
    """The file of a path as Spark lists it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    file = system.open_input_file(inner)
    if file.read_at(2, 0) == b"\x1f\x8b":
        raise ValueError(f"{path} is compressed and has no byte ranges; read it whole")
    return file


def _record_depth(file) -> int:
    """Brackets around a record: one in an array, none where the file is one record."""
    at = 0
    while piece := file.read_at(MORE, at):
        at += len(piece)
        text = piece.lstrip(b"\xef\xbb\xbf \t\r\n")
        if text:
            return int(text[:1] == b"[")
    return 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _opened(row["path"]) as file:
                data = file.read_at(row["end"] - row["start"], row["start"])
            ends, depths = [], []
            for state in (OUTSIDE, INSIDE, ESCAPED):
                if state == ESCAPED and data[:1] not in (b'"', b"\\"):
                    ends.append(ends[INSIDE])
                    depths.append(depths[INSIDE])
                    continue
                walk = Walk(data, state)
                depths.append(sum(1 if mark in b"{[" else -1 for _, mark in walk))
                ends.append(walk.state)
            yield pa.RecordBatch.from_pylist([{**row, "ends": ends, "depths": depths}], schema=_SUMMARY)


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("ends", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64()))])


def _strung(ranges: pd.DataFrame) -> pd.DataFrame:
    """State and depth at the start of each range of one file."""
    state, depth, rows = OUTSIDE, 0, []
    for r in ranges.sort_values("start").itertuples():
        rows.append((r.path, r.start, r.end, state, depth))
        state, depth = int(r.ends[state]), depth + int(r.depths[state])
    return pd.DataFrame(rows, columns=["path", "start", "end", "state", "depth"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _opened(row["path"]) as file:
                found = [r.decode("utf-8", "replace") for r in _records_of(file, **row)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["record"])


def _records_of(file, path: str, start: int, end: int, state: int, depth: int) -> Iterator[bytes]:
    level = _record_depth(file)
    parts, inside = [], False  # pieces of a record that is open
    at, size = start, end - start
    while at < end or inside:
        data = file.read_at(size, at)
        if not data:
            return  # a record without an end
        begun, walk = 0, Walk(data, state)
        for place, mark in walk:
            if mark in b"{[":
                if mark == b"{" and depth == level:
                    if at >= end:
                        return
                    begun, inside = place, True
                depth += 1
            else:
                depth -= 1
                if inside and depth == level:
                    yield b"".join([*parts, data[begun:place + 1]])
                    parts, inside = [], False
                    if at >= end:
                        return
        if inside:
            parts.append(data[begun:])
        state, at, size = walk.state, at + len(data), MORE


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of UTF-8 files that each hold one array of objects (or one object), many tasks a file.

    Elements that are no objects give no row; a record that does not parse gives a row of nulls; a record cut off by
    the end of its file gives none. Compressed files are refused. Files are opened by pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select(
        "path", F.col("length").alias("size"))
    starts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                                               F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least("size", F.col("start") + split_bytes).alias("end"))
    # rows are few and tiny, so the number of tasks is set by the bytes: the planner would put them all into one
    n, size = ranges.agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("start"))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n, max(least, math.ceil((size or 0) / TASK_BYTES)), 100_000))
    summaries = ranges.repartition(tasks).mapInArrow(
        _summaries, "path string, start long, end long, ends array<int>, depths array<long>")
    placed = summaries.groupBy("path").applyInPandas(_strung, "path string, start long, end long, state int, depth long")
    records = placed.repartition(tasks).mapInArrow(_records, "record string")
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each part file one array of records."""
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(lead + line)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*(df[c] for c in df.columns))).alias("value")).mapInArrow(framed, "value string").write.text(path)
