"""A batch source of log lines by byte ranges: spark.read.format("logrange").option("path", ...).load().

Options: path (a file every executor can open), start, end (bytes; by default the whole file), blockBytes; or, for several
ranges at once, ranges (JSON: [[path, start, end], ...]). A block gives the lines that begin in it, so lines that cross a boundary
come once; `place` is a line's byte offset.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, block long, place long, value string"


_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("value", pa.string())])
_ROWS = 20_000


@dataclass
class Block(InputPartition):
    path: str
    begin: int
    end: int
    first: bool  # of its range

    def __init__(self, path: str, begin: int, end: int, first: bool = True) -> None:
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = json.loads(options["ranges"]) if "ranges" in options else [[options["path"], int(options.get("start", 0)), int(options["end"]) if "end" in options else None]]
        self.block = int(options.get("blockbytes", options.get("blockBytes", 64 << 20)))
        self.ranges = []
        for path, begin, end in given:
            size = os.path.getsize(path)
            end = size if end is None else end
            if begin > size or end > size or (begin >= end and size):
                raise ValueError(f"no range of {path} ({size} bytes): {begin} to {end}")
            self.ranges.append((path, begin, end))

    def partitions(self) -> list[Block]:
        return [Block(path, at, min(at + self.block, end), at == begin) for path, begin, end in self.ranges for at in range(begin, end, self.block)] or [Block("", 0, 0)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        places, values = [], []
        for at, line in _lines(part) if part.begin < part.end else ():
            places.append(at)
            values.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            if len(values) == _ROWS:
                yield _batch(part, places, values)
                places, values = [], []
        yield _batch(part, places, values)


def _lines(part: Block) -> Iterator[tuple[int, bytes]]:
    with open(part.path, "rb") as f:
        at = part.begin
        if at and not part.first:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield at, line
            at += len(line)


def _batch(part: Block, places: list[int], values: list[str]) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.begin] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(values, pa.string())], schema=_ARROW)


class LogRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logrange"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogRanges)
