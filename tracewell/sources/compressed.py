"""A batch source of log lines whose compression shows in their content: gzip members and bzip2 blocks are shared out over tasks.

`spark.read.format("compressed_logs")` cuts each file into ranges of compressed bytes. A task looks for the first member or
block that begins in its range and inflates from there on, in parts; it reads on over the end of its range to the end of the line
it is in, and the task of the next range leaves that line out. So a file of many members (rotated, appended or written in
parallel) or of bzip2 blocks is read by many tasks, and none holds more than a part of it. A single gzip member can't be entered
in the middle: it is one task's, still in parts. Plain files are shared out as they are.

Options: path, chunkBytes, maxBytes (of inflated content of a range, so a bomb stops early; 0: none), keepGoing (a damaged range
gives one row with its `error`, besides the lines before the damage).
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .growing import file_system, listed

LINES = "file string, block long, place long, value string, error string"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("value", pa.string()), ("error", pa.string())])
_PART, _TRIED = 1 << 20, 1 << 16
# The marks that begin a gzip member, a bzip2 stream and its blocks, and the end of its blocks.
_GZIP, _BZIP2, _BLOCK, _END = b"\x1f\x8b\x08", b"BZh", 0x314159265359, 0x177245385090
#: More than the largest bzip2 block can take.
_BLOCK_BYTES = 2 << 20

Segment = tuple[int, Iterator[bytes]]  # where it begins in the file, and its content in parts


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


def plain_segments(data, r: Range) -> Iterator[Segment]:
    """The range's bytes, then those behind it, in parts."""
    for begin, end in ((r.begin, r.end), (r.end, r.size)):
        for at in range(begin, end, _PART):
            yield at, iter((data.read_at(min(_PART, end - at), at),))


def _member_at(data, at: int, size: int) -> bool:
    """Whether a gzip member begins here: its header is sound and its first part inflates."""
    head = data.read_at(min(_TRIED, size - at), at)
    if len(head) < 18 or head[:3] != _GZIP or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 1 << 20) != b"" or len(head) < _TRIED or head[3:4] == b"\x00"
    except zlib.error:
        return False


def gzip_segments(data, r: Range) -> Iterator[Segment]:
    """The members from the first that begins in the range on."""
    at = r.begin
    while at < r.end and not _member_at(data, at, r.size):
        found = -1
        while found < 0 and at + 1 < r.end:
            window = data.read_at(min(_PART, r.size - at - 1), at + 1)
            k = window.find(_GZIP)
            if k >= 0:
                found = at + 1 + k
            elif len(window) < 3:
                break
            else:
                at += len(window) - 2
        if found < 0 or found >= r.end:
            return
        at = found
    if at >= r.end:
        return
    place = [at]

    def member() -> Iterator[bytes]:
        decoder, held = zlib.decompressobj(31), b""
        while not decoder.eof:
            if not held:
                held = data.read_at(min(_PART, r.size - place[0]), place[0])
                if not held:
                    raise EOFError("the compressed data end early")
                place[0] += len(held)
            out = decoder.decompress(held, _PART)
            held = decoder.unconsumed_tail
            if out:
                yield out
        place[0] -= len(decoder.unused_data)

    while place[0] < r.size and data.read_at(min(2, r.size - place[0]), place[0]) == _GZIP[:2]:  # zeros may pad the end
        yield place[0], member()


def _marks(window: bytes) -> list[tuple[int, int]]:
    """(bit, mark) of the block and end marks in a window, in order."""
    out = []
    for mark in (_BLOCK, _END):
        data = mark.to_bytes(6, "big")
        octets = np.frombuffer(window, np.uint8)
        for shift in range(8):
            moved = window if not shift else ((octets[:-1] << shift) | (octets[1:] >> (8 - shift))).astype(np.uint8).tobytes()
            k = moved.find(data)
            while k >= 0:
                out.append((8 * k + shift, mark))
                k = moved.find(data, k + 1)
    return sorted(out)


def _block(window: bytes, begin: int, end: int) -> bytes | None:
    """The content of the bzip2 block between two bits: its bits behind a stream's head, and an end with its own checksum.

    None if it isn't one: the bits of a mark can come up by chance.
    """
    value = int.from_bytes(window[begin // 8 : -(-end // 8)], "big")
    length = 8 * (-(-end // 8) - begin // 8)
    bits = (value >> (length - (end - 8 * (begin // 8)))) & ((1 << (end - begin)) - 1)
    checksum = (bits >> (end - begin - 80)) & 0xFFFFFFFF
    whole = (bits << 80) | (_END << 32) | checksum
    n = end - begin + 80
    try:
        return bz2.decompress(_BZIP2 + b"9" + (whole << (-n % 8)).to_bytes(-(-n // 8), "big"))
    except (OSError, ValueError):
        return None


def bzip2_segments(data, r: Range) -> Iterator[Segment]:
    """The blocks from the first whose mark begins in the range on, over the borders of streams."""
    at, first = r.begin, True
    while at < r.size:
        window = data.read_at(min(2 * _BLOCK_BYTES, r.size - at), at)
        found, ends = _marks(window), at + len(window) >= r.size
        i = 0
        while i < len(found):
            bit, mark = found[i]
            if mark == _END:
                i += 1
                continue
            if first and at + bit // 8 >= r.end:
                return
            later = range(i + 1, min(i + 4, len(found)))
            content = next(((j, c) for j in later if (c := _block(window, bit, found[j][0])) is not None), None)
            if content is None:
                if not ends and bit // 8 + _BLOCK_BYTES > len(window):
                    break  # its end lies in the next window
                if not first:
                    raise EOFError("the compressed data end early" if ends else "a damaged block")
                i += 1  # by chance, or the rest of a block that began before
                continue
            first = False
            yield at + bit // 8, iter((content[1],))
            i = content[0]
        if ends:
            if first and r.begin == 0 and r.size:
                raise EOFError("the compressed data end early")
            return
        if first and at + len(window) >= r.end + _BLOCK_BYTES:
            return
        at += found[i][0] // 8 if i < len(found) else len(window) - 6


def lines_of(segments: Iterator[Segment], end: int, skip: bool, max_bytes: int = 0) -> Iterator[str]:
    """Lines of segments that begin before `end`, the last of them to its end, without the first if `skip`.

    Content beyond max_bytes is an error as soon as it is seen.
    """
    held, total = b"", 0
    text = lambda line: line.decode("utf-8", "replace").removesuffix("\r")
    for begin, parts in segments:
        past = begin >= end
        if past and skip:
            return
        for part in parts:
            total += len(part)
            if max_bytes and total > max_bytes:
                raise ValueError(f"more than {max_bytes} bytes")
            *whole, held = (held + part).split(b"\n")
            for line in whole:
                if not skip:
                    yield text(line)
                skip = False
                if past:
                    return
    if held and not skip:
        yield text(held)


def segments_of(data, r: Range) -> tuple[Iterator[Segment], bool]:
    """A range's segments, and whether it goes on with a line of the range before."""
    head = data.read_at(min(4, r.size), 0)
    if head[:2] == _GZIP[:2]:
        return gzip_segments(data, r), r.begin > 0
    if head[:3] == _BZIP2:
        return bzip2_segments(data, r), r.begin > 0
    return plain_segments(data, r), r.begin > 0


class CompressedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.chunk = int(options.get("chunkBytes", 64 << 20))
        self.max_bytes = int(options.get("maxBytes", 16 << 30))
        self.keep_going = str(options.get("keepGoing", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        return [Range(f.path, f.size, a, min(a + self.chunk, f.size)) for f in listed(self.path) for a in range(0, f.size, self.chunk)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        r, at = partition, 0
        system, _ = file_system(r.path)
        values: list[str | None] = []
        try:
            with system.open_input_file(r.path) as data:
                segments, skip = segments_of(data, r)
                for line in lines_of(segments, r.end, skip, self.max_bytes):
                    values.append(line)
                    if len(values) == 20_000:
                        yield _batch(r, at, values)
                        at, values = at + len(values), []
        except (ValueError, EOFError, OSError, zlib.error) as e:
            if not self.keep_going:
                raise ValueError(f"{r.path}: {e}") from e
            yield _batch(r, at, values)
            yield _batch(r, -1, [None], f"{type(e).__name__}: {e}")
            return
        yield _batch(r, at, values)


def _batch(r: Range, first: int, values: list[str | None], error: str | None = None) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array([r.path] * n, pa.string()), pa.array([r.begin] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.string()), pa.array([error] * n, pa.string())], schema=_ARROW)


class CompressedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "compressed_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> CompressedReader:
        return CompressedReader(self.options)
