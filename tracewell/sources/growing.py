"""Logs that are still being written, as a streaming source.

`spark.readStream.format("growing_logs")` follows the files of a path or glob. An offset says, for each file, how far it has
been read; a batch is the bytes between two offsets, read by as many tasks as it has chunks. Only the end of each changed file is
looked at on the driver, to find its last complete line. A file is known by its device, inode and first line, not by its
name: renamed (rotated) it goes on where it was, replaced or truncated it begins anew. An offset names the files and bytes of
a batch exactly, so a batch that is replayed reads the same.

Rows are pieces of entries: whole ones; the lines of a chunk before its first timestamped line, which belong to an entry that
began earlier; and the last entry of a chunk, which may go on. `streaming.assembly` puts the latter together with keyed state.
Files that haven't changed for `idleSeconds`, or all with `flush`, are read to their very end and their last entry is closed.

A batch of very many chunks is read in larger ones than chunkBytes asks for; entries are the same, wherever chunks end.

Options: path, chunkBytes, idleSeconds, flush, startingOffsets (JSON, as `offsets_json` gives). Files that vanish stay in the
offsets for `forgetSeconds`, so one that comes back isn't read twice; their last entry is closed like that of an idle one.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.lines import LINE_START

PIECES = "id string, slot long, kind string, path string, at long, lines array<string>, position long, device long, inode long, size long, modified double"
_ARROW = pa.schema(
    [("id", pa.string()), ("slot", pa.int64()), ("kind", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("lines", pa.list_(pa.string())), ("position", pa.int64()), ("device", pa.int64()), ("inode", pa.int64()), ("size", pa.int64()), ("modified", pa.float64())]
)
_START = re.compile(LINE_START.encode())
_TAIL, _FIRST_LINE, _BATCH = 1 << 16, 1 << 16, 4 << 20
#: Chunks of a batch beyond which they grow with it, up to the largest size: a task's own cost comes once a chunk.
_MANY, _LARGEST = 256, 32 << 20
#: The slot of pieces that need the ones before or after them; whole entries have that of their chunk.
EDGE = -1


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class Known:
    """What a listing says of a file."""

    path: str
    size: int
    modified: float
    device: int = 0
    inode: int = 0


def listed(pattern: str) -> list[Known]:
    """The files that a glob names, or all below a folder; missing ones are none. Canonical paths, each once."""
    system, path = file_system(pattern)
    fixed = re.split(r"[*?\[]", path, maxsplit=1)[0]
    base = path if fixed == path else fixed.rsplit("/", 1)[0] or "/"
    info = system.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        return []
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(base, recursive=True))
    out = {}
    for f in found:
        if not f.is_file or (fixed != path and not fnmatch.fnmatch(f.path, path)) or os.path.basename(f.path).startswith((".", "_")):
            continue
        if isinstance(system, pafs.LocalFileSystem):
            try:
                s = os.stat(f.path)
            except FileNotFoundError:  # gone since the listing
                continue
            out[os.path.realpath(f.path)] = Known(os.path.realpath(f.path), s.st_size, s.st_mtime, s.st_dev, s.st_ino)
        else:
            out[f.path] = Known(f.path, f.size, f.mtime_ns / 1e9 if f.mtime_ns else 0.0)
    return [out[p] for p in sorted(out)]


@dataclass
class Chunk(InputPartition):
    id: str
    path: str
    begin: int
    end: int
    first: int  # of this chunk
    last: int
    mark: dict | None  # the file's state, with its last chunk
    close: bool


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern = options["path"]
        self.chunk = int(options.get("chunkBytes", 32 << 20))
        self.idle = float(options["idleSeconds"]) if "idleSeconds" in options else None
        self.flush = str(options.get("flush", "false")).lower() == "true"
        self.forget = float(options.get("forgetSeconds", 86400))
        self.start = json.loads(options.get("startingOffsets", "{}"))
        self.seen: dict[str, dict] = dict(self.start)
        self.ids: dict[Known, str] = {}  # of the files as they were last listed

    def _id(self, f: Known, system: pafs.FileSystem) -> str | None:
        """Device, inode and a digest of the first line; None while that isn't complete."""
        if f in self.ids:  # unchanged since it was last looked at
            return self.ids[f]
        with system.open_input_file(f.path) as data:
            head = data.read_at(min(f.size, _FIRST_LINE), 0)
        line, newline, _ = head.partition(b"\n")
        if not newline and len(head) < _FIRST_LINE and not self.flush:
            return None
        return f"{f.device}:{f.inode}:{zlib.crc32(line):08x}" if f.inode else f"{f.path}:{zlib.crc32(line):08x}"

    @staticmethod
    def _last_line_end(f: Known, system: pafs.FileSystem, floor: int) -> int:
        """The end of the last complete line after `floor`; `floor` if there is none. Looks back from the end, part by part."""
        with system.open_input_file(f.path) as data:
            upto = f.size
            while upto > floor:
                begin = max(floor, upto - _TAIL)
                k = data.read_at(upto - begin, begin).rfind(b"\n")
                if k >= 0:
                    return begin + k + 1
                upto = begin
        return floor

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        system, _ = file_system(self.pattern)
        now, live, ids = time.time(), {}, {}
        for f in listed(self.pattern):
            try:
                name = self._id(f, system) if f.size else None
                if name is None:
                    continue
                ids[f] = name
                before = self.seen.get(name, {})
                floor = before.get("position", 0) if before.get("position", 0) <= f.size else 0
                close = self.flush or (self.idle is not None and now - f.modified >= self.idle)
                position = f.size if close else self._last_line_end(f, system, floor)
            except FileNotFoundError:  # removed or renamed meanwhile: the next listing knows more
                continue
            closed = close or (bool(before.get("closed")) and position == before["position"])
            live[name] = {"path": f.path, "position": position, "size": f.size, "device": f.device, "inode": f.inode, "modified": f.modified, "closed": closed}
        for name, state in self.seen.items():
            gone = state.get("gone", now)
            if name not in live and now - gone < self.forget:
                close = self.flush or (self.idle is not None and now - gone >= self.idle)
                live[name] = {**state, "gone": gone, "closed": bool(state.get("closed")) or close}
        self.ids = ids
        self.seen = {k: live[k] for k in sorted(live)}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        out: list[Chunk] = []
        news = sum(max(0, state["position"] - start.get(name, {"position": 0})["position"]) for name, state in end.items())
        chunk = max(self.chunk, min(-(-news // _MANY), _LARGEST))
        for name, state in start.items():
            if name not in end and not state.get("closed"):  # vanished while no stream ran: it can't go on
                out.append(Chunk(name, state["path"], state["position"], state["position"], state["position"], state["position"], None, True))
        for name, state in end.items():
            before = start.get(name, {"position": 0})
            begin = 0 if state["size"] < before["position"] else before["position"]
            close = bool(state.get("closed")) and not (before.get("closed") and begin == state["position"])
            if "gone" in state:  # nothing more comes; the entry that it left open may be taken as complete
                begin = state["position"]
            if begin >= state["position"] and not close:
                continue
            cuts = [*range(begin, state["position"], chunk), max(begin, state["position"])]
            cuts = cuts if len(cuts) > 1 else [cuts[0], cuts[0]]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                last = k == len(cuts) - 2
                out.append(Chunk(name, state["path"], begin, state["position"], a, b, state if last else None, last and close))
        return out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        yield from pieces(partition)

    def commit(self, end: dict) -> None:
        pass


def lines_between(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the chunk, the last of them read to its end."""
    if chunk.first >= chunk.last:
        return
    system, _ = file_system(chunk.path)
    with system.open_input_file(chunk.path) as data:
        at, held, skip = chunk.first, b"", chunk.first > chunk.begin
        if skip:  # the line that goes over the border is the chunk's before
            at -= 1
        read = at
        while True:
            k = held.find(b"\n")
            while k < 0 and read < chunk.end:
                part = data.read_at(min(1 << 20, chunk.end - read), read)
                if not part:
                    break
                read += len(part)
                was = len(held)
                held += part
                k = held.find(b"\n", was)
            if k < 0:
                if held and not skip and at < chunk.last:
                    yield at, held
                return
            line, held = held[:k], held[k + 1 :]
            if not skip:
                if at >= chunk.last:
                    return
                yield at, line
            skip = False
            at += k + 1


def pieces(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, current, began, kind = 0, [], chunk.first, "rest"
    nothing = (None,) * 5

    def take(kind: str) -> None:
        slot = chunk.first if kind == "entry" else EDGE
        rows.append((chunk.id, slot, kind, chunk.path, began, current, *nothing))

    for at, line in lines_between(chunk):
        if _START.match(line):
            if current:
                take("entry" if kind == "open" else kind)
            current, began, kind = [], at, "open"
        current.append(line.decode("utf-8", "replace").removesuffix("\r"))
        size += len(line) + 1
        if size >= _BATCH:
            if kind == "rest":
                take(kind)
                current, began = [], at + len(line) + 1
            yield _batch(rows)
            rows, size = [], 0
    if current:
        take(kind)
    if chunk.close:
        rows.append((chunk.id, EDGE, "close", chunk.path, chunk.end, None, *nothing))
    if chunk.mark is not None:
        m = chunk.mark
        rows.append((chunk.id, EDGE, "mark", chunk.path, chunk.end, None, m["position"], m["device"], m["inode"], m["size"], m["modified"]))
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return PIECES

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)
