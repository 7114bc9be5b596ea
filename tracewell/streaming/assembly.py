"""Entries of growing logs across batches: keyed state holds the entry that each file leaves open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package
from ..sources import growing
from ..sources.growing import EDGE, GrowingLogs

ENTRIES = "file string, entry long, l array<string>, id string, position long, device long, inode long, size long, modified double"
_STATE = "path string, at long, lines string"


def _put_together(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whole entries pass; the pieces at the edges of a file's chunks are joined in order with what the state holds.

    A file's state is its open entry. It ends with the next timestamped line, or when the file is closed. Lines
    before a file's first timestamped one belong to no entry. A mark gives the file's state as of this batch, where a reader
    without this state would have to go on: at the open entry's begin.
    """
    name, slot = key
    out: list[tuple] = []
    none = (None,) * 5
    if slot != EDGE:
        for frame in frames:
            yield _frame([(path, at, list(lines), name, *none) for path, at, lines in zip(frame["path"], frame["at"], frame["lines"], strict=True)])
        return
    path, at, lines = state.get if state.exists else (None, None, None)
    is_open, held = at is not None, [lines] if lines is not None else []
    rank = {"rest": 0, "open": 1, "close": 2, "mark": 3}
    rows = [r for frame in frames for r in frame.itertuples(index=False)]
    for r in sorted(rows, key=lambda r: (r.at if r.kind in ("rest", "open") else float("inf"), rank[r.kind])):
        if r.kind == "rest" and is_open:
            held.extend(r.lines)
        elif r.kind in ("open", "close"):
            if is_open:
                out.append((path, at, "\n".join(held).split("\n"), name, *none))
            is_open = r.kind == "open"
            path, at, held = (r.path, r.at, list(r.lines)) if is_open else (None, None, [])
        elif r.kind == "mark":
            out.append((r.path, None, None, name, at if is_open else r.position, r.device, r.inode, r.size, r.modified))
    if is_open:
        state.update((path, at, "\n".join(held)))
    elif state.exists:
        state.remove()
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])
    return frame.astype({c: "Int64" for c in ("entry", "position", "device", "inode", "size")})


def growing_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of pieces of the logs that a path or glob names (sources.growing); options are the source's.

    The source travels by value: the process that plans its batches doesn't have the files that Spark ships.
    """
    ship_package(spark)
    cloudpickle.register_pickle_by_value(growing)
    spark.dataSource.register(GrowingLogs)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return spark.readStream.format("growing_logs").options(path=path, **given).load()


def assembled_stream(pieces: DataFrame) -> DataFrame:
    """Stream of ENTRIES: the lines of each entry, once, when it is complete; and a row for each file a batch has read (`l` is null)."""
    return pieces.groupBy("id", "slot").applyInPandasWithState(_put_together, ENTRIES, _STATE, "append", GroupStateTimeout.NoTimeout)


def file_rows(batch: DataFrame) -> DataFrame:
    """The files' states that a batch of assembled_stream carries."""
    when = F.timestamp_seconds("modified").cast("timestamp_ntz")
    return batch.filter("l is null").select("id", F.col("file").alias("path"), "position", "device", "inode", "size", when.alias("last_modified"))
