"""Logs that grow: entries up to a safe boundary, folded into the cumulative store batch by batch.

`follow_logs` reads files that are still being written (sources.growing), with entries put together across batches.
`fold_logs` takes files as they appear, when they are complete. Where no stream runs, `complete_part` gives the bytes of a file
up to the last entry header; what is held back is read next time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lines import LINE_START
from ..functions.prefix import DEFAULT
from ..operators import groups as g
from ..operators import state as st
from ..sources import logs
from . import assembly, commits

_START = re.compile(LINE_START.encode())
BUDGET, MOST_BUDGET = 64 << 20, 1 << 30


@dataclass(frozen=True)
class Offset:
    """How far a file has been read, and what it was then."""

    position: int = 0
    device: int = 0
    inode: int = 0
    size: int = 0


def is_entry_header(line: bytes) -> bool:
    return bool(_START.match(line)) and b"duration:" in line and b"plan:" in line


def boundary(data: bytes, header: bool = False) -> int:
    """Length of the part before the last complete timestamped line (or entry header); 0 if there is none to hold back."""
    last = at = 0
    for line in data.splitlines(keepends=True):
        if line.endswith(b"\n") and (is_entry_header(line) if header else bool(_START.match(line))):
            last = at
        at += len(line)
    return last


def complete_part(path: str, offset: Offset, budget: int = BUDGET, flush: bool = False) -> tuple[bytes, Offset]:
    """The next safe bytes of a file and where to go on; a file that shrank or was replaced is read from its begin."""
    info = Path(path).stat()
    begin = 0 if info.st_size < offset.position or (offset.inode and (info.st_dev, info.st_ino) != (offset.device, offset.inode)) else offset.position
    with open(path, "rb") as f:
        f.seek(begin)
        data = f.read(budget)
    whole = flush and begin + len(data) >= info.st_size
    n = len(data) if whole else boundary(data)
    return data[:n], Offset(begin + n, info.st_dev, info.st_ino, info.st_size)


def read_budget(stalled: int, base: int = BUDGET) -> int:
    """Doubles with each cycle in which no boundary was found, up to MOST_BUDGET, which an entry can't exceed."""
    return min(base * 2 ** min(stalled, 20), max(base, MOST_BUDGET))


def stale(files: DataFrame, live: DataFrame, cutoff: str) -> DataFrame:
    """Checkpoints to drop: of files that are gone and were last read before the cut-off."""
    return files.join(live, "path", "left_anti").filter(F.col("last_modified") < F.lit(cutoff).cast("timestamp_ntz"))


FILE_STATE = "path string, position long, device long, inode long, size long, last_modified timestamp_ntz, processed long"


def upsert_files(states: DataFrame, news: DataFrame) -> DataFrame:
    """Checkpoints of files (FILE_STATE) with new ones in place of those of the same path; of several new ones the last modified counts."""
    latest = news.groupBy("path").agg(F.max(F.struct("last_modified", "position", *[c for c in news.columns if c not in ("path", "last_modified", "position")])).alias("s"))
    latest = latest.select("path", *[F.col(f"s.{c}").alias(c) for c in news.columns if c != "path"]).select(*states.columns)
    return states.join(latest, "path", "left_anti").select(*states.columns).unionByName(latest)


def file_state(states: DataFrame, path: str) -> DataFrame:
    """The checkpoint of one file, or no row."""
    return states.filter(F.col("path") == path)


def delete_file(states: DataFrame, path: str) -> DataFrame:
    return states.filter(F.col("path") != path)


def cleanup_files(states: DataFrame, cutoff: str) -> DataFrame:
    """Checkpoints of files modified since the cut-off."""
    return states.filter(F.col("last_modified") >= F.lit(cutoff).cast("timestamp_ntz"))


def last_run(states: DataFrame, now: Column) -> DataFrame:
    """One row: when a file was last modified, a day before `now` if there is none."""
    return states.agg(F.coalesce(F.max("last_modified"), now.cast("timestamp_ntz") - F.expr("interval 24 hours")).alias("last_run"))


def save_files(states: DataFrame, store: str, version: int) -> None:
    """Writes checkpoints as one version of the store; the newest complete version counts, so a write that fails changes nothing."""
    states.coalesce(1).write.mode("overwrite").parquet(f"{store}/version={version}")


def load_files(spark: SparkSession, store: str) -> tuple[DataFrame, int]:
    """The newest version of the checkpoints, and its number; none: an empty table and -1."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(base)] if fs.exists(base) else []
    done = [int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], FILE_STATE), -1
    return spark.read.schema(FILE_STATE).parquet(f"{store}/version={max(done)}"), max(done)


def fold_batches(executions: DataFrame, store: str, slo_threshold_ms: float, checkpoint: str) -> StreamingQuery:
    """Runs a stream of executions into a store: one partial state a batch, under its id. Reads with `load_store`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        st.state_rows(batch, slo_threshold_ms, batch_id).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return executions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_logs(spark: SparkSession, path: str, store: str, checkpoint: str, log_line_prefix: str = DEFAULT, slo_threshold_ms: float = 0.0, files_per_batch: int = 100, every: str | None = None) -> StreamingQuery:
    """Runs log files, as they appear under a path or glob, into a store: entries, normal forms and partial states of each batch.

    Once over what is there, or, with `every` (such as "30 seconds"), again and again. A file is read when it is complete
    (rotated); entries don't cross files.
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = logs.executions_of(logs.entries(batch.withColumn("place", F.monotonically_increasing_id()), log_line_prefix))
        st.state_rows(rows, slo_threshold_ms, batch_id).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def follow_logs(
    spark: SparkSession, path: str, store: str, checkpoint: str, log_line_prefix: str = DEFAULT, slo_threshold_ms: float = 0.0, every: str | None = None, flush: bool = False,
    idle_seconds: float | None = None, chunk_bytes: int = 32 << 20, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, max_entry_bytes: int = 0, max_line_bytes: int = 0, **options,
) -> StreamingQuery:
    """Runs logs that are still being written into a store (streaming.commits), each entry once it is complete.

    A batch's states and the places in its files become visible together, and a batch that is replayed changes nothing. A
    new checkpoint over an existing store goes on where the store's files are. Once over what is there, or, with `every` (such
    as "30 seconds"), again and again; `flush` takes the last entries as complete, `idle_seconds` those of files left alone so long.
    `keep` filters the executions; lines and entries are cut at max_line_bytes and max_entry_bytes (0: not).
    """
    start = None if commits.has_state(spark, checkpoint) else commits.offsets_json(commits.files_of(spark, store))
    pieces = assembly.growing_pieces(spark, path, chunkBytes=chunk_bytes, flush=flush, idleSeconds=idle_seconds, startingOffsets=start)

    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/{batch_id}"
        if commits.committed(spark, store, key):
            return
        # entries are put together once; all else reads what is stored
        kept = commits.stored(batch, store)
        texts = logs.limit_lines(kept.filter("l is not null").select("file", "entry", "l"), max_line_bytes, max_entry_bytes)
        rows = keep(logs.executions_of(logs.parsed_entries(texts, log_line_prefix, **options)))
        commits.fold(spark, store, key, st.state_rows(rows, slo_threshold_ms, batch_id), assembly.file_rows(kept))
        commits.drop(kept)

    writer = assembly.assembled_stream(pieces).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def load_store(spark: SparkSession, store: str) -> DataFrame:
    """The merged store."""
    return st.merge_states(spark.read.parquet(store).drop("batch"))


def compact_store(spark: SparkSession, store: str, to: str) -> None:
    """Writes the merged store as one batch elsewhere."""
    load_store(spark, store).write.mode("overwrite").parquet(f"{to}/batch=0")


def minute_stream(executions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls and total of each group and minute as a stream; rows later than the watermark are dropped, as with any finished window."""
    rows = executions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(*g.GROUP, F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("calls"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).alias("total_ms"))
    return out.select(*g.GROUP, F.col("w.start").alias("minute"), "calls", "total_ms")
