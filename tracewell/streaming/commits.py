"""A cumulative store whose batches become visible together with the places in the files that they came from.

A commit is a small file in the store's log that names a folder with the batch's states and its files' states. Both are written
before it, so a failure between any two writes leaves nothing visible, and a batch whose key is in the log isn't folded again.
A reset is a commit as well: what came before it no longer counts, of the states alone or of the files too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import state as st

FILES = "id string, path string, position long, device long, inode long, size long, last_modified timestamp_ntz"
_LOG = "number long, key string, kind string, folder string"


@dataclass(frozen=True)
class Commit:
    number: int
    key: str
    kind: str  # fold, compact, reset_states, reset_all
    folder: str | None


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, store: str) -> list[Commit]:
    """The log in order; empty for a store that isn't there yet."""
    path, fs = _fs(spark, f"{store}/log")
    if not fs.exists(path):
        return []
    rows = spark.read.schema(_LOG).json(f"{store}/log").collect()
    return [Commit(*r) for r in sorted(rows, key=lambda r: r.number)]


def _publish(spark: SparkSession, store: str, key: str, kind: str, folder: str | None, after: int | None = None) -> bool:
    """Appends a commit by renaming a finished file to the next number; another writer's number is never overwritten.

    With `after`, only as the one that follows that number: False if others came between.
    """
    while True:
        log = commits(spark, store)
        number = log[-1].number + 1 if log else 0
        if any(c.key == key for c in log) or (after is not None and number != after + 1):
            return False
        temporary, fs = _fs(spark, f"{store}/tmp/{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps({"number": number, "key": key, "kind": kind, "folder": folder}).encode() + b"\n"))
        out.close()
        target, _ = _fs(spark, f"{store}/log/{number:012d}.json")
        fs.mkdirs(target.getParent())
        if not fs.exists(target) and fs.rename(temporary, target):
            return True
        fs.delete(temporary, False)


def has_state(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream has begun with this checkpoint."""
    path, fs = _fs(spark, f"{checkpoint}/offsets")
    return fs.exists(path) and len(fs.listStatus(path)) > 0


def stored(batch: DataFrame, store: str) -> DataFrame:
    """A batch written beside the store, out of its sight, and read back."""
    path = f"{store}/tmp/{uuid.uuid4().hex}"
    batch.write.parquet(path)
    out = batch.sparkSession.read.schema(batch.schema).parquet(path)
    out.stored_at = path
    return out


def drop(kept: DataFrame) -> None:
    path, fs = _fs(kept.sparkSession, kept.stored_at)
    fs.delete(path, True)


def committed(spark: SparkSession, store: str, key: str) -> bool:
    return any(c.key == key for c in commits(spark, store))


def fold(spark: SparkSession, store: str, key: str, states: DataFrame, files: DataFrame, kind: str = "fold", after: int | None = None) -> bool:
    """Writes a batch's states (operators.state) and files (FILES) and publishes both at once; False if the key is there already."""
    if committed(spark, store, key):
        return False
    folder = f"data/{uuid.uuid4().hex}"
    states.write.parquet(f"{store}/{folder}/states")
    files.select(*[c.split()[0] for c in FILES.split(", ")]).write.parquet(f"{store}/{folder}/files")
    return _publish(spark, store, key, kind, folder, after)


def reset(spark: SparkSession, store: str, files: bool = False) -> None:
    """Forgets all states; with `files` also where the files were, so that they are read from their begin."""
    _publish(spark, store, f"reset-{uuid.uuid4().hex}", "reset_all" if files else "reset_states", None)


def _since(log: list[Commit], *ends: str) -> list[Commit]:
    """The commits with data after the last of the kinds given, from the last compaction on."""
    for k in range(len(log) - 1, -1, -1):
        if log[k].kind in ends:
            log = log[k + 1 :]
            break
        if log[k].kind == "compact":
            log = log[k:]
            break
    return [c for c in log if c.folder]


def states_of(spark: SparkSession, store: str) -> DataFrame | None:
    """The merged states since the last reset; None if there are none."""
    live = _since(commits(spark, store), "reset_states", "reset_all")
    return st.merge_states(spark.read.parquet(*[f"{store}/{c.folder}/states" for c in live])) if live else None


def files_of(spark: SparkSession, store: str) -> DataFrame:
    """FILES: the newest state of each file since the last reset of the files."""
    live = _since(commits(spark, store), "reset_all")
    if not live:
        return spark.createDataFrame([], FILES)
    order = F.element_at(F.create_map(*[F.lit(x) for c in live for x in (c.folder.split("/")[1], c.number)]), F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/files/", 1))
    rows = spark.read.schema(FILES).parquet(*[f"{store}/{c.folder}/files" for c in live]).withColumn("_n", order)
    newest = Window.partitionBy("id").orderBy(F.desc("_n"), F.desc("last_modified"))
    return rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_n", "_r")


def offsets_json(files: DataFrame) -> str:
    """The files' states as starting offsets of a new stream."""
    rows = files.withColumn("modified", F.unix_micros(F.col("last_modified").cast("timestamp")) / 1e6).collect()
    keep = ("path", "position", "size", "device", "inode", "modified")
    return json.dumps({r["id"]: {**{k: r[k] for k in keep}, "closed": False} for r in sorted(rows, key=lambda r: r["id"])})


def compact(spark: SparkSession, store: str) -> bool:
    """Puts the merged states and the files' newest states into one commit that stands for all before it.

    False, and nothing changes, if there is nothing to merge or a batch was folded meanwhile.
    """
    log = commits(spark, store)
    states = states_of(spark, store)
    return states is not None and fold(spark, store, f"compact-{log[-1].number}", states, files_of(spark, store), "compact", log[-1].number)


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes folders that no commit names (of batches that failed) or that compaction or resets have outdated; how many."""
    log = commits(spark, store)
    live = {c.folder for c in [*_since(log, "reset_states", "reset_all"), *_since(log, "reset_all")]}
    path, fs = _fs(spark, f"{store}/data")
    gone = [f.getPath() for f in fs.listStatus(path) if f"data/{f.getPath().getName()}" not in live] if fs.exists(path) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
