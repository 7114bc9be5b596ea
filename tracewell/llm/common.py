"""Shared pieces of the training-data operators: scratch tables, splits, slices of batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

#: Text of at most so many bytes, and so many rows, are worked on at once in a Python worker.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 1000

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder within the one that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a local folder serves local sessions (tests); on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="tracewell-"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/tracewell/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the tables that materialize() has written for this application; results that read them must be stored by then."""
    _delete(spark, scratch_dir(spark))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers are used again by other operators, and there are several to an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A map over batches that releases memory at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def trimmed_group(run: Callable[[tuple, pd.DataFrame], pd.DataFrame], rows: int = 1000):
    """A map over groups that releases memory after each large one."""

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = run(key, frame)
        if len(frame) >= rows or frame.memory_usage(deep=True).sum() > 1 << 20:
            del frame
            release()
        return out

    return whole


def digest_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive slices of a string array; nulls become empty."""
    out: list[bytes] = []
    size, first = 0, 0
    for i, value in enumerate(texts.cast(pa.large_binary())):
        value = value.as_py() or b""
        if out and (size + len(value) > max_bytes or len(out) >= max_rows):
            yield first, out
            out, size, first = [], 0, i
        out.append(value)
        size += len(value)
    if out:
        yield first, out


def sample_cuts(rows: DataFrame, group: str, hashed: str, limits: dict) -> dict:
    """For each group the hash up to which it has at most its limit of distinct hashes; groups without limit are left out.

    `rows` has a uniform 64-bit hash. Counts come first; then only hashes below a bound of about twice the limit are
    ranked, so no task sees a whole group.
    """
    rows = rows.filter(F.col(group).isin(list(limits))).select(group, hashed).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    keep, wanted = F.lit(False), F.lit(0)
    for g, n in sorted(counts.items(), key=lambda x: str(x[0])):
        k = limits[g]
        bound = -(1 << 63) + int((1 << 64) * min(1.0, (2 * k + 50) / n)) - 1
        keep = keep | ((F.col(group) == g) & (F.col(hashed) <= bound))
        wanted = F.when(F.col(group) == g, k).otherwise(wanted)
    ranked = rows.filter(keep).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hashed))).filter(F.col("_r") <= wanted)
    return {r[0]: r[1] for r in ranked.groupBy(group).agg(F.max(hashed)).collect()}


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with at least one in HOT_KEYS of all rows, and HOT_ROWS of them, are joined through a table of at most HOT_KEYS rows.
HOT_KEYS, HOT_ROWS = 1000, 500


def numbered(stored: DataFrame, name: str) -> DataFrame:
    """Rows of a stored table with dense numbers from 0 on: the place in a partition, and the rows of those before.

    Only a count for each partition comes to the driver.
    """
    part, place = F.shiftright(F.col("_row"), 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored.withColumn("_row", F.monotonically_increasing_id())
    counts = dict(rows.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, [0] * (max(counts, default=0) + 1)
    for p in sorted(counts):
        offsets[p] = before
        before += counts[p]
    return rows.withColumn(name, place + F.lit(offsets)[part.cast("int")]).drop("_row")


def join_names(rows: DataFrame, names: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined with a table that has each key once, however many rows share a key.

    `counted` (names itself, if none is given) has the number of rows of each key in `n`. Keys with at least one in HOT_KEYS of all
    rows, of which there can be no more than HOT_KEYS, are broadcast; all others meet by a shuffle in which none is large.
    """
    counted = names if counted is None else counted
    total, most = counted.agg(F.sum("n"), F.max("n")).first()
    bound = max((total or 0) // HOT_KEYS, HOT_ROWS)
    names = names.drop("n")
    if (most or 0) < bound:
        return rows.join(names.hint("merge"), keys, how)
    hot = counted.filter(F.col("n") >= bound).select(*keys)  # at most HOT_KEYS rows
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    some = marked.filter("_hot").drop("_hot").join(F.broadcast(names.join(F.broadcast(hot), keys)), keys, how)
    rest = marked.filter("_hot is null").drop("_hot").join(names.hint("merge"), keys, how)
    return some.unionByName(rest)
