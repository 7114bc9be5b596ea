"""What a session needs: this package's code on the executors, batches of moderate size, a folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2000
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it: once a session, through Spark's own file server.

    Rows of text can be long, so Arrow batches left at Spark's default of 10,000 rows are cut to BATCH_ROWS.
    HotSpot never compiles methods of over 8,000 bytecodes, so larger generated ones give way to split projections.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tracewell-code-"), "tracewell.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


#: Bytes of a table's files for each partition that its rows are dealt to.
DEALT_BYTES = 4 << 20
_DEALT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def deal_by_size(rows: DataFrame, times: int = 1) -> DataFrame:
    """Has exchanges of this session begin with as many partitions as a table's files need, so that a task's rows don't grow with it.

    `times` is for tables from which more is made than they hold.
    Adaptive execution puts small ones together again; where the session's own number is enough, nothing changes.
    """
    spark = rows.sparkSession
    needed = -(-times * int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // DEALT_BYTES)
    if needed > int(spark.conf.get(_DEALT, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_DEALT, str(needed))
    return rows


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables, in the one that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a local folder serves local sessions (tests); on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tracewell-"))
        base = _local[0]
    return f"{base.rstrip('/')}/tracewell/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: what follows doesn't work it out again, nor does a lost executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
