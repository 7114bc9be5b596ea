"""Views of the test tables as executions, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import deal_by_size, ship_package


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return deal_by_size(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as executions; the duration also slowed to seconds (slow_ms) and drifting (drift_ms)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("duration_ms"), F.col("event_type").alias("fingerprint"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("database"), (F.col("value") * 1000).alias("slow_ms"),
        (F.col("value") * (1 + F.col("event_id") / 10000.0)).alias("drift_ms"),
    )


E = """e as (select event_id as seq, ts, value as duration_ms, event_type as fingerprint, 'db' || cast(user_id % 3 as varchar) as database,
    value * 1000 as slow_ms, value * (1 + event_id / 10000.0::double) as drift_ms from events)"""

#: Ranked drifting series in SQL: y, rn, n, with the running sum.
R = E + """, r as (select fingerprint, seq, ts, drift_ms as y, row_number() over (partition by fingerprint order by ts, seq) as rn,
    count(*) over (partition by fingerprint) as n from e)"""
