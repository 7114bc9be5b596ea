"""The cumulative store: additive rows of each group that merge in any order, and their upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import GROUP, LATENCY_BOUNDS, latency_bucket

_ADDED = ("calls", "total_ms", "sum_sq_ms", "slo_breaches")


def state_rows(executions: DataFrame, slo_threshold_ms: float = 0.0, batch: int = 0, also: tuple[Column, ...] = ()) -> DataFrame:
    """What one batch adds to the store, for each group, and further aggregates; one pass over the executions."""
    d, bucket = F.col("duration_ms"), latency_bucket("duration_ms")
    breach = d > slo_threshold_ms if slo_threshold_ms > 0 else F.lit(False)
    return executions.groupBy(*GROUP).agg(
        F.count("*").alias("calls"), F.sum(d.cast("decimal(18,2)")).alias("total_ms"), F.sum((d * d).cast("decimal(24,4)")).alias("sum_sq_ms"),
        F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max(F.struct(d.alias("ms"), F.lit(batch).alias("batch"), F.col("seq").alias("seq"))).alias("representative"),
        F.count_if(breach).alias("slo_breaches"), F.array(*[F.count_if(bucket == i) for i in range(len(LATENCY_BOUNDS) + 1)]).alias("latency_buckets"),
        *also,
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """Upsert of several stores: sums, extremes, element-wise bucket sums; on equal maxima the later batch represents."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    buckets = F.array(*[F.sum(F.col("latency_buckets")[i]) for i in range(len(LATENCY_BOUNDS) + 1)])
    return rows.groupBy(*GROUP).agg(
        *[F.sum(c).cast({"total_ms": "decimal(28,2)", "sum_sq_ms": "decimal(34,4)"}.get(c, "bigint")).alias(c) for c in _ADDED],
        F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("representative").alias("representative"), buckets.alias("latency_buckets"),
    )


def as_table(state: DataFrame) -> DataFrame:
    """Plain columns of a store."""
    return state.select(
        *GROUP, "calls", F.col("total_ms").cast("double").alias("total_ms"), F.col("sum_sq_ms").cast("double").alias("sum_sq_ms"), "min_ms", "max_ms", "slo_breaches",
        "first_seen", "last_seen", F.col("representative.seq").alias("representative_seq"), "latency_buckets",
    )


def merge_histograms(*tables: DataFrame) -> DataFrame:
    """Upsert of hourly rows."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    out = rows.groupBy(*GROUP, "bucket").agg(F.sum("calls").alias("calls"), F.sum(F.col("total_ms").cast("decimal(18,2)")).cast("double").alias("total_ms"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))
    return out


def purge_minutes(minutes: DataFrame, keep_minutes: int = 15) -> DataFrame:
    """Drops minutes older than the window before the last one."""
    last = minutes.agg(F.max("minute").alias("_now"))
    return minutes.join(F.broadcast(last)).filter(F.col("minute") >= F.col("_now") - F.make_dt_interval(mins=F.lit(keep_minutes))).drop("_now")  # one row


def seen(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """First and last time each group was seen: the first is kept, the last moves on."""
    now = batch.groupBy(*GROUP).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return previous.select(*GROUP, "first_seen", "last_seen").unionByName(now).groupBy(*GROUP).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def forget(seen_rows: DataFrame, older_than: str) -> DataFrame:
    """Retention: groups last seen before the cut-off go."""
    return seen_rows.filter(F.col("last_seen") >= F.lit(older_than).cast("timestamp_ntz"))


def rekey(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Moves rows to new fingerprints and re-groups them; rows without a mapping stay. `mapping`: fingerprint, new_fingerprint."""
    moved = table.join(mapping, "fingerprint", "left").withColumn("fingerprint", F.coalesce("new_fingerprint", "fingerprint")).drop("new_fingerprint")
    return merge_states(moved)
