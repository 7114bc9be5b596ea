"""A run by its settings: logs followed into a store, and what the store exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lines import parse_interval
from ..operators import groups as g
from ..operators import state as st
from ..operators.config import Settings
from ..sources import export as ex
from ..sources.backends import CompositeBackend, MetricsBackend, OtlpBackend, TableBackend, TextBackend
from ..sources.captures import sampled
from . import commits, tail

_BACKENDS = {"text": TextBackend, "table": TableBackend, "otlp": OtlpBackend}


def kept(executions: DataFrame, settings: Settings) -> DataFrame:
    """The executions that the settings' filters leave: by database, by patterns in the normal form, and by the sample."""
    if settings.include_databases:
        executions = executions.filter(F.col("database").isin(*settings.include_databases))
    if settings.exclude_databases:
        executions = executions.filter(F.coalesce(~F.col("database").isin(*settings.exclude_databases), F.lit(True)))
    for pattern in settings.exclude_query_patterns:
        executions = executions.filter(~F.col("normalized_query").rlike(pattern))
    return executions.filter(sampled(settings.sample_rate, "file", "entry")) if settings.sample_rate < 1 else executions


def follow(spark: SparkSession, path: str, store: str, checkpoint: str, settings: Settings, once: bool = False, flush: bool = False) -> StreamingQuery:
    """Follows logs into a store as the settings say: every poll_interval, or once over what is there."""
    settings.validate()
    return tail.follow_logs(
        spark, path, store, checkpoint, settings.log_line_prefix, settings.slo_threshold_ms, every=None if once else f"{parse_interval(settings.poll_interval)} seconds", flush=flush,
        chunk_bytes=min(settings.max_read_bytes_per_cycle, 32 << 20), keep=lambda rows: kept(rows, settings), max_entry_bytes=settings.max_entry_bytes, max_line_bytes=settings.max_line_bytes,
    )


def exported(spark: SparkSession, store: str, settings: Settings, now: Column) -> DataFrame:
    """(family, labels, value) of the store's groups: those seen within retain_days, the max_query_cardinality seen last, whose fastest
    execution took min_duration_ms."""
    states = commits.states_of(spark, store)
    if states is None:
        return spark.createDataFrame([], "family string, labels string, value double")
    states = states.filter(F.col("last_seen") >= now.cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(settings.retain_days)))
    states = states.orderBy(F.desc("last_seen"), "fingerprint", "database").limit(settings.max_query_cardinality)
    if settings.min_duration_ms is not None:
        states = states.filter(F.col("min_ms") >= settings.min_duration_ms)
    plain = st.as_table(states)
    return ex.metric_families(g.statements_summary(plain), g.cumulative_buckets(plain))


def publish(families: DataFrame, settings: Settings, folder: str) -> dict[str, str]:
    """Writes families to each of the settings' backends, below a folder; what became of each."""
    backends: dict[str, MetricsBackend] = {name: _BACKENDS[name](f"{folder}/{name}") for name in settings.backends}
    every = CompositeBackend(backends)
    every.write(families)
    return every.outcomes
