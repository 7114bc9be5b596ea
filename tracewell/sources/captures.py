"""Executions captured by the server itself, as rows: time, duration, statement, plan text (may be blank), query id, database.

A capture needs no log around it. Without a plan it still has its statement's normal form, so it joins the same group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import normalize_column
from ..operators.groups import GROUP
from ..operators.state import state_rows
from ..plans.parse import nodes_column

SCHEMA = "ts timestamp_ntz, duration_ms double, query_text string, plan_text string, query_id long, database string"


def sampled(rate: float, *of: Column | str) -> Column:
    """Whether a row is in the sample of this rate: by a digest of `of`, so a rerun takes the same rows, and a larger rate all of a smaller one's."""
    if rate <= 0 or rate >= 1:
        return F.lit(rate >= 1)
    share = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of])), 1, 8), 16, 10)
    return share.cast("double") / float(1 << 32) < rate


def wanted(captures: DataFrame, min_duration_ms: float = 1.0, rate: float = 0.8, first_of_each: bool = False) -> DataFrame:
    """The captures to keep: those of at least the duration that fall into the sample; with first_of_each also the first of
    every query id that isn't 0, as one row a query id joined back."""
    rows = captures.filter(F.col("duration_ms") >= min_duration_ms)
    chosen = sampled(rate, "ts", "query_id", "query_text", "duration_ms")
    if not first_of_each or rate <= 0 or rate >= 1:
        return rows.filter(chosen)
    first = rows.filter("query_id <> 0").groupBy("query_id").agg(F.min(F.struct("ts", "duration_ms", "query_text")).alias("_f"))
    rows = rows.join(first, "query_id", "left")
    return rows.filter(chosen | F.coalesce(F.struct("ts", "duration_ms", "query_text") == F.col("_f"), F.lit(False))).select(*captures.columns)


def captured_executions(captures: DataFrame) -> DataFrame:
    """Captures with normalized_query, fingerprint and nodes; nodes is null for a blank plan, and rows of a plan that can't be read go."""
    blank = F.trim(F.coalesce("plan_text", F.lit(""))) == ""
    rows = captures.withColumn("_n", normalize_column("query_text")).withColumn("nodes", nodes_column(F.when(~blank, F.col("plan_text"))))
    rows = rows.filter(blank | F.col("nodes").isNotNull())
    return rows.withColumns({"normalized_query": F.col("_n.normalized_query"), "fingerprint": F.col("_n.fingerprint")}).drop("_n")


def aggregate_captures(captures: DataFrame, slo_threshold_ms: float = 0.0, batch: int = 0) -> DataFrame:
    """What captures add to the cumulative store, with the normal form of each group and its query id: the first that isn't 0."""
    rows = captured_executions(captures).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    known = F.min(F.when(F.col("query_id") != 0, F.struct("ts", "query_id"))).alias("_id")
    groups = state_rows(rows, slo_threshold_ms, batch, (F.min("normalized_query").alias("normalized_query"), known))
    # a fingerprint has one normal form and, over all its databases, one query id
    first = F.min("_id").over(Window.partitionBy("fingerprint"))
    return groups.withColumn("query_id", F.coalesce(first["query_id"], F.lit(0))).drop("_id")


def with_server_statistics(statements: DataFrame, server: DataFrame) -> DataFrame:
    """Statements of the store beside the server's own counters of the same query id (query_id, calls, total_ms, rows); those without go."""
    theirs = server.select("query_id", *[F.col(c).alias(f"server_{c}") for c in ("calls", "total_ms", "rows")])
    per_call = F.when(F.col("server_calls") > 0, F.col("server_rows") / F.col("server_calls")).otherwise(0.0)
    return statements.filter("query_id <> 0").join(theirs, "query_id").withColumn("rows_per_call", F.round(per_call, 6))


def overhead(captures: DataFrame, column: str = "overhead_ns", *by: str) -> DataFrame:
    """Count, mean, extremes and population deviation of what capturing cost."""
    return captures.groupBy(*by).agg(
        F.count(column).alias("captures"), F.round(F.avg(column), 6).alias("mean_ns"), F.min(column).alias("min_ns"), F.max(column).alias("max_ns"), F.round(F.coalesce(F.stddev_pop(column), F.lit(0.0)), 6).alias("stddev_ns"),
    )


def too_many_groups(executions: DataFrame, limit: int = 50_000) -> DataFrame:
    """One row (groups, too_many): whether there are so many groups that series by fingerprint get costly."""
    return executions.select(*GROUP).distinct().agg(F.count("*").alias("groups")).withColumn("too_many", F.col("groups") >= limit)
