"""The export document: groups with statistics, histogram and a sample of executions as versioned JSON, and back."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups as g
from ..session import stored

VERSION = 3
SAMPLE = 100
_ROW = (
    "fingerprint string, database string, normalized_query string, original_query string, plan string, calls long, total_ms double, mean_ms double, min_ms double, max_ms double, stddev_ms double, "
    "histogram array<struct<hour:string,calls:bigint,total_ms:double>>, sample array<double>"
)


def looks_parameterised(sql: Column | str) -> Column:
    return (F.col(sql) if isinstance(sql, str) else sql).rlike(r"\$[0-9]")


def redact(rows: DataFrame) -> DataFrame:
    """Blanks what may hold literals: original text and plan always, the normal form unless it has placeholders."""
    blank = F.lit("")
    return rows.withColumns({"original_query": blank, "plan": blank, "normalized_query": F.when(looks_parameterised("normalized_query"), F.col("normalized_query")).otherwise(blank)})


def export_rows(executions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row a group, by total time descending, fingerprint and database. `texts` may give normalized_query, original_query and plan."""
    by = list(g.GROUP)
    hours = g.hourly_histogram(executions).withColumn("hour", F.date_format("bucket", "yyyy-MM-dd'T'HH:00:00'Z'"))
    hours = hours.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("hour", "calls", "total_ms"))).alias("histogram"))
    sample = g.first_executions(executions, SAMPLE, g.GROUP).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "duration_ms"))), lambda x: x.duration_ms).alias("sample"))
    out = g.group_stats(executions).join(hours, by).join(sample, by)
    if texts is not None:
        out = out.join(texts, by, "left")
    for c in ("normalized_query", "original_query", "plan"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(""))) if c in out.columns else out.withColumn(c, F.lit(""))
    names = [x.split()[0] for x in _ROW.split(", ")]
    return out.select(*names).orderBy(F.desc("total_ms"), "fingerprint", F.asc_nulls_first("database"))


def write_export(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in a folder, with the version in each; written by the executors."""
    rows.withColumn("format_version", F.lit(VERSION)).write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export; a version above ours is an error, a missing one counts as 1."""
    rows = spark.read.schema(_ROW + ", format_version int").json(path)
    newest = rows.agg(F.max(F.coalesce("format_version", F.lit(1)))).first()[0]
    if newest and newest > VERSION:
        raise ValueError(f"format version {newest} is newer than {VERSION}")
    return rows.drop("format_version")


def write_document(rows: DataFrame, path: str, source_files: list[str] | None = None, most: int = 100_000) -> None:
    """A single JSON document for small exports, put together on the driver; more than `most` groups are an error."""
    found = rows.limit(most + 1).toJSON().collect()
    if len(found) > most:
        raise ValueError(f"more than {most} groups: use write_export")
    Path(path).write_text(json.dumps({"format_version": VERSION, "source_files": source_files or [], "queries": [json.loads(x) for x in found]}, indent=1))


def histogram_rows(rows: DataFrame) -> DataFrame:
    """The hourly histogram of exported rows; hours that can't be read are dropped."""
    out = rows.select("fingerprint", "database", F.explode("histogram").alias("h"))
    bucket = F.try_to_timestamp("h.hour", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")
    return out.select("fingerprint", "database", bucket.alias("bucket"), "h.calls", "h.total_ms").filter("bucket is not null")


def metric_families(stats: DataFrame, buckets: DataFrame, namespace: str = "tracewell") -> DataFrame:
    """(family, labels, value) for a scrape: counters and gauges of each group, and its cumulative latency buckets."""
    label = F.concat(F.lit('{query_hash="'), F.col("fingerprint"), F.lit('",database="'), F.coalesce("database", F.lit("unknown")), F.lit('"}'))
    pairs = (("calls_total", "calls"), ("duration_seconds_total", "total_ms"), ("duration_mean_seconds", "mean_ms"), ("duration_max_seconds", "max_ms"), ("duration_min_seconds", "min_ms"))
    values = F.array(*[F.struct(F.lit(f"{namespace}_{n}").alias("family"), (F.col(c) / (1 if c == "calls" else 1000)).cast("double").alias("value")) for n, c in pairs])
    rows = stats.select(label.alias("labels"), F.explode(values).alias("v")).select("v.family", "labels", F.round("v.value", 9).alias("value"))
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    lines = buckets.select(F.lit(f"{namespace}_duration_seconds_bucket").alias("family"), F.regexp_replace(label, r"\}$", F.concat(F.lit(',le="'), le, F.lit('"}'))).alias("labels"), F.col("count").cast("double").alias("value"))
    return rows.unionByName(lines)


#: Thresholds in seconds above which executions count as slow, and bounds of the histogram of plan costs.
SLOW_SECONDS = (1.0, 5.0, 10.0, 30.0)
COST_BOUNDS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)


def _labels(**pairs: Column) -> Column:
    parts = [F.concat(F.lit(f'{k}="'), F.coalesce(v.cast("string"), F.lit("unknown")), F.lit('"')) for k, v in pairs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _bound(le: Column) -> Column:
    return F.when(le == float("inf"), "+Inf").otherwise(F.regexp_replace(le.cast("string"), r"\.0$", ""))


def query_families(executions: DataFrame, namespace: str = "tracewell") -> DataFrame:
    """(family, labels, value) of each statement group: executions, the duration histogram with sum and count, variation,
    share of the total time, high percentiles, first and last time; and slow executions of each database and threshold."""
    own = {"query_hash": F.col("fingerprint"), "database": F.col("database")}
    counts = {f"_b{i}": met for i, met in enumerate(g.bucket_conditions())} | {f"_s{i}": f"v >= {1000.0 * x}D" for i, x in enumerate(SLOW_SECONDS)}
    groups = stored(g.group_stats(executions, counts=counts))  # one row a group, read by each family
    stats = g.derived(groups)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    pairs = {
        "query_duration_seconds_sum": F.col("total_ms") / 1000, "query_duration_seconds_count": F.col("calls"), "query_latency_cv": F.col("cv"), "query_total_time_share_pct": F.col("share_pct"),
        "query_latency_p95_ms": F.col("p95_ms"), "query_latency_p99_ms": F.col("p99_ms"), "query_first_seen_seconds": seconds("first_ts"), "query_last_seen_seconds": seconds("last_ts"),
    }
    rows = stats.select("calls", *own.values(), F.explode(F.array(*[F.struct(F.lit(f"{namespace}_{n}").alias("family"), c.cast("double").alias("value")) for n, c in pairs.items()])).alias("v"))
    out = rows.select("v.family", _labels(**own).alias("labels"), "v.value")
    out = out.unionByName(stats.select(F.lit(f"{namespace}_query_executions_total").alias("family"), _labels(**own, status=F.lit("success")).alias("labels"), F.col("calls").cast("double").alias("value")))
    buckets = g.cumulative_buckets(groups.withColumn("latency_buckets", F.array(*[F.col(c) for c in counts if c.startswith("_b")])))
    out = out.unionByName(buckets.select(F.lit(f"{namespace}_query_duration_seconds_bucket").alias("family"), _labels(**own, le=_bound(F.col("le"))).alias("labels"), F.col("count").cast("double").alias("value")))
    each = F.array(*[F.struct(F.lit(1000.0 * x).alias("threshold_ms"), F.col(f"_s{i}").alias("n")) for i, x in enumerate(SLOW_SECONDS)])
    slow = groups.select("database", F.explode(each).alias("r")).groupBy("database", "r.threshold_ms").agg(F.sum("r.n").alias("slow_calls"))
    threshold = F.concat(_bound(F.col("threshold_ms") / 1000), F.lit("s"))
    return out.unionByName(slow.select(F.lit(f"{namespace}_slow_queries_total").alias("family"), _labels(database=F.col("database"), threshold=threshold).alias("labels"), F.col("slow_calls").cast("double").alias("value")))


def plan_families(nodes: DataFrame, namespace: str = "tracewell") -> DataFrame:
    """(family, labels, value) of plan nodes with fingerprint and database: the histogram of root costs of each group, and
    scans and joins of each kind and database; both nested loops count as nested_loop."""
    own = {"query_hash": F.col("fingerprint"), "database": F.col("database")}
    roots = nodes.filter("depth = 0")
    le = F.array(*[F.lit(b) for b in (*COST_BOUNDS, float("inf"))])
    costs = roots.select("fingerprint", "database", "total_cost", F.explode(le).alias("le")).groupBy("fingerprint", "database", "le").agg(F.count_if(F.col("total_cost") <= F.col("le")).cast("double").alias("value"))
    out = costs.select(F.lit(f"{namespace}_query_plan_cost_bucket").alias("family"), _labels(**own, le=_bound(F.col("le"))).alias("labels"), "value")
    snake = F.lower(F.regexp_replace(F.when(F.col("kind").startswith("NestedLoop"), "NestedLoop").otherwise(F.col("kind")), "(?<=[a-z])(?=[A-Z])", "_"))
    for category in ("scan", "join"):
        kinds = nodes.filter(F.col("category") == category).groupBy(snake.alias("k"), "database").agg(F.count("*").cast("double").alias("value"))
        out = out.unionByName(kinds.select(F.lit(f"{namespace}_query_{category}_types_total").alias("family"), _labels(**{f"{category}_type": F.col("k"), "database": F.col("database")}).alias("labels"), "value"))
    return out


def run_families(runs: DataFrame, namespace: str = "tracewell") -> DataFrame:
    """(family, labels, value) of parse runs (pattern, status, error_type, seconds, ended): files parsed, errors by type,
    seconds spent, when one last succeeded, and whether the last run did."""
    name = lambda n: F.lit(f"{namespace}_{n}").alias("family")
    one = lambda c: c.cast("double").alias("value")
    parsed = runs.groupBy("pattern", "status").agg(one(F.count("*"))).select(name("logs_parsed_total"), _labels(log_path_pattern=F.col("pattern"), status=F.col("status")).alias("labels"), "value")
    errors = runs.filter("error_type is not null").groupBy("pattern", "error_type").agg(one(F.count("*"))).select(name("parse_errors_total"), _labels(log_path_pattern=F.col("pattern"), error_type=F.col("error_type")).alias("labels"), "value")
    spent = runs.agg(one(F.sum(F.col("seconds").cast("decimal(28,6)")))).select(name("export_duration_seconds_sum"), F.lit("").alias("labels"), "value")
    good = F.col("status") == "success"
    last = runs.agg(one(F.max(F.when(good, F.unix_micros(F.col("ended").cast("timestamp")) / 1e6)))).select(name("last_successful_parse_timestamp"), F.lit("").alias("labels"), "value")
    up = runs.agg(one(F.max_by(good.cast("int"), "ended"))).select(name("exporter_up"), F.lit("").alias("labels"), "value")
    return parsed.unionByName(errors).unionByName(spent).unionByName(last).unionByName(up)


def exposition(families: DataFrame) -> DataFrame:
    """Lines of the text format, in order."""
    return families.select(F.concat("family", "labels", F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("line")
