"""Statistics of executions grouped by statement fingerprint and database.

Input rows are executions: seq (parse order), ts, duration_ms, fingerprint, database. All functions are plain
DataFrame expressions: map-side combined aggregates, no Python on the executors. Sums are kept as decimals, so they
don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BAND_BASE, banded, quantile_aggregates, with_picks

GROUP = ("fingerprint", "database")
# Upper bounds of the latency buckets in seconds; one more bucket takes the rest.
LATENCY_BOUNDS = (0.001, 0.01, 0.1, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)
PERCENTILES = (0.25, 0.5, 0.9, 0.95, 0.99)


def total(column: Column | str) -> Column:
    """Order-independent sum of a money-like double."""
    return F.sum(F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")).cast("double")


def sample_stddev(column: str) -> Column:
    """Sample standard deviation; 0 for a single row."""
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def group_stats(executions: DataFrame, by: tuple[str, ...] = GROUP, representative: bool = False, counts: dict[str, str] | None = None) -> DataFrame:
    """Calls, total, mean, sample deviation, extremes, exact interpolated percentiles and time range of each group; with
    `representative` also the `seq` of its slowest execution, of equals the last. `counts` are SQL conditions on a duration `v`; each gives
    a column of how many executions meet it.

    One scan: everything comes from the counts of distinct durations, gathered in bands of nearly equal ones (series.banded).
    The deviation is put together from the bands' own, so large means with small deviations keep their digits.
    """
    aggs, shown = quantile_aggregates(PERCENTILES, False)
    also = [
        ("min(ts) as t0", "min(t0) as t0"), ("max(ts) as t1", "max(t1) as t1"), (None, "sum(cast(v as decimal(18,2)) * cast(c as decimal(18,0))) as s"), (None, "min(v) as v0"), (None, "max(v) as v1"),
    ]
    counts = counts or {}
    also += [(None, f"sum(case when {met} then c else 0 end) as `{name}`") for name, met in counts.items()]
    if representative:
        also.append(("max(seq) as q", "max(struct(v, q)) as r"))
    placed = with_picks(banded(executions, "duration_ms", by, tuple(also)), by, PERCENTILES, False)
    around = f"s2 - s1 * s1 / n + n * pow({BAND_BASE} + s1 / n - mean, 2)"
    out = placed.groupBy(*by).agg(
        *map(F.expr, (
            "sum(c) as calls", "cast(sum(s) as double) as total_ms", "min(v0) as min_ms", "max(v1) as max_ms", f"sum(case when n > 0 then greatest({around}, 0.0D) end) as _m2", "max(total) as _n",
            "min(t0) as first_ts", "max(t1) as last_ts", *[f"sum(`{name}`) as `{name}`" for name in counts], *(["max(r) as _r"] if representative else []),
        )), *aggs,
    )
    return out.selectExpr(
        *[f"`{k}`" for k in by], "calls", "total_ms", "min_ms", "max_ms", "round(case when _n > 1 then sqrt(_m2 / (_n - 1)) else 0.0D end, 6) as stddev_ms", "first_ts", "last_ts", "round(total_ms / calls, 6) as mean_ms",
        *[f"round({q}, 6) as p{round(p * 100)}_ms" for p, q in zip(PERCENTILES, shown, strict=True)], *[f"`{name}`" for name in counts], *(["_r.q as seq"] if representative else []),
    )


def hourly_histogram(executions: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Calls, total, extremes and mean of each group and UTC hour."""
    d = "duration_ms"
    out = executions.groupBy(*by, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"))
    out = out.agg(F.count("*").alias("calls"), total(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))
    return out.withColumn("mean_ms", F.round(F.col("total_ms") / F.col("calls"), 6))


def latency_bucket(duration_ms: Column | str) -> Column:
    """Number of the first bound that the duration doesn't exceed; the number of bounds if it exceeds all."""
    seconds = (F.col(duration_ms) if isinstance(duration_ms, str) else duration_ms) / 1000.0
    out = F.when(seconds <= LATENCY_BOUNDS[0], 0)
    for i, bound in enumerate(LATENCY_BOUNDS[1:], 1):
        out = out.when(seconds <= bound, i)
    return out.otherwise(len(LATENCY_BOUNDS)).cast("int")


def bucket_counts(executions: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """latency_buckets: an array with one count a bucket, for each group."""
    b = latency_bucket("duration_ms")
    counts = [F.count_if(b == i) for i in range(len(LATENCY_BOUNDS) + 1)]
    return executions.groupBy(*by).agg(F.array(*counts).alias("latency_buckets"))


def add_bucket_arrays(a: Column, b: Column) -> Column:
    """Element-wise sum; a null side yields the other."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: x + y), a, b)


def bucket_bound(i: Column) -> Column:
    """Upper bound in seconds of bucket i (from 0); infinity for the last."""
    out = F.when(i == 0, LATENCY_BOUNDS[0])
    for k, bound in enumerate(LATENCY_BOUNDS[1:], 1):
        out = out.when(i == k, bound)
    return out.otherwise(float("inf"))


def bucket_conditions() -> list[str]:
    """For each bucket, in SQL, whether a duration v falls into it; an unknown one counts as above all bounds."""
    above = [f"v / 1000.0D > {lo}D" for lo in LATENCY_BOUNDS]
    upto = [f"v / 1000.0D <= {hi}D" for hi in LATENCY_BOUNDS]
    return [upto[0], *[f"{a} and {u}" for a, u in zip(above, upto[1:], strict=False)], f"coalesce({above[-1]}, true)"]


def cumulative_buckets(counts: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """One row a bucket with its bound and the count up to it."""
    rows = counts.select(*by, F.posexplode("latency_buckets").alias("i", "n"))
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, bucket_bound(F.col("i")).alias("le"), F.sum("n").over(w).alias("count"))


def minute_window(executions: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Calls, total and latency buckets of each group and minute."""
    b = latency_bucket("duration_ms")
    counts = [F.count_if(b == i) for i in range(len(LATENCY_BOUNDS) + 1)]
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    return executions.groupBy(*by, minute).agg(F.count("*").alias("calls"), total("duration_ms").alias("total_ms"), F.array(*counts).alias("latency_buckets"))


def recent_metrics(minutes: DataFrame, now: Column | None = None, keep_minutes: int = 15, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Throughput and upper-bound percentiles of each group over the last minutes before `now` (by default the last minute seen)."""
    last = minutes.agg(F.max("minute").alias("_now")) if now is None else minutes.sparkSession.range(1).select(now.cast("timestamp_ntz").alias("_now"))
    rows = minutes.join(F.broadcast(last)).filter(F.col("minute") >= F.col("_now") - F.make_dt_interval(mins=F.lit(keep_minutes)))  # one row
    sums = [F.sum(F.col("latency_buckets")[i]) for i in range(len(LATENCY_BOUNDS) + 1)]
    out = rows.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum(F.col("total_ms").cast("decimal(18,2)")).cast("double").alias("_t"), F.min("minute").alias("_first"), F.max("_now").alias("_now"), F.array(*sums).alias("_b"))
    age = F.unix_timestamp(F.col("_now").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp"))
    out = out.withColumn("total_seconds", F.round(F.col("_t") / 1000, 6)).withColumn("calls_per_second", F.round(F.col("calls") / F.greatest(age, F.lit(60)), 6))
    running = F.transform("_b", lambda x, i: F.aggregate(F.slice(F.col("_b"), 1, i + 1), F.lit(0).cast("bigint"), lambda a, v: a + v))
    out = out.withColumn("_c", running)
    for p in (50, 95, 99):
        needed = F.col("calls") * p
        first = F.size(F.filter("_c", lambda c: c * 100 < needed))
        out = out.withColumn(f"p{p}_le_seconds", bucket_bound(first))
    return out.drop("_t", "_first", "_now", "_b", "_c")


def slo_breaches(executions: DataFrame, threshold_ms: float, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Executions strictly above the objective; none if it isn't positive."""
    hit = F.col("duration_ms") > threshold_ms if threshold_ms > 0 else F.lit(False)
    return executions.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(hit).alias("slo_breaches"))


def slow_counts(executions: DataFrame, thresholds_ms: tuple[float, ...], by: tuple[str, ...] = GROUP) -> DataFrame:
    """Executions at or above each threshold, one row a threshold; one pass over the executions."""
    counted = executions.groupBy(*by).agg(*[F.count_if(F.col("duration_ms") >= t).alias(f"_{i}") for i, t in enumerate(thresholds_ms)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold_ms"), F.col(f"_{i}").alias("slow_calls")) for i, t in enumerate(thresholds_ms)])
    return counted.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def derived(stats: DataFrame) -> DataFrame:
    """Coefficient of variation and share of the total time. The grand total is one row."""
    grand = stats.agg(F.sum(F.col("total_ms").cast("decimal(18,2)")).cast("double").alias("_g"))
    out = stats.join(F.broadcast(grand))  # one row
    cv = F.when(F.col("mean_ms") == 0, 0.0).otherwise(F.round(F.col("stddev_ms") / F.col("mean_ms"), 6))
    share = F.when(F.col("_g") == 0, 0.0).otherwise(F.round(F.col("total_ms") * 100 / F.col("_g"), 6))
    return out.withColumn("cv", cv).withColumn("share_pct", share).drop("_g")


def representatives(executions: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The slowest execution of each group; of equals the last in parse order."""
    out = executions.groupBy(*by).agg(F.max(F.struct("duration_ms", "seq", "ts")).alias("r"))
    return out.select(*by, F.col("r.seq").alias("seq"), F.col("r.ts").alias("ts"), F.col("r.duration_ms").alias("duration_ms"))


def statements_summary(state: DataFrame) -> DataFrame:
    """Derived columns of the cumulative store: mean, population deviation, variation, and the share of objective breaches (a fraction)."""
    mean = F.try_divide("total_ms", "calls")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("sum_sq_ms", "calls") - mean * mean))
    return state.select(
        *GROUP, "calls", "total_ms", F.round(mean, 6).alias("mean_ms"), "min_ms", "max_ms", F.round(sd, 4).alias("stddev_ms"),
        F.round(F.try_divide(sd, mean), 6).alias("cv"), "slo_breaches", F.round(F.try_divide(F.col("slo_breaches").cast("double"), F.col("calls")), 6).alias("slo_breach_pct"),
    )


def timeline(hourly: DataFrame, width: int, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Calls of every hour from a group's first to its last, gaps as 0, gathered into at most `width` bars.

    A bar covers ceil(hours / width) hours and is labelled with its middle hour.
    """
    span = hourly.groupBy(*by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    hours = span.select(*by, "lo", "hi", F.posexplode(F.sequence(F.col("lo"), F.col("hi"), F.expr("interval 1 hour"))).alias("i", "bucket"))
    n = (F.unix_timestamp(F.col("hi").cast("timestamp")) - F.unix_timestamp(F.col("lo").cast("timestamp"))) / 3600 + 1
    hours = hours.withColumn("size", F.ceil(n / width).cast("int")).withColumn("bar", F.floor(F.col("i") / F.col("size")).cast("int"))
    filled = hours.join(hourly.select(*by, "bucket", "calls"), [*by, "bucket"], "left")
    out = filled.groupBy(*by, "bar").agg(F.sum(F.coalesce("calls", F.lit(0))).alias("calls"), F.count("*").alias("hours"), F.min("bucket").alias("first"))
    label = (F.col("first").cast("timestamp") + F.make_dt_interval(hours=F.floor(F.col("hours") / 2).cast("int"))).cast("timestamp_ntz")
    return out.select(*by, "bar", label.alias("label"), "calls")


def islands(hourly: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Runs of consecutive hours with calls: begin, end, hours and calls of each."""
    w = Window.partitionBy(*by).orderBy("bucket")
    hour = F.floor(F.unix_timestamp(F.col("bucket").cast("timestamp")) / 3600)
    runs = hourly.withColumn("_run", hour - F.row_number().over(w))
    out = runs.groupBy(*by, "_run").agg(F.min("bucket").alias("begin"), F.max("bucket").alias("end"), F.count("*").alias("hours"), F.sum("calls").alias("calls"))
    return out.drop("_run")


def sort_groups(stats: DataFrame, key: str = "calls", descending: bool = True) -> DataFrame:
    """By one statistic; ties by fingerprint and database, always ascending."""
    return stats.orderBy(F.desc(key) if descending else F.asc(key), F.asc("fingerprint"), F.asc_nulls_first("database"))


def top_groups(stats: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest by one statistic (all for n = 0), as a top-k: tasks keep n rows each before the merge."""
    out = sort_groups(stats, key)
    return out.limit(n) if n > 0 else out


def first_executions(executions: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first n executions in parse order, of all or of each group; tasks keep n of each before the exchange."""
    if not by:
        return executions.orderBy("seq").limit(n)
    w = Window.partitionBy(*by).orderBy("seq")
    return executions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def in_window(executions: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Executions of a time range; both ends are inclusive and optional, and reach the scan."""
    if since is not None:
        executions = executions.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        executions = executions.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return executions


def keep_groups(stats: DataFrame, min_duration_ms: float | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_patterns: tuple[str, ...] = ()) -> DataFrame:
    """Groups to report. The duration filter tests the group's fastest run, as that is the documented behaviour."""
    if min_duration_ms is not None:
        stats = stats.filter(F.col("min_ms") >= min_duration_ms)
    if include:
        stats = stats.filter(F.col("database").isin(*include))
    if exclude:
        stats = stats.filter(F.coalesce(~F.col("database").isin(*exclude), F.lit(True)))
    for pattern in exclude_patterns:
        stats = stats.filter(~F.col("fingerprint").rlike(pattern))
    return stats


def most_recent_groups(executions: DataFrame, cap: int) -> DataFrame:
    """The `cap` fingerprints touched last (bounded series cardinality)."""
    last = executions.groupBy("fingerprint", "database").agg(F.max(F.struct("ts", "seq")).alias("last"))
    return last.orderBy(F.desc("last"), "fingerprint", "database").limit(cap).select("fingerprint", "database", F.col("last.ts").alias("last_ts"))


def evicted_groups(executions: DataFrame, cap: int) -> DataFrame:
    """The groups that the cap pushes out: all groups minus the kept ones, an anti join."""
    everything = executions.select("fingerprint", "database").distinct()
    return everything.join(most_recent_groups(executions, cap), ["fingerprint", "database"], "left_anti")
