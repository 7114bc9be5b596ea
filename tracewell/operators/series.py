"""Regressions, trends and outliers in the series of durations of each fingerprint.

Rows are put in order by time with `ranked`, whose windows never span more than one hour of one group: the rank of a
row is its place within the hour plus the counts of the hours before. A fingerprint with a third of all rows is so
spread over as many tasks as it has hours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .config import regression_thresholds

KEY = "fingerprint"
# Percent of change that bound the classes, half against half and baseline against the rest.
MINOR, SIGNIFICANT, CRITICAL = 5.0, 20.0, 50.0
BASE_MINOR, BASE_SIGNIFICANT, BASE_CRITICAL = 10.0, 25.0, 50.0


def ranked(executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame:
    """fingerprint, seq, ts, y, rn (from 1 by ts, seq), n, and the running sum of y as a decimal."""
    rows = executions.select(key, "seq", "ts", F.col(value).alias("y")).withColumn("_h", F.date_trunc("hour", "ts"))
    rows = rows.withColumn("_d", F.col("y").cast("decimal(28,8)"))
    hours = rows.groupBy(key, "_h").agg(F.count("*").alias("_c"), F.sum("_d").alias("_s"))
    before = Window.partitionBy(key).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    hours = hours.select(
        key, "_h", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_c").over(whole).alias("n")
    )
    inner = Window.partitionBy(key, "_h").orderBy("ts", "seq")
    rows = rows.withColumn("_r", F.row_number().over(inner)).withColumn("_i", F.sum("_d").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(hours, [key, "_h"])
    return out.select(key, "seq", "ts", "y", (F.col("_r") + F.col("_c0")).alias("rn"), "n", (F.col("_i") + F.col("_s0")).alias("cum"))


def _mean_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("y").cast("decimal(28,8)"))).cast("double") / F.count_if(condition)


def _half_aggregates() -> list[Column]:
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    return [F.max("n").alias("n"), _mean_where(first).alias("_first"), _mean_where(~first).alias("_second")]


def _half_change() -> Column:
    return F.when(F.col("_first") > 0, (F.col("_second") - F.col("_first")) / F.col("_first") * 100).otherwise(0.0)


def halves(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Means of the first and second half of each ranked series, and the change in percent (0 for a zero baseline)."""
    out = rows.groupBy(key).agg(*_half_aggregates())
    return out.select(key, "n", F.round("_first", 6).alias("first_ms"), F.round("_second", 6).alias("second_ms"), F.round(_half_change(), 6).alias("change_pct"))


def basic_status(change_pct: Column) -> Column:
    """Status of the half-against-half comparison; improvements are no regression."""
    return F.when(change_pct <= MINOR, "None").when(change_pct <= SIGNIFICANT, "Minor").when(change_pct <= CRITICAL, "Significant").when(change_pct > CRITICAL, "Critical").otherwise("None")


def basic_regression(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Half-against-half regression of series of at least 3 points."""
    out = halves(rows, key).filter("n >= 3")
    return out.withColumn("status", basic_status(F.col("change_pct")))


def _trend_aggregates() -> list[Column]:
    """Besides those of the halves."""
    return [F.abs(F.coalesce(F.stddev_samp("y"), F.lit(0.0)) / F.avg("y")).alias("_cv"), F.coalesce(F.regr_r2("y", "rn"), F.lit(0.0)).alias("_r2")]


def _trend_columns() -> list[Column]:
    ratio = (F.col("_second") - F.col("_first")) / F.col("_first")
    name = F.when(F.col("_cv") > 0.5, "Volatile").when(ratio > 0.05, "Degrading").when(ratio < -0.05, "Improving").otherwise("Stable")
    return [name.alias("trend"), F.round(F.least(F.greatest("_r2", F.lit(0.0)), F.lit(1.0)), 6).alias("strength")]


def trend(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Volatile if the variation exceeds one half, else by the halves' means (5 %); strength is R squared of y on the rank."""
    return rows.groupBy(key).agg(*_half_aggregates(), *_trend_aggregates()).select(key, *_trend_columns())


def seasonality(rows: DataFrame, key: str = KEY, least: int = 168, strength: float = 0.2) -> DataFrame:
    """Variation of the means of the hours of day (population deviation), for series of at least `least` points and 4 hours."""
    hours = rows.groupBy(key, F.hour(F.col("ts").cast("timestamp")).alias("h")).agg((F.sum(F.col("y").cast("decimal(28,8)")).cast("double") / F.count("*")).alias("m"), F.count("*").alias("c"))
    out = hours.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("hours"), F.least(F.stddev_pop("m") / F.avg("m"), F.lit(1.0)).alias("s"), F.avg("m").alias("_m"))
    out = out.filter((F.col("n") >= least) & (F.col("hours") >= 4) & (F.col("_m") > 0))
    return out.select(key, "hours", F.round("s", 6).alias("strength"), (F.col("s") > strength).alias("daily"))


def change_points(rows: DataFrame, key: str = KEY, threshold: float = 0.2) -> DataFrame:
    """Points where the mean of the w rows from there on differs from that of the w before by over a fifth, w = n/10 within 5 and 50.

    The window width depends on the group, so frames can't express it: each running sum is sent to the three ranks
    that need it, and one exchange brings them together.
    """
    w = F.least(F.greatest(F.floor(F.col("n") / 10), F.lit(5)), F.lit(50)).cast("int")
    rows = rows.withColumn("w", w)
    # the running sum up to rank r is the end of the window before r + 1, the begin of that of r + w + 1, and the end of the one from r - w + 1 on
    to = F.array(
        F.struct((F.col("rn") + 1).alias("at"), F.lit("mid").alias("k"), F.col("cum"), F.col("ts"), F.lit(False).alias("own")),
        F.struct((F.col("rn") + F.col("w") + 1).alias("at"), F.lit("lo").alias("k"), F.col("cum"), F.col("ts"), F.lit(False).alias("own")),
        F.struct((F.col("rn") - F.col("w") + 1).alias("at"), F.lit("hi").alias("k"), F.col("cum"), F.col("ts"), F.lit(False).alias("own")),
        F.struct(F.col("rn").alias("at"), F.lit("own").alias("k"), F.col("cum"), F.col("ts"), F.lit(True).alias("own")),
    )
    sent = rows.select(key, "n", "w", F.explode(to).alias("r")).select(key, "n", "w", "r.*")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("cum")))
    met = sent.groupBy(key, "at").agg(F.max("n").alias("n"), F.max("w").alias("w"), pick("lo").alias("lo"), pick("mid").alias("mid"), pick("hi").alias("hi"), F.max(F.when(F.col("own"), F.col("ts"))).alias("ts"))
    met = met.filter((F.col("at") > F.col("w")) & (F.col("at") <= F.col("n") - F.col("w")))
    before = (F.col("mid") - F.coalesce("lo", F.lit(0))).cast("double") / F.col("w")
    after = (F.col("hi") - F.col("mid")).cast("double") / F.col("w")
    out = met.withColumn("m", (after - before) / before).filter(F.abs("m") > threshold)
    kind = F.when(F.col("m") > 0, "Degradation").otherwise("Improvement")
    return out.select(key, F.col("at").alias("rn"), "ts", kind.alias("change_type"), F.round(F.abs("m"), 6).alias("magnitude"))


# SQL texts, as building long expressions call by call takes longer than running them.
#: A number that rises with v and is equal only for values within 0.07 percent of each other; and a value of that band, from its number alone.
_BAND = "case when v = 0 then 0 when v > 0 then floor(log2(v) * 1024) + 2097152 else -(floor(log2(-v) * 1024) + 2097152) end"
BAND_BASE = "case when g = 0 then 0.0D when g > 0 then pow(2.0D, (g - 2097152) / 1024.0D) else -pow(2.0D, (-g - 2097152) / 1024.0D) end"


def banded(rows: DataFrame, value: str, keys: tuple[str, ...], also: tuple[tuple[str | None, str], ...] = ()) -> DataFrame:
    """Rows by group and band of nearly equal values (`g`): n, the distinct values with their counts in order (`vals`), sums from
    the band's base (`s1`, `s2`), and further aggregates: pairs in SQL of one over rows (or None) and one over its results, the value `v`
    and its count `c`.

    Equal values are counted before anything is exchanged. Null values are a band of their own, without values.
    """
    first = [F.expr(a[0]) for a in also if a[0] is not None]
    values = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.expr("count(*) as c"), *first).withColumn("g", F.expr(_BAND))
    return values.groupBy(*keys, "g").agg(
        F.expr("sum(c) as c"), F.expr("sum(case when v is not null then c else 0 end) as n"), F.expr(f"sum((v - {BAND_BASE}) * c) as s1"), F.expr(f"sum(pow(v - {BAND_BASE}, 2) * c) as s2"),
        F.expr("sort_array(collect_list(case when v is not null then struct(v, c) end)) as vals"), *[F.expr(a[1]) for a in also],
    )


def with_picks(bands: DataFrame, keys: tuple[str, ...], qs: tuple[float, ...], weibull: bool) -> DataFrame:
    """Bands with the number of values in those before (`b`) and in all (`total`), the group's mean, and `picks`: for each quantile
    the values below and above its position that lie in the band, else null."""
    by = "partition by " + ", ".join(f"`{k}`" for k in keys)
    placed = bands.selectExpr(
        "*", f"sum(n) over ({by} order by g rows between unbounded preceding and current row) - n as b", f"sum(n) over ({by}) as total", f"sum(s1 + n * {BAND_BASE}) over ({by}) / sum(n) over ({by}) as mean",
    )
    ranks = ", ".join(f"cast({f}({_position(q, 'total', weibull)}) as bigint)" for q in qs for f in ("floor", "ceil"))
    nth = """aggregate(vals, named_struct('upto', 0L, 'v', cast(null as double)),
        (a, x) -> named_struct('upto', a.upto + x.c, 'v', case when a.upto <= r - b and r - b < a.upto + x.c then x.v else a.v end), a -> a.v)"""
    return placed.withColumn("picks", F.expr(f"transform(array({ranks}), r -> case when b <= r and r < b + n then {nth} end)")).drop("vals")


def _position(q: float, total: str, weibull: bool) -> str:
    return f"least(greatest({q}D * ({total} + 1) - 1, 0.0D), {total} - 1.0D)" if weibull else f"({q}D * ({total} - 1))"


def quantile_aggregates(qs: tuple[float, ...], weibull: bool) -> tuple[list[Column], list[str]]:
    """Aggregates over a group's bands with picks, and in SQL the quantiles from them and the group's `_n`."""
    aggs = [F.expr(f"max(picks[{i}]) as _q{i}") for i in range(2 * len(qs))]
    at = [_position(q, "_n", weibull) for q in qs]
    return aggs, [f"(_q{2 * i} + (_q{2 * i + 1} - _q{2 * i}) * ({p} - floor({p})))" for i, p in enumerate(at)]


def order_quantiles(rows: DataFrame, qs: tuple[float, ...], value: str, keys: tuple[str, ...], weibull: bool) -> DataFrame:
    """Quantiles of each group by linear interpolation: columns q<percent>, and n. Positions are q (n + 1) - 1, clamped to
    the ends, with `weibull`, else q (n - 1). Null values are left out.

    Equal values are counted first, then bands of nearly equal ones; a group is one row a band when its bands are put in
    order, and only the bands that hold a wanted rank are looked into. One scan, three exchanges, each after a combine.
    """
    aggs, shown = quantile_aggregates(qs, weibull)
    placed = with_picks(banded(rows.filter(F.col(value).isNotNull()), value, keys), keys, qs, weibull)
    out = placed.groupBy(*keys).agg(F.expr("max(total) as _n"), *aggs)
    return out.selectExpr(*[f"`{k}`" for k in keys], "_n as n", *[f"{x} as q{round(q * 100)}" for q, x in zip(qs, shown, strict=True)])


def quantiles_r6(executions: DataFrame, qs: tuple[float, ...], value: str = "duration_ms", key: str = KEY) -> DataFrame:
    """Quantiles at q (n + 1) - 1, clamped to the ends: columns q<percent>."""
    return order_quantiles(executions, qs, value, (key,), True)


def iqr_outliers(executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame:
    """Executions outside the quartiles by more than 1.5 interquartile ranges. The quartiles are one row a fingerprint."""
    q = quantiles_r6(executions, (0.25, 0.75), value, key)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    rows = executions.join(q, key)
    return rows.filter((F.col(value) < F.col("q25") - reach) | (F.col(value) > F.col("q75") + reach)).select(key, "seq", F.col(value).alias("value"))


def modified_z(executions: DataFrame, threshold: float = 3.5, value: str = "duration_ms", key: str = KEY) -> DataFrame:
    """Executions whose 0.6745 (x - median) / MAD exceeds the threshold; none where the MAD is 0."""
    # medians and deviations are one row a group, worked out once
    median = stored(quantiles_r6(executions, (0.5,), value, key).select(key, F.col("q50").alias("med")))
    away = executions.join(median, key).withColumn("_a", F.abs(F.col(value) - F.col("med")))
    mad = stored(quantiles_r6(away.select(key, "_a"), (0.5,), "_a", key).select(key, F.col("q50").alias("mad")).filter("mad > 0"))
    z = F.lit(0.6745) * (F.col(value) - F.col("med")) / F.col("mad")
    out = executions.join(median.join(mad, key), key).withColumn("z", z).filter(F.abs("z") > threshold)
    kind = F.when(F.abs("z") > 4, "Spike").otherwise("Outlier")
    return out.select(key, "seq", F.col(value).alias("value"), F.round("z", 6).alias("z"), kind.alias("kind"))


def _shape_aggregates(value: str) -> list[Column]:
    return [F.count("*").alias("_count"), F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2")]


def _with_shape(out: DataFrame) -> DataFrame:
    n = F.col("_count")
    g1 = F.when(n >= 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    g2 = F.when(n >= 4, (n - 1) * ((n + 1) * F.col("_g2") + 6) / ((n - 2) * (n - 3))).otherwise(0.0)
    jb = F.when(n >= 8, n / 6.0 * (F.col("_g1") * F.col("_g1") + F.col("_g2") * F.col("_g2") / 4))
    return out.withColumns({"skewness": F.round(g1, 6), "kurtosis": F.round(g2, 6), "jarque_bera": F.round(jb, 4), "_jb_p": F.round(F.exp(-jb / 2), 6)})


def distribution(executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame:
    """Mean, sample deviation, adjusted skewness G1 and excess kurtosis G2, Jarque-Bera statistic with its p."""
    out = _with_shape(executions.groupBy(key).agg(*_shape_aggregates(value)))
    return out.select(key, F.col("_count").alias("n"), F.round("_m", 6).alias("mean"), F.round("_s", 6).alias("stddev"), "skewness", "kurtosis", "jarque_bera", F.col("_jb_p").alias("p_value"))


def _split_aggregates() -> list[Column]:
    base = F.col("rn") <= F.floor(F.col("n") * 3 / 4)
    v = lambda c: F.coalesce(F.var_samp(F.when(c, F.col("y"))), F.lit(0.0))
    return [_mean_where(base).alias("_a"), _mean_where(~base).alias("_b"), v(base).alias("_va"), v(~base).alias("_vb"), F.count_if(base).alias("_na"), F.count_if(~base).alias("_nb")]


def _split_columns() -> list[Column]:
    change = (F.col("_b") - F.col("_a")) / F.col("_a") * 100
    sa, sb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
    t = (F.col("_a") - F.col("_b")) / F.sqrt(sa + sb)
    df = (sa + sb) * (sa + sb) / (sa * sa / (F.col("_na") - 1) + sb * sb / (F.col("_nb") - 1))
    severity = F.when(change >= BASE_CRITICAL, "Critical").when(change >= BASE_SIGNIFICANT, "High").when(change > BASE_MINOR, "Medium")
    status = F.when(change >= BASE_CRITICAL, "Critical").when(change > BASE_MINOR, "Significant").otherwise("None")
    return [
        F.round("_a", 6).alias("baseline_ms"), F.round("_b", 6).alias("current_ms"), F.round(change, 6).alias("change_pct"), severity.alias("severity"), status.alias("status"),
        F.round(t, 6).alias("welch_t"), F.round(df, 4).alias("welch_df"),
    ]


def baseline_split(rows: DataFrame, key: str = KEY) -> DataFrame:
    """First three quarters against the rest: means, change, severity of increases, Welch's t and degrees of freedom."""
    return rows.groupBy(key).agg(*_split_aggregates()).select(key, *_split_columns())


def correlation(executions: DataFrame, x: str, y: str, key: str = KEY, level: float = 0.05) -> DataFrame:
    """Pearson correlation (0 for a constant side) of groups of at least 3 with its strength, t, degrees of freedom, two-sided p and significance."""
    r = F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))
    out = executions.groupBy(key).agg(F.count("*").alias("n"), r.alias("_r")).filter("n >= 3")
    a = F.abs("_r")
    name = F.when(a < 0.3, "VeryWeak").when(a < 0.5, "Weak").when(a < 0.7, "Moderate").when(a < 0.9, "Strong").otherwise("VeryStrong")
    df = (F.col("n") - 2).cast("double")
    t = F.when(a >= 1, F.signum("_r") * float("inf")).otherwise(F.col("_r") * F.sqrt(df / F.greatest(1 - F.col("_r") * F.col("_r"), F.lit(1e-300))))
    out = out.withColumns({"_t": t, "df": df}).withColumn("_p", p_value_column("_t", "df"))
    return out.select(key, "n", F.round("_r", 6).alias("r"), name.alias("strength"), F.round("_t", 6).alias("t"), "df", F.round("_p", 6).alias("p_value"), (F.col("_p") < level).alias("significant"))


def possible_causes(change: Column) -> Column:
    """What may lie behind a change, given as a signed share of the baseline."""
    lines = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(change > 0.5, lines("Major system change or deployment", "Infrastructure issue or resource contention"))
        .when(change > 0.2, lines("Query plan change", "Index modification or corruption", "Data growth or distribution change"))
        .otherwise(lines("Minor configuration change", "Normal system variation"))
    )


def mean_interval(executions: DataFrame, value: str = "duration_ms", key: str = KEY, level: float = 0.95) -> DataFrame:
    """Mean of each group with the bounds of its confidence interval by Student's t; both are the mean for a single value."""
    out = executions.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))

    @F.arrow_udf("double")
    def quantile(ns: pa.Array) -> pa.Array:
        return pa.array([student_t(1 - level, n - 1) if n > 1 else 0.0 for n in ns.to_pylist()], pa.float64())

    half = quantile("n") * F.col("_s") / F.sqrt("n")
    return out.select(key, "n", F.round("_m", 6).alias("mean"), F.round(F.col("_m") - half, 6).alias("lower"), F.round(F.col("_m") + half, 6).alias("upper"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return 1.0 if not math.isinf(t) else 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_t(p: float, df: float) -> float:
    """The t whose two-sided p-value is p, by bisection."""
    low, high = 0.0, 1.0
    while student_p(high, df) > p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if student_p(middle, df) > p else (low, middle)
    return (low + high) / 2


def p_value_column(t: Column | str, df: Column | str) -> Column:
    """student_p over columns; groups are few, so this runs on one row a group."""

    @F.arrow_udf("double")
    def p(ts: pa.Array, dfs: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else student_p(x, y) for x, y in zip(ts.to_pylist(), dfs.to_pylist(), strict=True)], pa.float64())

    return p(t, df)


def shape(skewness: Column, kurtosis: Column) -> Column:
    return F.when((F.abs(skewness) < 0.5) & (F.abs(kurtosis) < 0.5), "Normal").when(skewness > 1.0, "LogNormal").when(kurtosis < -1.0, "Uniform").otherwise("Unknown")


def regression_report(executions: DataFrame, value: str = "duration_ms", key: str = KEY, detector_points: int = 30) -> DataFrame:
    """One row a fingerprint: which engine judged it, status, change, trend, significance, shape, anomalies, confidence, recommendations, causes.

    Series shorter than `detector_points` are judged half against half; the others by the first three quarters against the
    rest. Of fewer than 3 points nothing can be said: status InsufficientData, and the advice to collect more.
    """
    # one row a series: halves, split, trend and shape from one pass over the ranked rows
    series = stored(ranked(executions, value, key).groupBy(key).agg(*_half_aggregates(), *_trend_aggregates(), *_split_aggregates(), *_shape_aggregates("y")))
    few = series.filter("n < 3").select(
        key, "n", F.lit("none").alias("engine"), F.lit("InsufficientData").alias("status"), F.lit(None).cast("double").alias("change_pct"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("double").alias("p_value"),
        F.lit("Stable").alias("trend"), F.lit(0.0).alias("strength"), F.lit("Unknown").alias("shape"), F.lit(0).cast("bigint").alias("anomalies"), F.lit("Low").alias("confidence"), F.lit("collect_more_data").alias("recommendations"),
        F.array().cast("array<string>").alias("causes"),
    )
    odd = modified_z(executions, 3.5, value, key).groupBy(key).agg(F.count("*").alias("anomalies"))
    half = F.round(_half_change(), 6)
    out = _with_shape(series.filter("n >= 3")).select(key, "n", half.alias("_bc"), basic_status(half).alias("_bs"), *_split_columns(), *_trend_columns(), "skewness", "kurtosis", "jarque_bera")
    out = out.join(odd, key, "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    full = F.col("n") >= detector_points
    out = out.withColumns({
        "engine": F.when(full, "statistical").otherwise("basic"), "status": F.when(full, F.col("status")).otherwise(F.col("_bs")), "change_pct": F.when(full, F.col("change_pct")).otherwise(F.col("_bc")),
        "severity": F.when(full, F.col("severity")), "shape": shape(F.col("skewness"), F.col("kurtosis")), "p_value": F.when(F.col("severity").isNotNull() & full, F.round(p_value_column("welch_t", "welch_df"), 9)),
    })
    score = F.when(F.col("n") >= 1000, 0.4).when(F.col("n") >= 500, 0.3).when(F.col("n") >= 100, 0.2).otherwise(0.1)
    score = score + F.when(F.exp(-F.col("jarque_bera") / 2) <= 0.05, 0.2).otherwise(0.0) + F.when(F.col("shape") == "Normal", 0.2).otherwise(0.0) + F.when(F.col("anomalies") / F.col("n") < 0.05, 0.2).otherwise(0.0)
    confidence = F.when(score >= 0.95, "VeryHigh").when(score >= 0.85, "High").when(score >= 0.70, "Medium").otherwise("Low")
    advice = F.array_compact(F.array(
        F.when(F.col("severity") == "Critical", "investigate").when(F.col("severity") == "High", "optimize").when(F.col("severity").isNotNull(), "monitor"),
        F.when((F.col("trend") == "Degrading") & (F.col("strength") > 0.7), "investigate_trend"), F.when(F.col("anomalies") > 5, "investigate_variability"),
    ))
    causes = F.when(F.col("severity").isNotNull(), possible_causes(F.col("change_pct") / 100)).otherwise(F.array().cast("array<string>"))
    judged = out.select(key, "n", "engine", "status", "change_pct", "severity", "p_value", "trend", "strength", "shape", "anomalies", confidence.alias("confidence"), F.array_join(advice, ",").alias("recommendations"), causes.alias("causes"))
    return judged.unionByName(few)


class RegressionEngine(Protocol):
    """Judges each fingerprint's series: (fingerprint, n, status, ...)."""

    def analyze(self, executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame: ...


@dataclass(frozen=True)
class BasicEngine:
    """Half against half."""

    def analyze(self, executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame:
        return basic_regression(ranked(executions, value, key), key)


@dataclass(frozen=True)
class StatisticalEngine:
    """The full report; series shorter than `detector_points` are judged as the basic engine does."""

    detector_points: int = 30

    def analyze(self, executions: DataFrame, value: str = "duration_ms", key: str = KEY) -> DataFrame:
        return regression_report(executions, value, key, self.detector_points)


def engine_for(workload: str = "mixed", statistical: bool = True) -> RegressionEngine:
    """The engine of a workload's preset."""
    return StatisticalEngine(regression_thresholds(workload)[4]) if statistical else BasicEngine()
