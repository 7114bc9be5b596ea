"""Queries over series of durations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as x
from .data import E, R, Registered, executions


def _drift(s, d):
    return x.ranked(executions(s, d), "drift_ms")


_HALF = "rn <= n // 2"
_AVG = "cast(sum(cast(y as decimal(28,8))) filter ({0}) as double) / count(*) filter ({0})"
A, B = _AVG.format(_HALF), _AVG.format(f"not ({_HALF})")
Q6 = """q as (select fingerprint, count(*) as n, list_sort(list({v})) as l from {src} group by fingerprint),
    q6 as (select fingerprint, n, {cols} from q)"""


def _r6(q: float) -> str:
    at = f"least(greatest({q} * (n + 1) - 1, 0.0), n - 1.0)"
    return f"l[cast(floor({at}) as bigint) + 1] + (l[cast(ceil({at}) as bigint) + 1] - l[cast(floor({at}) as bigint) + 1]) * ({at} - floor({at})) as q{round(q * 100)}"


QR = Q6.format(v="duration_ms", src="e", cols=", ".join(_r6(q) for q in (0.25, 0.5, 0.75)))
_BASE = "rn <= 3 * n // 4"
#: The two-sided p-value of t with df degrees of freedom, by Simpson's rule over Student's density from 0 to t.
_STEPS = 4000
_TWO_SIDED = f"""w as (select fingerprint, 1 - 2 * t / {3 * _STEPS} * sum((case when i in (0, {_STEPS}) then 1 when i % 2 = 1 then 4 else 2 end)
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * pow(1 + pow(t * i / {_STEPS}, 2) / df, -(df + 1) / 2)) as two_sided
    from c, range({_STEPS + 1}) s(i) group by fingerprint, t)"""
BA, BB = _AVG.format(_BASE), _AVG.format(f"not ({_BASE})")

QUERIES = {
    "q2_9_4_basic_regression": Registered(
        lambda s, d: x.basic_regression(_drift(s, d)),
        f"""with {R}, h as (select fingerprint, n, {A} as a, {B} as b from r group by fingerprint, n), c as (select *, case when a > 0 then (b - a) / a * 100 else 0.0 end as p from h)
            select fingerprint, n, round(a, 6) as first_ms, round(b, 6) as second_ms, round(p, 6) as change_pct,
            case when p <= 5 then 'None' when p <= 20 then 'Minor' when p <= 50 then 'Significant' else 'Critical' end as status from c where n >= 3""",
    ),
    "q2_9_1_engine": Registered(
        lambda s, d: x.engine_for(statistical=False).analyze(executions(s, d), "drift_ms").select("fingerprint", "n", "status").unionByName(x.engine_for("olap").analyze(executions(s, d), "drift_ms").select("fingerprint", "n", "status")),
        f"""with {R}, h as (select fingerprint, n, {A} as a, {B} as b, {BA} as ba, {BB} as bb from r group by fingerprint, n), c as (select *, (b - a) / a * 100 as p, (bb - ba) / ba * 100 as q from h)
            select fingerprint, n, case when p <= 5 then 'None' when p <= 20 then 'Minor' when p <= 50 then 'Significant' else 'Critical' end as status from c
            union all select fingerprint, n, case when q >= 50 then 'Critical' when q > 10 then 'Significant' else 'None' end from c""",
    ),
    "q2_9_6_trend": Registered(
        lambda s, d: x.trend(_drift(s, d)),
        f"""with {R}, h as (select fingerprint, {A} as a, {B} as b, stddev_samp(y) / avg(y) as cv, regr_r2(y, rn) as r2 from r group by fingerprint, n)
            select fingerprint, case when abs(cv) > 0.5 then 'Volatile' when (b - a) / a > 0.05 then 'Degrading' when (b - a) / a < -0.05 then 'Improving' else 'Stable' end as trend,
            round(least(greatest(coalesce(r2, 0), 0.0), 1.0), 6) as strength from h""",
    ),
    "q2_9_8_seasonality": Registered(
        lambda s, d: x.seasonality(_drift(s, d)),
        f"""with {R}, h as (select fingerprint, hour(ts) as h, cast(sum(cast(y as decimal(28,8))) as double) / count(*) as m, count(*) as c from r group by all)
            select fingerprint, count(*) as hours, round(least(stddev_pop(m) / avg(m), 1.0), 6) as strength, least(stddev_pop(m) / avg(m), 1.0) > 0.2 as daily from h
            group by fingerprint having sum(c) >= 168 and count(*) >= 4 and avg(m) > 0""",
    ),
    "q2_9_9_change_points": Registered(
        lambda s, d: x.change_points(_drift(s, d)),
        f"""with {R}, c as (select *, least(greatest(n // 10, 5), 50) as w, sum(cast(y as decimal(28,8))) over (partition by fingerprint order by rn) as cum from r),
            j as (select b.fingerprint, b.rn, b.ts, b.w, cast(p.cum - coalesce(l.cum, 0) as double) / b.w as x, cast(h.cum - p.cum as double) / b.w as y
                from c b join c p on p.fingerprint = b.fingerprint and p.rn = b.rn - 1 left join c l on l.fingerprint = b.fingerprint and l.rn = b.rn - 1 - b.w
                join c h on h.fingerprint = b.fingerprint and h.rn = b.rn + b.w - 1 where b.rn > b.w and b.rn <= b.n - b.w)
            select fingerprint, rn, ts, case when y > x then 'Degradation' else 'Improvement' end as change_type, round(abs((y - x) / x), 6) as magnitude from j where abs((y - x) / x) > 0.2""",
    ),
    "q2_9_12_distribution": Registered(
        lambda s, d: x.distribution(executions(s, d)),
        f"""with {E}, m as (select fingerprint, count(*)::double as n, avg(duration_ms) as a, stddev_samp(duration_ms) as sd, skewness(duration_ms) as g1, kurtosis(duration_ms) as g2 from e group by fingerprint),
            u as (select *, g1 * (n - 2) / sqrt(n * (n - 1)) as s1, (g2 * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) as s2 from m)
            select fingerprint, cast(n as bigint) as n, round(a, 6) as mean, round(sd, 6) as stddev, round(g1, 6) as skewness, round(g2, 6) as kurtosis, round(n / 6 * (s1 * s1 + s2 * s2 / 4), 4) as jarque_bera, round(exp(-n / 12 * (s1 * s1 + s2 * s2 / 4)), 6) as p_value from u""",
    ),
    "q2_9_16_correlation": Registered(
        lambda s, d: x.correlation(executions(s, d).withColumn("place", F.col("seq").cast("double")), "drift_ms", "place"),
        f"""with {E}, c as (select fingerprint, count(*) as n, corr(drift_ms, cast(seq as double)) as r, count(*) - 2 as df from e group by fingerprint), c2 as (select *, r * sqrt(df / (1 - r * r)) as st, abs(r * sqrt(df / (1 - r * r))) as t from c),
            {_TWO_SIDED.replace("from c,", "from c2 c,")}
            select fingerprint, n, round(r, 6) as r, case when abs(r) < 0.3 then 'VeryWeak' when abs(r) < 0.5 then 'Weak' when abs(r) < 0.7 then 'Moderate' when abs(r) < 0.9 then 'Strong' else 'VeryStrong' end as strength, round(st, 6) as t,
            df::double as df, round(two_sided, 6) as p_value, two_sided < 0.05 as significant from c2 join w using (fingerprint) where n >= 3""",
    ),
    "q2_9_11_mean_interval": Registered(
        lambda s, d: x.mean_interval(executions(s, d)).select("fingerprint", "n", "mean", F.round((F.col("upper") - F.col("lower")) / 2, 5).alias("half")).withColumn("covered", F.col("half") > 0).drop("half"),
        f"with {E} select fingerprint, count(*) as n, round(avg(duration_ms), 6) as mean, count(*) > 1 as covered from e group by fingerprint",
    ),
    "q2_9_10_causes": Registered(
        lambda s, d: executions(s, d).select("seq", F.array_join(x.possible_causes(F.col("seq") % 100 / 100 - 0.2), ";").alias("causes")),
        f"""with {E} select seq, case when (seq % 100) / 100.0 - 0.2 > 0.5 then 'Major system change or deployment;Infrastructure issue or resource contention'
            when (seq % 100) / 100.0 - 0.2 > 0.2 then 'Query plan change;Index modification or corruption;Data growth or distribution change' else 'Minor configuration change;Normal system variation' end as causes from e""",
    ),
    "q2_9_29_short_series": Registered(
        lambda s, d: x.regression_report(executions(s, d).withColumn("fingerprint", F.concat("fingerprint", F.floor(F.log2(F.col("seq") + 1)).cast("string")))).filter("n < 3").select("fingerprint", "n", "status", "confidence", "recommendations"),
        f"""with {E} select fingerprint || cast(floor(log2(seq + 1)) as bigint) as fingerprint, count(*) as n, 'InsufficientData' as status, 'Low' as confidence, 'collect_more_data' as recommendations from e group by all having count(*) < 3""",
    ),
    "q2_9_18_baseline_regression": Registered(
        lambda s, d: x.baseline_split(_drift(s, d)),
        f"""with {R}, h as (select fingerprint, {BA} as a, {BB} as b, var_samp(y) filter ({_BASE}) as va, var_samp(y) filter (not ({_BASE})) as vb, count(*) filter ({_BASE}) as na, count(*) filter (not ({_BASE})) as nb from r group by fingerprint, n),
            c as (select *, (b - a) / a * 100 as p, va / na as sa, vb / nb as sb from h)
            select fingerprint, round(a, 6) as baseline_ms, round(b, 6) as current_ms, round(p, 6) as change_pct, case when p >= 50 then 'Critical' when p >= 25 then 'High' when p > 10 then 'Medium' end as severity,
            case when p >= 50 then 'Critical' when p > 10 then 'Significant' else 'None' end as status, round((a - b) / sqrt(sa + sb), 6) as welch_t,
            round((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 4) as welch_df from c""",
    ),
    "q2_9_27_quantiles_r6": Registered(
        lambda s, d: x.quantiles_r6(executions(s, d), (0.25, 0.5, 0.75)).select("fingerprint", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")]),
        f"with {E}, {QR} select fingerprint, n, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75 from q6",
    ),
    "q2_9_29_iqr_outliers": Registered(
        lambda s, d: x.iqr_outliers(executions(s, d)),
        f"with {E}, {QR} select fingerprint, seq, duration_ms as value from e join q6 using (fingerprint) where duration_ms < q25 - (q75 - q25) * 1.5 or duration_ms > q75 + (q75 - q25) * 1.5",
    ),
    "q2_9_37_modified_z": Registered(
        lambda s, d: x.modified_z(executions(s, d)),
        f"""with {E}, {QR}, a as (select e.*, abs(duration_ms - q50) as a, q50 from e join q6 using (fingerprint)),
            {QR.replace("q6 as", "d6 as").replace("q as", "d as").replace("from q)", "from d)").replace("list(duration_ms)", "list(a)").replace("from e ", "from a ")}
            , z as (select a.fingerprint, seq, duration_ms as value, 0.6745 * (duration_ms - a.q50) / d6.q50 as z from a join d6 using (fingerprint) where d6.q50 > 0)
            select fingerprint, seq, value, round(z, 6) as z, case when abs(z) > 4 then 'Spike' else 'Outlier' end as kind from z where abs(z) > 3.5""",
    ),
    "q2_9_3_regression_report": Registered(
        lambda s, d: x.regression_report(executions(s, d), "drift_ms").select("fingerprint", "n", "engine", "status", "severity", "trend", "shape", "anomalies", F.col("p_value") < 0.05).withColumnRenamed("(p_value < 0.05)", "significant"),
        f"""with {R}, {Q6.format(v="y", src="r", cols=_r6(0.5))}, a as (select r.fingerprint, r.y, abs(y - q50) as a, q50 from r join q6 using (fingerprint)),
            {Q6.format(v="a", src="a", cols=_r6(0.5)).replace("q6 as", "d6 as").replace("q as", "d as").replace("from q)", "from d)")}
            , z as (select a.fingerprint, count(*) filter (abs(0.6745 * (y - a.q50) / d6.q50) > 3.5) as anomalies from a join d6 using (fingerprint) group by all),
            h as (select fingerprint, n, {BA} as a, {BB} as b, skewness(y) as g1, kurtosis(y) as g2, stddev_samp(y) / avg(y) as cv, {A} as ha, {B} as hb,
                var_samp(y) filter ({_BASE}) / count(*) filter ({_BASE}) as sa, var_samp(y) filter (not ({_BASE})) / count(*) filter (not ({_BASE})) as sb,
                count(*) filter ({_BASE}) as na, count(*) filter (not ({_BASE})) as nb from r group by fingerprint, n),
            c as (select *, (b - a) / a * 100 as p, abs(a - b) / sqrt(sa + sb) as t, (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) as df from h),
            {_TWO_SIDED}
            select fingerprint, n, 'statistical' as engine, case when p >= 50 then 'Critical' when p > 10 then 'Significant' else 'None' end as status,
            case when p >= 50 then 'Critical' when p >= 25 then 'High' when p > 10 then 'Medium' end as severity,
            case when abs(cv) > 0.5 then 'Volatile' when (hb - ha) / ha > 0.05 then 'Degrading' when (hb - ha) / ha < -0.05 then 'Improving' else 'Stable' end as trend,
            case when abs(g1) < 0.5 and abs(g2) < 0.5 then 'Normal' when g1 > 1 then 'LogNormal' when g2 < -1 then 'Uniform' else 'Unknown' end as shape, anomalies,
            case when p > 10 then two_sided < 0.05 end as significant from c join z using (fingerprint) join w using (fingerprint)""",
    ),
}
