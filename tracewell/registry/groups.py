"""Queries over groups of executions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as g
from ..operators import state as st
from .data import E, Registered, executions

G = "fingerprint, database"
_DEC = "cast(sum(cast({0} as decimal(18,2))) as double)"
TOTAL = _DEC.format("duration_ms")
STATS = f"""s as (select {G}, count(*) as calls, {TOTAL} as total_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
    round(coalesce(stddev_samp(duration_ms), 0), 6) as stddev_ms, min(ts) as first_ts, max(ts) as last_ts,
    round({TOTAL} / count(*), 6) as mean_ms, {", ".join(f"round(quantile_cont(duration_ms, {p}), 6) as p{round(p * 100)}_ms" for p in g.PERCENTILES)} from e group by {G})"""
HOURLY = f"""h as (select {G}, date_trunc('hour', ts)::timestamp as bucket, count(*) as calls, {TOTAL} as total_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
    round({TOTAL} / count(*), 6) as mean_ms from e group by all)"""
BOUNDS = "[" + ",".join(map(str, g.LATENCY_BOUNDS)) + "]"
B = "len(list_filter({1}, lambda b: {0} / 1000.0 > b))"
SLOW = B.format("slow_ms", BOUNDS)
COUNTS = "[" + ", ".join(f"cast(count(*) filter (i = {k}) as bigint)" for k in range(len(g.LATENCY_BOUNDS) + 1)) + "]"
MINUTES = f"""m as (select {G}, date_trunc('minute', ts)::timestamp as minute, count(*) as calls, {_DEC.format("slow_ms")} as total_ms, {COUNTS} as latency_buckets
    from (select *, {SLOW} as i from e) group by {G}, date_trunc('minute', ts))"""
SLO = 100.0
STATE = f"""z as (select {G}, count(*) as calls, {TOTAL} as total_ms, cast(sum(cast(duration_ms * duration_ms as decimal(24,4))) as double) as sum_sq_ms,
    min(duration_ms) as min_ms, max(duration_ms) as max_ms, count(*) filter (duration_ms > {SLO}) as slo_breaches, min(ts) as first_seen, max(ts) as last_seen,
    arg_max(seq, (duration_ms, seq)) as representative_seq,
    [{", ".join(f"cast(count(*) filter (i = {k}) as bigint)" for k in range(len(g.LATENCY_BOUNDS) + 1))}] as latency_buckets
    from (select *, {B.format("duration_ms", BOUNDS)} as i from e) group by {G})"""


def _slow(s, d):
    return executions(s, d).withColumn("duration_ms", F.col("slow_ms"))


def _stats(s, d):
    return g.group_stats(executions(s, d))


def _recent_executions(s, d):
    return g.minute_window(_slow(s, d))


def _batches(s, d):
    x = executions(s, d)
    return [st.state_rows(x.filter(F.col("seq") % 3 == k), SLO, batch=0) for k in range(3)]


def _merged(s, d):
    return st.merge_states(*_batches(s, d))


RECENT = f"""w as (select * from m where minute >= (select max(minute) from m) - interval 15 minute),
    bk as (select {G}, i, cast(sum(latency_buckets[i + 1]) as bigint) as n from w, range({len(g.LATENCY_BOUNDS) + 1}) r(i) group by {G}, i),
    c as (select {G}, i, sum(n) over (partition by {G} order by i) as c, sum(n) over (partition by {G}) as t from bk),
    p as (select {G}, min(i) filter (c * 100 >= 50 * t) as i50, min(i) filter (c * 100 >= 95 * t) as i95, min(i) filter (c * 100 >= 99 * t) as i99 from c group by {G}),
    t as (select {G}, cast(sum(calls) as bigint) as calls, cast(sum(cast(total_ms as decimal(18,2))) as double) as ms, min(minute) as f from w group by {G})"""
LE = f"coalesce(cast(({BOUNDS})[{{1}} + 1] as double), 'inf'::double)"

def _with_gaps(s, d):
    """The executions with every second day moved two months on, which leaves gaps."""
    e = executions(s, d)
    return e.withColumn("ts", F.when(F.dayofmonth("ts") % 2 == 0, F.col("ts") + F.expr("interval 60 days")).otherwise(F.col("ts")))


_GAPS = E.replace("as seq, ts,", "as seq, case when day(ts) % 2 = 0 then ts + interval 60 days else ts end as ts,")

QUERIES = {
    "q2_8_1_group_stats": Registered(_stats, f"with {E}, {STATS} select * from s"),
    "q2_8_1_fingerprint_stats": Registered(lambda s, d: g.group_stats(executions(s, d), ("fingerprint",)), f"with {E}, {STATS.replace(G, 'fingerprint')} select * from s"),
    "q2_8_7_hourly_histogram": Registered(lambda s, d: g.hourly_histogram(executions(s, d)), f"with {E}, {HOURLY} select * from h"),
    "q2_8_8_latency_buckets": Registered(
        lambda s, d: _slow(s, d).groupBy("fingerprint", g.latency_bucket("duration_ms").alias("bucket")).agg(F.count("*").alias("calls")),
        f"with {E} select fingerprint, cast({SLOW} as integer) as bucket, count(*) as calls from e group by all",
    ),
    "q2_8_9_slo_breaches": Registered(lambda s, d: g.slo_breaches(executions(s, d), SLO), f"with {E} select {G}, count(*) as calls, count(*) filter (duration_ms > {SLO}) as slo_breaches from e group by {G}"),
    "q2_8_9_slo_disabled": Registered(lambda s, d: g.slo_breaches(executions(s, d), 0), f"with {E} select {G}, count(*) as calls, cast(0 as bigint) as slo_breaches from e group by {G}"),
    "q2_8_12_first_query_id": Registered(
        lambda s, d: executions(s, d).groupBy("fingerprint").agg(F.min(F.when(F.col("seq") % 7 != 0, F.struct("seq", (F.col("seq") % 7).alias("qid")))).alias("m")).select("fingerprint", F.col("m.qid").alias("query_id")),
        f"with {E} select fingerprint, arg_min(seq % 7, seq) filter (seq % 7 <> 0) as query_id from e group by fingerprint",
    ),
    "q2_8_14_variation_share": Registered(
        lambda s, d: g.derived(_stats(s, d)).select("fingerprint", "database", "cv", "share_pct"),
        f"with {E}, {STATS} select {G}, case when mean_ms = 0 then 0.0 else round(stddev_ms / mean_ms, 6) end as cv, round(total_ms * 100 / (select cast(sum(cast(total_ms as decimal(18,2))) as double) from s), 6) as share_pct from s",
    ),
    "q2_8_18_slow_thresholds": Registered(
        lambda s, d: g.slow_counts(executions(s, d), (50.0, 100.0, 250.0)),
        f"with {E} select {G}, t.t::double as threshold_ms, count(*) filter (duration_ms >= t.t) as slow_calls from e, (values (50.0), (100.0), (250.0)) t(t) group by {G}, t.t",
    ),
    "q2_8_20_overhead_stats": Registered(
        lambda s, d: executions(s, d).agg(F.count("*").alias("n"), g.total("duration_ms").alias("total"), F.round(F.avg("duration_ms"), 6).alias("mean"), F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), F.round(F.stddev_pop("duration_ms"), 6).alias("sd")),
        f"with {E} select count(*) as n, {TOTAL} as total, round(avg(duration_ms), 6) as mean, min(duration_ms) as lo, max(duration_ms) as hi, round(stddev_pop(duration_ms), 6) as sd from e",
    ),
    "q2_7_15_representative": Registered(
        lambda s, d: g.representatives(executions(s, d)),
        f"with {E} select {G}, arg_max(seq, (duration_ms, seq)) as seq, arg_max(ts, (duration_ms, seq)) as ts, max(duration_ms) as duration_ms from e group by {G}",
    ),
    "q2_7_10_group_key": Registered(
        lambda s, d: executions(s, d).select(F.concat_ws("\u001f", "fingerprint", "database").alias("group_key")).distinct(), f"with {E} select distinct fingerprint || chr(31) || database as group_key from e"
    ),
    "q2_12_4_statements_summary": Registered(
        lambda s, d: g.statements_summary(st.as_table(_merged(s, d))),
        f"""with {E}, {STATE} select {G}, calls, total_ms, round(total_ms / calls, 6) as mean_ms, min_ms, max_ms,
            round(sqrt(greatest(0.0, sum_sq_ms / calls - (total_ms / calls) * (total_ms / calls))), 4) as stddev_ms,
            round(sqrt(greatest(0.0, sum_sq_ms / calls - (total_ms / calls) * (total_ms / calls))) / (total_ms / calls), 6) as cv, slo_breaches,
            round(cast(slo_breaches as double) / calls, 6) as slo_breach_pct from z""",
    ),
    "q2_12_5_top_by_total": Registered(lambda s, d: g.top_groups(_stats(s, d), "total_ms", 5), f"with {E}, {STATS} select * from s order by total_ms desc, fingerprint, database limit 5"),
    "q2_12_6_query_timeline": Registered(lambda s, d: g.hourly_histogram(executions(s, d)).orderBy("fingerprint", "bucket"), f"with {E}, {HOURLY} select * from h"),
    "q2_12_8_add_bucket_arrays": Registered(
        lambda s, d: g.bucket_counts(_slow(s, d), ("database",)).withColumn("latency_buckets", g.add_bucket_arrays(F.when(F.col("database") != "db0", F.col("latency_buckets")), F.col("latency_buckets"))).select("database", F.posexplode("latency_buckets").alias("i", "n")),
        f"with {E} select database, cast(i.i as integer) as i, cast(case when database = 'db0' then 1 else 2 end * count(*) filter (b = i.i) as bigint) as n from (select *, {SLOW} as b from e), range({len(g.LATENCY_BOUNDS) + 1}) i(i) group by database, i.i",
    ),
    "q2_12_9_metrics_window": Registered(
        lambda s, d: g.minute_window(_slow(s, d)).select("fingerprint", "database", "minute", "calls", "total_ms", F.array_join(F.col("latency_buckets").cast("array<string>"), ",").alias("buckets")),
        f"with {E}, {MINUTES} select {G}, minute, calls, total_ms, array_to_string(latency_buckets, ',') as buckets from m",
    ),
    "q2_12_10_metrics": Registered(
        lambda s, d: st.as_table(_merged(s, d)).select(
            "database", "fingerprint", "calls", F.round(F.col("total_ms") / 1000, 6).alias("total_seconds"), (F.col("min_ms") / 1000).alias("min_seconds"), (F.col("max_ms") / 1000).alias("max_seconds"), "slo_breaches",
            (F.unix_micros(F.col("first_seen").cast("timestamp")) / 1e6).alias("first_seen_seconds"), (F.unix_micros(F.col("last_seen").cast("timestamp")) / 1e6).alias("last_seen_seconds"),
        ),
        f"with {E}, {STATE} select database, fingerprint, calls, round(total_ms / 1000, 6) as total_seconds, min_ms / 1000 as min_seconds, max_ms / 1000 as max_seconds, slo_breaches, epoch_us(first_seen) / 1e6 as first_seen_seconds, epoch_us(last_seen) / 1e6 as last_seen_seconds from z",
    ),
    "q2_12_11_cumulative_buckets": Registered(
        lambda s, d: g.cumulative_buckets(g.bucket_counts(_slow(s, d))),
        f"""with {E}, x as (select {G}, i.i, count(*) filter (b = i.i) as n from (select *, {SLOW} as b from e), range({len(g.LATENCY_BOUNDS) + 1}) i(i) group by {G}, i.i)
            select {G}, {LE.replace("{1}", "i")} as le, cast(sum(n) over (partition by {G} order by i) as bigint) as count from x""",
    ),
    "q2_12_12_metrics_recent": Registered(
        lambda s, d: g.recent_metrics(_recent_executions(s, d)),
        f"""with {E}, {MINUTES}, {RECENT} select {G}, calls, round(ms / 1000, 6) as total_seconds, round(calls / greatest(epoch((select max(minute) from m)) - epoch(f), 60.0), 6) as calls_per_second,
            {LE.replace("{1}", "i50")} as p50_le_seconds, {LE.replace("{1}", "i95")} as p95_le_seconds, {LE.replace("{1}", "i99")} as p99_le_seconds from t join p using ({G})""",
    ),
    "q2_12_15_state_merge": Registered(
        lambda s, d: st.as_table(_merged(s, d)).withColumn("latency_buckets", F.array_join(F.col("latency_buckets").cast("array<string>"), ",")),
        f"with {E}, {STATE} select * replace (array_to_string(latency_buckets, ',') as latency_buckets) from z",
    ),
    "q2_12_16_histogram_merge": Registered(
        lambda s, d: st.merge_histograms(*[g.hourly_histogram(executions(s, d).filter(F.col("seq") % 2 == k)).drop("mean_ms") for k in range(2)]), f"with {E}, {HOURLY} select * exclude (mean_ms) from h"
    ),
    "q2_12_17_window_purge": Registered(
        lambda s, d: st.purge_minutes(g.minute_window(_slow(s, d)), 60).select("fingerprint", "database", "minute", "calls"),
        f"with {E}, {MINUTES} select {G}, minute, calls from m where minute >= (select max(minute) from m) - interval 60 minute",
    ),
    "q2_12_18_rekey": Registered(
        lambda s, d: st.as_table(st.rekey(_merged(s, d), s.createDataFrame([("click", "view"), ("purchase", "view")], "fingerprint string, new_fingerprint string"))).drop("latency_buckets"),
        f"with {E.replace('event_type as fingerprint', 'case when event_type in (' + chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'purchase' + chr(39) + ') then ' + chr(39) + 'view' + chr(39) + ' else event_type end as fingerprint')}, {STATE} select * exclude (latency_buckets) from z",
    ),
    "q2_12_19_series_top": Registered(
        lambda s, d: g.top_groups(_stats(s, d), "total_ms", 4).select("fingerprint", "database").join(g.cumulative_buckets(g.bucket_counts(_slow(s, d))), ["fingerprint", "database"]),
        f"""with {E}, {STATS}, k as (select {G} from s order by total_ms desc, fingerprint, database limit 4),
            x as (select {G}, i.i, count(*) filter (b = i.i) as n from (select *, {SLOW} as b from e), range({len(g.LATENCY_BOUNDS) + 1}) i(i) group by {G}, i.i)
            select {G}, {LE.replace("{1}", "i")} as le, cast(sum(n) over (partition by {G} order by i) as bigint) as count from x join k using ({G})""",
    ),
    "q2_13_1_sort_by_calls": Registered(lambda s, d: g.sort_groups(_stats(s, d), "calls"), f"with {E}, {STATS} select * from s order by calls desc, {G}"),
    "q2_13_1_sort_by_mean_asc": Registered(lambda s, d: g.sort_groups(_stats(s, d), "mean_ms", False).limit(6), f"with {E}, {STATS} select * from s order by mean_ms, {G} limit 6"),
    "q2_13_5_execution_sample": Registered(
        lambda s, d: g.first_executions(executions(s, d), 100, g.GROUP).select("fingerprint", "database", "seq", "duration_ms"),
        f"with {E} select {G}, seq, duration_ms from e qualify row_number() over (partition by {G} order by seq) <= 100",
    ),
    "q2_13_6_plan_cap": Registered(
        lambda s, d: g.group_stats(g.first_executions(g.in_window(executions(s, d), "2024-01-02 00:00:00"), 1000), ("fingerprint",)),
        f"with {E.replace('from events', 'from events where ts >= timestamp ' + chr(39) + '2024-01-02 00:00:00' + chr(39) + ' order by event_id limit 1000')}, {STATS.replace(G, 'fingerprint')} select * from s",
    ),
    "q2_13_9_recent_series": Registered(lambda s, d: g.most_recent_groups(executions(s, d), 7), f"with {E} select {G}, max(ts) as last_ts from e group by {G} order by max((ts, seq)) desc, {G} limit 7"),
    "q2_14_9_evicted_series": Registered(
        lambda s, d: g.evicted_groups(executions(s, d), 7), f"with {E}, k as (select {G} from e group by {G} order by max((ts, seq)) desc, {G} limit 7) select distinct {G} from e where ({G}) not in (select ({G}) from k)"
    ),
    "q2_14_1_first_last_seen": Registered(
        lambda s, d: st.seen(st.seen(executions(s, d).limit(0).select("fingerprint", "database", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")), executions(s, d).filter("seq % 2 = 0")), executions(s, d).filter("seq % 2 = 1")),
        f"with {E} select {G}, min(ts) as first_seen, max(ts) as last_seen from e group by {G}",
    ),
    "q2_14_8_tracked_minus_live": Registered(
        lambda s, d: executions(s, d).select("fingerprint", "database").distinct().join(executions(s, d).filter("duration_ms > 480").select("fingerprint", "database"), ["fingerprint", "database"], "left_semi"),
        f"with {E} select distinct {G} from e where ({G}) in (select ({G}) from e where duration_ms > 480)",
    ),
    "q2_2_20_record_hashes": Registered(
        lambda s, d: st.forget(st.seen(executions(s, d).limit(0).select("fingerprint", "database", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")), executions(s, d)), "2024-01-30 23:00:00"),
        f"with {E} select {G}, min(ts) as first_seen, max(ts) as last_seen from e group by {G} having max(ts) >= timestamp '2024-01-30 23:00:00'",
    ),
    "q2_16_11_gap_filled_timeline": Registered(
        lambda s, d: g.timeline(g.hourly_histogram(_with_gaps(s, d)), 40),
        f"""with {_GAPS}, {HOURLY}, sp as (select {G}, min(bucket) as lo, max(bucket) as hi, (epoch(max(bucket)) - epoch(min(bucket))) / 3600 + 1 as n from h group by {G}),
            x as (select {G}, unnest(range(cast(n as bigint))) as i, lo, cast(ceil(n / 40) as integer) as size from sp),
            f as (select x.fingerprint, x.database, cast(floor(i / size) as integer) as bar, x.lo + i * interval 1 hour as bucket from x),
            j as (select f.*, coalesce(h.calls, 0) as calls from f left join h using (fingerprint, database, bucket))
            select {G}, bar, min(bucket) + cast(floor(count(*) / 2) as bigint) * interval 1 hour as label, cast(sum(calls) as bigint) as calls from j group by {G}, bar""",
    ),
    "q2_16_12_islands": Registered(
        lambda s, d: g.islands(g.hourly_histogram(_with_gaps(s, d))),
        f"""with {_GAPS}, {HOURLY}, x as (select *, bucket - row_number() over (partition by {G} order by bucket) * interval 1 hour as k from h)
            select {G}, min(bucket) as begin, max(bucket) as "end", count(*) as hours, cast(sum(calls) as bigint) as calls from x group by {G}, k""",
    ),
    "q2_3_26_time_window": Registered(
        lambda s, d: g.in_window(executions(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("seq", "ts"), f"with {E} select seq, ts from e where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 00:00:00'"
    ),
    "q2_3_33_group_filter": Registered(
        lambda s, d: g.keep_groups(_stats(s, d), 0.02, ("db0", "db1"), ("db1",), ("^cl",)), f"with {E}, {STATS} select * from s where min_ms >= 0.02 and database in ('db0', 'db1') and database not in ('db1') and not regexp_matches(fingerprint, '^cl')"
    ),
}
