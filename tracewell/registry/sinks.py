"""Queries over exports, metric families and streams."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from ..operators import groups as g
from ..operators import state as st
from ..operators.config import Settings
from ..session import shared_folder
from ..sources import export as ex
from ..sources import growing
from ..sources.backends import CompositeBackend, TableBackend, TextBackend
from ..streaming import commits, recency, service, tail
from .data import E, Registered, executions, table
from .groups import BOUNDS, B, G, HOURLY, SLO, SLOW, STATE, STATS
from .lines import FILE_EVENTS, log_lines
from .plans import N, plan_nodes


def _checkpoints(s, d):
    """Two rounds of checkpoints of the 17 files that events fall into, written and read back as versions of a store."""
    e = executions(s, d).select(F.concat(F.lit("/log/"), (F.col("seq") % 17).cast("string")).alias("path"), (F.col("seq") * 10).alias("position"), F.lit(1).cast("long").alias("device"), (F.col("seq") % 17).alias("inode"), (F.col("seq") * 10).alias("size"), F.col("ts").alias("last_modified"), F.lit(1).cast("long").alias("processed"))
    store = shared_folder(s)
    none, version = tail.load_files(s, store)
    tail.save_files(tail.upsert_files(none, e.filter("inode < 12")), store, version + 1)
    first, version = tail.load_files(s, store)
    tail.save_files(tail.delete_file(tail.upsert_files(first, e.filter("inode >= 8")), "/log/3"), store, version + 1)
    return tail.load_files(s, store)[0]


def _plans(s, d):
    """Nodes with a fingerprint and a database by the plan's number, and costs over all bounds."""
    x = plan_nodes(s, d)
    return x.withColumns({"fingerprint": F.concat(F.lit("f"), (F.col("plan_id") % 7).cast("string")), "database": F.concat(F.lit("db"), (F.col("plan_id") % 3).cast("string")), "total_cost": F.col("total_cost") / 50})


def _runs(s, d):
    bad = F.col("seq") % 9 == 0
    return executions(s, d).select(
        F.concat(F.lit("/log/"), (F.col("seq") % 3).cast("string")).alias("pattern"), F.when(bad, "error").otherwise("success").alias("status"), F.when(bad, F.when(F.col("seq") % 2 == 0, "file_error").otherwise("parse_error")).alias("error_type"),
        (F.col("duration_ms") / 1000).alias("seconds"), (F.col("ts") + F.make_dt_interval(secs=F.col("seq") / 1000000)).alias("ended"),
    )


_HASH = """'{query_hash="' || fingerprint || '",database="' || database || '"'"""
_LE = "case b when 10 then '+Inf' else ([" + ", ".join(f"'{x:g}'" for x in (0.001, 0.01, 0.1, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)) + "])[b] end"


def _round_trip(s, d):
    path = shared_folder(s)
    ex.write_export(ex.export_rows(executions(s, d)), path)
    return ex.read_export(s, path)


def _dealt(rows, s, d, *keys):
    """Lines dealt by file and runs of blocks, so that a file's name has as many parts as the log needs; an entry is in one part."""
    parts = max(4, -(-table(s, d, "events").count() // FILE_EVENTS))
    return rows.repartition(parts, *keys, F.floor(F.col("block") / (FILE_EVENTS // 100)))


def _streamed(s, d):
    base = shared_folder(s)
    executions(s, d).repartition(4).write.parquet(f"{base}/in")
    schema = s.read.parquet(f"{base}/in").schema
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    tail.fold_batches(stream, f"{base}/store", SLO, f"{base}/checkpoint").awaitTermination()
    return st.as_table(tail.load_store(s, f"{base}/store")).drop("latency_buckets")


def _log_stream(s, d):
    """The events' log, written as a file for each of seven names and read as a stream of two files a batch."""
    base = shared_folder(s)
    _dealt(log_lines(s, d), s, d, "file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{base}/in")
    parts = sum("/part-" in f.path for f in growing.listed(f"{base}/in"))
    tail.fold_logs(s, f"{base}/in", f"{base}/store", f"{base}/checkpoint", "%m [%p] %u@%d ", SLO, max(2, -(-parts // 4))).awaitTermination()
    return st.as_table(tail.load_store(s, f"{base}/store"))


def _append(plan):
    """Writes files into others, each at a place of its own: a task that runs again does no harm."""

    def run(frames):
        for frame in frames:
            for source, target, place in frame.itertuples(index=False):
                with open(source, "rb") as a, open(os.open(target, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as b:
                    b.seek(int(place))
                    while part := a.read(1 << 20):
                        b.write(part)
            yield frame[["target"]]

    return plan.mapInPandas(run, "target string")


def _written(s, d, base, half):
    """The events' log in two parts for each of its seven files, cut within an entry, each in pieces by its events: {(part, file): pieces in order}."""
    lines = log_lines(s, d).withColumn("part", (F.col("place") >= half * 10 + 3).cast("int")).withColumn("piece", F.floor(F.col("block") / (FILE_EVENTS // 100)))
    parts = max(4, -(-2 * half // FILE_EVENTS))
    keys = ("part", "file", "piece")
    lines.repartition(parts, *keys).sortWithinPartitions(*keys, "place").select(*keys, "value").write.partitionBy(*keys).text(f"{base}/parts")
    out: dict[tuple[int, str], list[tuple[int, growing.Known]]] = {}
    for f in growing.listed(f"{base}/parts"):
        if m := re.search(r"/part=(\d+)/file=(\d+)/piece=(\d+)/part-", f.path):
            out.setdefault((int(m[1]), m[2]), []).append((int(m[3]), f))
    return {k: [f for _, f in sorted(v, key=lambda x: (x[0], x[1].path))] for k, v in out.items()}


def _grow(s, base, parts, part, names):
    """Appends one part of each file to the log of the name given, its pieces side by side."""
    sizes = {f.path: f.size for f in growing.listed(f"{base}/log")}
    rows = []
    for f, name in names.items():
        place = sizes.get(f"{base}/log/{name}", 0)
        for piece in parts.get((part, f), ()):
            rows.append((piece.path, f"{base}/log/{name}", place))
            place += piece.size
    _append(s.createDataFrame(rows, "source string, target string, place long").repartition(max(4, -(-len(rows) // 4)), "source")).write.format("noop").mode("overwrite").save()


def _followed(s, d, between=lambda store: None, checkpoint="a", rotate=True):
    """The log followed in two triggers: between them all files grow, one of them into a new file after it was renamed."""
    base = shared_folder(s)
    half = table(s, d, "events").count() // 2
    parts, names = _written(s, d, base, half), {str(f): f"{f}.log" for f in range(7)}
    fs = s.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{base}/log")
    path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    follow = lambda c, **kw: tail.follow_logs(s, f"{base}/log", f"{base}/store", f"{base}/{c}", "%m [%p] %u@%d ", SLO, chunk_bytes=200_000, **kw).awaitTermination()
    _grow(s, base, parts, 0, names)
    follow("a")
    between(f"{base}/store")
    if rotate:
        last = str((half + 3) % 7)  # not the file that was cut within an entry
        path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).rename(fs.Path(f"{base}/log/{last}.log"), fs.Path(f"{base}/log/{last}.log.1"))
    _grow(s, base, parts, 1, names)
    follow(checkpoint, flush=True)
    return st.as_table(commits.states_of(s, f"{base}/store")).select("database", "calls", "total_ms", "min_ms", "max_ms", "slo_breaches", "first_seen", "last_seen")


SETTINGS = Settings(log_line_prefix="%m [%p] %u@%d ", include_databases=("db0", "db1"), exclude_query_patterns=("FROM click",), slo_threshold_ms=SLO, sample_rate=1.0, backends=("table", "text"), max_query_cardinality=7, retain_days=20, min_duration_ms=0.011)


def _by_settings(s, d):
    """The events' log followed once by SETTINGS, and what a backend holds of the store's families afterwards."""
    base = shared_folder(s)
    _dealt(log_lines(s, d), s, d, "file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{base}/in")
    service.follow(s, f"{base}/in", f"{base}/store", f"{base}/checkpoint", SETTINGS, once=True, flush=True).awaitTermination()
    last = executions(s, d).agg(F.max("ts")).first()[0]
    service.publish(service.exported(s, f"{base}/store", SETTINGS, F.lit(last)), SETTINGS, f"{base}/out")
    # where no group is left there are no files to tell the columns from; totals are there in any case
    found = s.read.schema("labels string, value double, family string").parquet(f"{base}/out/table")
    totals = s.createDataFrame([(None, None, f"tracewell_{x}") for x in ("calls_total", "duration_seconds_bucket", "duration_seconds_total")], found.schema)
    return found.unionByName(totals).groupBy("family").agg(F.count("labels").alias("series"), F.round(F.sum("value"), 4).alias("value"))


def _backends(s, d):
    """Families written to several backends, one of which can't be written to, and read back from another."""
    base = shared_folder(s)
    families = ex.query_families(executions(s, d).withColumn("duration_ms", F.col("slow_ms")))
    CompositeBackend({"broken": TextBackend("nowhere://x"), "table": TableBackend(f"{base}/table")}).write(families)
    return s.read.parquet(f"{base}/table").select("family", "labels", F.round("value", 4).alias("value"))


def _given_up(s, d, cap=10):
    """The events as a stream of three batches in order of time; series of four shards by user, of which ten are kept each."""
    base = shared_folder(s)
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "user_id")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):
        a, b = (lo + (hi - lo) * x / 3 for x in (k, k + 1))
        e.filter((F.col("ts") >= a) & ((F.col("ts") < b) | F.lit(k == 2))).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    series = F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string"))
    gone = recency.given_up_series(stream, series, cap, F.col("user_id") % 4)
    gone.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").select("shard", "series", F.col("last").cast("timestamp_ntz").alias("last"), F.col("given_up").cast("timestamp_ntz").alias("given_up"))


def _followed_sql(which: str) -> str:
    return f"""with {E} select database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms, count(*) filter (duration_ms > {SLO}) as slo_breaches,
            min(date_trunc('millisecond', ts))::timestamp as first_seen, max(date_trunc('millisecond', ts))::timestamp as last_seen from e where {which} group by fingerprint, database"""


QUERIES = {
    "q2_24_settings": Registered(
        _by_settings,
        f"""with {E}, w as (select * from e where database in ('db0', 'db1') and fingerprint not like 'click%'), k as (select fingerprint, database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total, min(duration_ms) as lo,
                max(duration_ms) as hi, max(date_trunc('millisecond', ts)) as z from w group by all),
            s as (select * from (select * from k where z >= (select max(ts) from e) - interval 20 day order by z desc, fingerprint, database limit 7) where lo >= 0.011),
            b as (select w.fingerprint, w.database, {B.format("duration_ms", BOUNDS)} as b from w join s using (fingerprint, database))
            select 'tracewell_calls_total' as family, count(*) as series, sum(calls)::double as value from s
            union all select 'tracewell_duration_seconds_bucket', 10 * (select count(*) from s), sum(10 - b)::double from b
            union all select 'tracewell_duration_' || f || '_seconds', count(*), round(sum(round(v / 1000, 9)), 4) from (select unnest([{{'f': 'mean', 'v': round(total / calls, 6)}}, {{'f': 'min', 'v': lo}}, {{'f': 'max', 'v': hi}}], recursive := true) from s) group by f
            union all select 'tracewell_duration_seconds_total', count(*), round(sum(round(total / 1000, 9)), 4) from s""",
    ),
    "q2_2_22_file_state": Registered(lambda s, d: tail.file_state(_checkpoints(s, d), "/log/5").select("path", "last_modified"), f"with {E} select '/log/5' as path, max(ts)::timestamp as last_modified from e where seq % 17 = 5"),
    "q2_22_32_given_up_series": Registered(
        _given_up,
        """with e as (select user_id % 4 as shard, event_type || '-' || user_id % 20 as series, ts, row_number() over (partition by user_id % 4 order by ts, event_id) as o from events),
            t as (select *, lead(o) over w as later, coalesce(lag(o) over w, 0) as before from e window w as (partition by shard, series order by o)),
            others as (select i.shard, i.series, i.ts as last, i.o, j.ts as given_up, row_number() over (partition by i.shard, i.o order by j.o) as k
                from t i join t j on i.shard = j.shard and j.o > i.o and j.before < i.o and j.series <> i.series and (i.later is null or j.o < i.later))
            select shard, series, last::timestamp as last, given_up::timestamp as given_up from others where k = 10""",
    ),
    "q2_17_5_growing_logs": Registered(_followed, _followed_sql("true")),
    "q2_2_22_resumed_logs": Registered(lambda s, d: _followed(s, d, checkpoint="b"), _followed_sql("true")),
    "q2_2_29_reset_store": Registered(lambda s, d: _followed(s, d, between=lambda store: commits.reset(s, store)), _followed_sql("seq >= (select count(*) // 2 from e)")),
    "q2_17_2_log_stream": Registered(
        lambda s, d: _log_stream(s, d).select("database", "calls", "total_ms", "min_ms", "max_ms", "slo_breaches", "first_seen", "last_seen"),
        f"""with {E} select database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms, count(*) filter (duration_ms > {SLO}) as slo_breaches,
            min(date_trunc('millisecond', ts))::timestamp as first_seen, max(date_trunc('millisecond', ts))::timestamp as last_seen from e group by fingerprint, database""",
    ),
    "q2_2_1_export_rows": Registered(
        lambda s, d: _round_trip(s, d).select("fingerprint", "database", "calls", "total_ms", "mean_ms", "stddev_ms", F.size("sample").alias("n_sample"), F.size("histogram").alias("n_hours"), F.round(F.aggregate("sample", F.lit(0.0), lambda a, x: a + x), 2).alias("sample_ms")),
        f"""with {E}, {STATS}, {HOURLY}, x as (select {G}, cast(count(*) as integer) as n_sample, round(sum(duration_ms), 2) as sample_ms from (select * from e qualify row_number() over (partition by {G} order by seq) <= 100) group by {G}),
            y as (select {G}, cast(count(*) as integer) as n_hours from h group by {G})
            select {G}, calls, total_ms, mean_ms, stddev_ms, n_sample, n_hours, sample_ms from s join x using ({G}) join y using ({G})""",
    ),
    "q2_2_8_import_histogram": Registered(lambda s, d: ex.histogram_rows(_round_trip(s, d)), f"with {E}, {HOURLY} select {G}, bucket, calls, total_ms from h"),
    "q2_2_2_redact": Registered(
        lambda s, d: ex.redact(ex.export_rows(executions(s, d)).withColumns({"original_query": F.lit("x"), "plan": F.lit("y"), "normalized_query": F.when(F.col("database") == "db0", "SELECT $1").otherwise("SELECT 1")})).select("fingerprint", "database", "normalized_query", "original_query", "plan"),
        f"with {E} select distinct {G}, case when database = 'db0' then 'SELECT $1' else '' end as normalized_query, '' as original_query, '' as plan from e",
    ),
    "q2_23_metric_families": Registered(
        lambda s, d: ex.metric_families(g.group_stats(executions(s, d)), g.cumulative_buckets(g.bucket_counts(executions(s, d).withColumn("duration_ms", F.col("slow_ms"))))).groupBy("family").agg(F.count("*").alias("series"), F.round(F.sum("value"), 6).alias("value")),
        f"""with {E}, {STATS}, x as (select {SLOW} as b from e), i as (select count(*) as n from s)
            select 'tracewell_calls_total' as family, count(*) as series, sum(calls)::double as value from s
            union all select 'tracewell_duration_seconds_bucket', 10 * (select n from i), sum(10 - b)::double from x
            union all select 'tracewell_duration_' || k || '_seconds', count(*), round(sum(round(v / 1000, 9)), 6) from (select unnest([{{'k': 'mean', 'v': mean_ms}}, {{'k': 'min', 'v': min_ms}}, {{'k': 'max', 'v': max_ms}}], recursive := true) from s) group by k
            union all select 'tracewell_duration_seconds_total', count(*), round(sum(round(total_ms / 1000, 9)), 6) from s""",
    ),
    "q2_23_query_families": Registered(
        lambda s, d: ex.query_families(executions(s, d).withColumn("duration_ms", F.col("slow_ms"))).select("family", "labels", F.round("value", 4).alias("value")),
        f"""with {E}, y as (select * replace (slow_ms as duration_ms) from e), x as (select fingerprint, database, {SLOW} as b, duration_ms from y),
            t as (select cast(sum(cast(duration_ms as decimal(18,2))) as double) as g from y),
            s as (select fingerprint, database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total, round(coalesce(stddev_samp(duration_ms), 0), 6) as sd, min(ts) as a, max(ts) as z,
                quantile_cont(duration_ms, 0.95) as p95, quantile_cont(duration_ms, 0.99) as p99 from y group by all),
            v as (select {_HASH} as l, calls, unnest([{{'family': 'query_duration_seconds_sum', 'v': total / 1000}}, {{'family': 'query_duration_seconds_count', 'v': calls::double}}, {{'family': 'query_latency_cv', 'v': round(sd / round(total / calls, 6), 6)}},
                {{'family': 'query_total_time_share_pct', 'v': round(total * 100 / g, 6)}}, {{'family': 'query_latency_p95_ms', 'v': round(p95, 6)}}, {{'family': 'query_latency_p99_ms', 'v': round(p99, 6)}},
                {{'family': 'query_first_seen_seconds', 'v': epoch_us(a) / 1e6}}, {{'family': 'query_last_seen_seconds', 'v': epoch_us(z) / 1e6}}], recursive := true) from s, t)
            select 'tracewell_' || family as family, l || '}}' as labels, round(v, 4) as value from v
            union all select 'tracewell_query_executions_total', {_HASH} || ',status="success"}}', calls::double from s
            union all select 'tracewell_query_duration_seconds_bucket', {_HASH} || ',le="' || {_LE} || '"}}', (select count(*) from x where x.fingerprint = i.fingerprint and x.database = i.database and x.b < r.b)::double
                from (select distinct fingerprint, database from y) i, range(1, 11) r(b)
            union all select 'tracewell_slow_queries_total', '{{database="' || database || '",threshold="' || k || 's"}}', count(*) filter (duration_ms >= k * 1000)::double from y, (values (1), (5), (10), (30)) h(k) group by database, k""",
    ),
    "q2_23_plan_families": Registered(
        lambda s, d: ex.plan_families(_plans(s, d)),
        f"""with {N}, m as (select *, 'f' || plan_id % 7 as fingerprint, 'db' || plan_id % 3 as database, total_cost / 50 as cost from n)
            select 'tracewell_query_plan_cost_bucket' as family, {_HASH} || ',le="' || t || '"}}' as labels, count(*) filter (cost <= u)::double as value from m,
                (values ('0.01', 0.01), ('0.1', 0.1), ('1', 1.0), ('10', 10.0), ('100', 100.0), ('1000', 1000.0), ('10000', 10000.0), ('100000', 100000.0), ('+Inf', 1e300)) h(t, u) where depth = 0 group by all
            union all select 'tracewell_query_' || category || '_types_total', '{{' || category || '_type="' || lower(regexp_replace(kind, '([a-z])([A-Z])', '\\1_\\2', 'g')) || '",database="' || database || '"}}', count(*)::double
                from m where category in ('scan', 'join') group by category, kind, database""",
    ),
    "q2_23_run_families": Registered(
        lambda s, d: ex.run_families(_runs(s, d)).select("family", "labels", F.round("value", 3).alias("value")),
        f"""with {E}, r as (select '/log/' || seq % 3 as pattern, case when seq % 9 = 0 then 'error' else 'success' end as status, case when seq % 9 = 0 then case when seq % 2 = 0 then 'file_error' else 'parse_error' end end as error_type,
                duration_ms / 1000 as seconds, epoch_us(ts) + seq as ended from e)
            select 'tracewell_logs_parsed_total' as family, '{{log_path_pattern="' || pattern || '",status="' || status || '"}}' as labels, count(*)::double as value from r group by pattern, status
            union all select 'tracewell_parse_errors_total', '{{log_path_pattern="' || pattern || '",error_type="' || error_type || '"}}', count(*)::double from r where error_type is not null group by pattern, error_type
            union all select 'tracewell_export_duration_seconds_sum', '', round(sum(seconds), 3) from r
            union all select 'tracewell_last_successful_parse_timestamp', '', round(max(ended) filter (status = 'success') / 1e6, 3) from r
            union all select 'tracewell_exporter_up', '', arg_max((status = 'success')::int, ended)::double from r""",
    ),
    "q2_2_21_file_states": Registered(
        lambda s, d: _checkpoints(s, d).select("path", "position", "last_modified"),
        f"""with {E}, f as (select '/log/' || seq % 17 as path, seq % 17 as k, ts, seq * 10 as position from e) select path, arg_max(position, (ts, position)) as position, max(ts)::timestamp as last_modified from f where k <> 3 group by path""",
    ),
    "q2_2_26_cleanup_files": Registered(
        lambda s, d: tail.cleanup_files(_checkpoints(s, d), "2024-01-30 12:00:00").select("path", "last_modified"),
        f"with {E} select '/log/' || seq % 17 as path, max(ts)::timestamp as last_modified from e where seq % 17 <> 3 group by all having max(ts) >= timestamp '2024-01-30 12:00:00'",
    ),
    "q2_2_28_last_run": Registered(lambda s, d: tail.last_run(_checkpoints(s, d), F.current_timestamp()), f"with {E} select max(ts)::timestamp as last_run from e where seq % 17 <> 3"),
    "q2_17_11_stream_fold": Registered(_streamed, f"with {E}, {STATE} select * exclude (latency_buckets) from z"),
}
QUERIES["q2_2_13_backends"] = Registered(_backends, QUERIES["q2_23_query_families"].sql)
