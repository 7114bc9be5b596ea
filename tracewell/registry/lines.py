"""Queries over log lines that are written from events, so that the events' own columns are the expected result."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.prefix import parse_prefix
from ..session import deal_by_size, shared_folder
from ..sources import logs, ranges
from ..sources.growing import GrowingReader, file_system, listed
from .data import E, Registered, executions, table

PREFIX = "%m [%p] %u@%d "
TOKENS = ("UTC", "PDT", "+05:30", "IST", "-0330", "XYZ", "+02", "CEST")
_OFFSETS = (0, -7 * 3600, 19800, 19800, -12600, 0, 7200, 7200)


def stamped(s, d):
    e = executions(s, d)
    deal_by_size(table(s, d, "events"), 4)  # an event is several lines
    token, off = F.lit(None), F.lit(0)
    for i, (t, o) in enumerate(zip(TOKENS, _OFFSETS, strict=True)):
        token = F.when(F.col("seq") % 8 == i, t).otherwise(token)
        off = F.when(F.col("seq") % 8 == i, o).otherwise(off)
    wall = F.col("ts") + F.make_dt_interval(secs=off)
    return e.withColumn("token", token).withColumn("stamp", F.concat(F.date_format(wall.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), token))


def _offsets(s, d):
    """Numeric zone tokens of every event: +HH, +HHMM, +HH:MM, and two shapes that are none."""
    e, n = executions(s, d), F.col("seq")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = n % 20, n % 70
    tail = F.when(n % 5 == 1, two(minutes)).when(n % 5 == 2, F.concat(F.lit(":"), two(minutes))).when(n % 5 == 4, "X").otherwise("")
    return e.select("seq", F.concat(F.when(n % 2 == 0, "+").otherwise("-"), F.when(n % 5 == 3, (hours % 10).cast("string")).otherwise(two(hours)), tail).alias("t"))


def log_lines(s, d):
    """The events as a log of seven files in several blocks: header, statement of two lines, plan of two nodes, noise."""
    e = stamped(s, d)
    prefix = F.concat(F.col("stamp"), F.lit(" [7] u@"), F.col("database"), F.lit(" LOG:  "))
    head = F.concat(prefix, F.lit("duration: "), F.col("duration_ms").cast("string"), F.lit(" ms  plan:"))
    body = F.array(
        head, F.concat(F.lit("\tQuery Text: SELECT * FROM "), F.col("fingerprint")), F.concat(F.lit("\tWHERE id = "), F.col("seq").cast("string")),
        F.concat(F.lit("\tLimit  (cost=0.10.."), F.col("duration_ms").cast("string"), F.lit(" rows=10 width=8)")), F.lit("\t  ->  Seq Scan on t  (cost=0.00..1.00 rows=10 width=8)"),
        F.concat(F.col("stamp"), F.lit(" [7] u@"), F.col("database"), F.lit(" LOG:  checkpoint starting")),
    )
    rows = e.select((F.col("seq") % 7).cast("string").alias("file"), "seq", F.posexplode(body).alias("k", "value"))
    return rows.select("file", F.floor(F.col("seq") / 100).cast("long").alias("block"), (F.col("seq") * 10 + F.col("k")).alias("place"), "value")


def _entries(s, d):
    return logs.entries(log_lines(s, d), PREFIX)


def mixed_log(s, d):
    """The events as entries with a text plan, a JSON plan that holds the statement, and none, in turn; the statement has the event's number."""
    e = stamped(s, d)
    prefix = F.concat(F.col("stamp"), F.lit(" [7] u@"), F.col("database"), F.lit(" LOG:  duration: "), F.col("duration_ms").cast("string"), F.lit(" ms  plan:"))
    said = F.concat(F.lit("select * from "), F.col("fingerprint"), F.lit(" where id = "), F.col("seq").cast("string"))
    json = F.concat(F.lit('\t  "Query Text": "'), said, F.lit('",'))
    body = F.when(F.col("seq") % 3 == 0, F.array(prefix, F.concat(F.lit("\tQuery Text: "), said), F.lit("\tSeq Scan on t  (cost=0.00..1.00 rows=10 width=8)")))
    body = body.when(F.col("seq") % 3 == 1, F.array(prefix, F.lit("\t{"), json, F.lit('\t  "Plan": {"Node Type": "Seq Scan", "Relation Name": "t", "Total Cost": 1.5, "Plan Rows": 10, "Plan Width": 8}'), F.lit("\t}")))
    body = body.otherwise(F.array(prefix, F.concat(F.lit("\tQuery Text: "), said)))
    rows = e.select((F.col("seq") % 5).cast("string").alias("file"), "seq", F.posexplode(body).alias("k", "value"))
    return rows.select("file", F.floor(F.col("seq") / 100).cast("long").alias("block"), (F.col("seq") * 10 + F.col("k")).alias("place"), "value")


_STAMP_MS = "date_trunc('millisecond', ts)::timestamp"

#: Events in each part of a log that is written, on average.
FILE_EVENTS = 200_000


def _compressed(s, d):
    """The log in gzip members and bzip2 blocks, without names that say so, read in small ranges."""
    base = shared_folder(s)
    events = table(s, d, "events").count()
    parts = max(3, -(-events // FILE_EVENTS))
    for k, codec in ((0, "gzip"), (1, "bzip2")):
        rows = log_lines(s, d).filter(F.col("file").cast("int") % 2 == k).repartition(parts, "file", F.floor(F.col("block") / (FILE_EVENTS // 100))).sortWithinPartitions("file", "place")
        rows.select("file", "value").write.partitionBy("file").option("compression", codec).mode("append").text(f"{base}/in")
    found = logs.entries(logs.read_lines_by_content(s, f"{base}/in", chunk_bytes=min(max(events // 2, 5000), 32 << 20)), PREFIX)
    return found.groupBy("database").agg(F.count("*").alias("calls"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double").alias("total_ms"))


def _replanned(s, d):
    """Plans put together again from their lines' indents and contents."""
    rows = log_lines(s, d).withColumn("line", F.regexp_replace("value", "^\t", "")).filter(F.col("line").contains("(cost="))
    lines = F.array_sort(F.collect_list(F.struct("place", ln.indent("line").alias("n"), F.ltrim("line").alias("c"))))
    plans = rows.groupBy(F.floor(F.col("place") / 10).alias("seq")).agg(lines.alias("l"))
    return plans.select("seq", ln.plan_text_of(F.col("l.n"), F.col("l.c")).alias("plan"))


def _ranges(s, d):
    """The log as files of whole entries, each read in two ranges of bytes that are cut anywhere: lines come once, entries are whole if both are read."""
    base = shared_folder(s)
    files = -(-table(s, d, "events").count() // FILE_EVENTS)
    mixed_log(s, d).repartition(max(files, 1), "file", "block").sortWithinPartitions("file", "block", "place").select("value").write.text(f"{base}/in")
    found = [f for f in listed(f"{base}/in") if "/part-" in f.path and f.size]
    # a range begins where a line does, here within an entry
    cuts = [GrowingReader._last_line_end(replace(f, size=f.size * 2 // 5), file_system(f.path)[0], 0) for f in found]
    block = min(max(sum(f.size for f in found) // 64, 20_000), 32 << 20)
    ranges.register(s)
    one, two = ([(f.path, 0, cut) for f, cut in zip(found, cuts, strict=True) if cut], [(f.path, cut, f.size) for f, cut in zip(found, cuts, strict=True)])
    one, two = (s.read.format("logrange").options(ranges=json.dumps(x), blockBytes=block).load() for x in (one, two))
    both = one.unionByName(two)
    return logs.log_groups(both, PREFIX, without_plan=True).select("normalized_query", "database", "calls", "max_ms", "p95_ms")


QUERIES = {
    "q2_1_13_ranges_to_groups": Registered(
        _ranges, f"with {E} select 'SELECT * FROM ' || fingerprint || ' WHERE id = $1' as normalized_query, database, count(*) as calls, max(duration_ms) as max_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms from e group by fingerprint, database"
    ),
    "q2_1_18_zone_overrides": Registered(
        lambda s, d: stamped(s, d).select("seq", ln.utc_timestamp("stamp", {"XYZ": 3600}).alias("ts"), ln.utc_timestamp("stamp", None, -7200).alias("fixed")),
        f"""with {E} select seq, {{0}} - case when seq % 8 = 5 then interval 1 hour else interval 0 hour end as ts, {{0}} + case when seq % 8 in (2, 4, 6) then 0 else list_value(0,-25200,19800,19800,-12600,0,7200,7200)[seq % 8 + 1] + 7200 end * interval 1 second as fixed from e""".format("date_trunc('millisecond', ts)::timestamp"),
    ),
    "q2_3_8_leading_space": Registered(
        lambda s, d: executions(s, d).select("seq", F.concat(F.repeat(F.lit(" "), (F.col("seq") % 7).cast("int")), F.when(F.col("seq") % 3 == 0, "\t").otherwise(""), F.lit("x y")).alias("v")).select("seq", ln.indent("v").alias("n")),
        f"with {E} select seq, cast(seq % 7 + (seq % 3 = 0)::integer as integer) as n from e",
    ),
    "q2_3_31_plan_format": Registered(
        lambda s, d: table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("  ["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 2, F.lit("Seq Scan {")).otherwise(F.col("props")).alias("v")).select("seq", ln.plan_format("v").alias("form"), ln.looks_like_json("v").alias("begins")),
        "select event_id as seq, case when event_id % 2 = 1 then 'json' else 'text' end as form, event_id % 4 <> 2 as begins from events",
    ),
    "q2_1_3_compressed_logs": Registered(_compressed, f"with {E} select database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms from e group by database"),
    "q2_3_24_plan_lines": Registered(
        lambda s, d: _replanned(s, d).select("seq", F.length("plan").alias("n"), F.substring_index("plan", "\n", -1).alias("last")),
        f"with {E} select seq, cast(length('Limit  (cost=0.10..' || duration_ms || ' rows=10 width=8)') + 55 as integer) as n, '  ->  Seq Scan on t  (cost=0.00..1.00 rows=10 width=8)' as last from e",
    ),
    "q2_3_1_split_log_line": Registered(
        lambda s, d: stamped(s, d).select("seq", F.concat("stamp", F.lit(" LOG: x")).alias("v")).select("seq", ln.timestamp_text("v").alias("stamp"), ln.message("v").alias("message")),
        f"""with {E}, t as (select *, list_value('UTC','PDT','+05:30','IST','-0330','XYZ','+02','CEST')[seq % 8 + 1] as token, list_value(0,-25200,19800,19800,-12600,0,7200,7200)[seq % 8 + 1] as o from e)
            select seq, strftime(ts + o * interval 1 second, '%Y-%m-%d %H:%M:%S.%g') || ' ' || token as stamp, ' LOG: x' as message from t""",
    ),
    "q2_3_16_timestamp_utc": Registered(lambda s, d: stamped(s, d).select("seq", ln.utc_timestamp("stamp").alias("ts")), f"with {E} select seq, {_STAMP_MS} as ts from e"),
    "q2_3_12_cost_tuple": Registered(
        lambda s, d: log_lines(s, d).select(ln.cost_tuple("value").alias("c"), "value").filter("c is not null").select(F.round("c.total_cost", 6).alias("total_cost"), "c.est_rows", "c.width", ln.plan_level(F.regexp_replace("value", "^\t", "")).alias("level")),
        f"with {E} select x.* from e, lateral (values (duration_ms, 10::bigint, 8, 0), (1.0::double, 10::bigint, 8, 1)) x(total_cost, est_rows, width, level)",
    ),
    "q2_3_19_numeric_offset": Registered(
        lambda s, d: _offsets(s, d).select("seq", "t", ln.numeric_offset("t").alias("seconds")),
        f"""with {E}, x as (select seq, case when seq % 2 = 0 then '+' else '-' end as g, seq % 20 as h, seq % 70 as m, seq % 5 as k from e),
            t as (select *, g || case k when 3 then cast(h % 10 as varchar) else printf('%02d', h) end || case k when 1 then printf('%02d', m) when 2 then ':' || printf('%02d', m) when 4 then 'X' else '' end as t from x)
            select seq, t, cast(case when k < 3 and h <= 15 and (k = 0 or m <= 59) then case g when '-' then -1 else 1 end * (h * 3600 + case k when 0 then 0 else m * 60 end) end as integer) as seconds from t""",
    ),
    "q2_3_28_prefix_database": Registered(
        lambda s, d: log_lines(s, d).filter(F.col("value").contains("checkpoint")).select(parse_prefix(PREFIX).database(ln.message("value")).alias("database")).groupBy("database").agg(F.count("*").alias("n")),
        f"with {E} select database, count(*) as n from e group by database",
    ),
    "q2_4_entry_assembly": Registered(
        lambda s, d: _entries(s, d).select("ts", "duration_ms", "database", "query_text", "plan_format"),
        f"with {E} select {_STAMP_MS} as ts, duration_ms, database, 'SELECT * FROM ' || fingerprint || chr(10) || 'WHERE id = ' || seq as query_text, 'text' as plan_format from e",
    ),
    "q2_4_entries_to_groups": Registered(
        lambda s, d: _entries(s, d).groupBy("database").agg(F.count("*").alias("calls"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).cast("double").alias("total_ms")),
        f"with {E} select database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms from e group by database",
    ),
    "q2_16_13_entry_numbers": Registered(
        lambda s, d: logs.number_entries(log_lines(s, d)).groupBy("file").agg(F.max("entry").alias("entries"), F.count("*").alias("lines")),
        f"with {E} select cast(seq % 7 as varchar) as file, count(*) * 2 as entries, count(*) * 6 as lines from e group by all",
    ),
    "q2_1_12_log_to_groups": Registered(
        lambda s, d: logs.log_groups(mixed_log(s, d), PREFIX, without_plan=True).select("normalized_query", "database", "calls", "total_ms", "min_ms", "max_ms", "mean_ms", "p50_ms", "first_ts", "last_ts"),
        f"""with {E} select 'SELECT * FROM ' || fingerprint || ' WHERE id = $1' as normalized_query, database, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms, min(duration_ms) as min_ms,
            max(duration_ms) as max_ms, round(cast(sum(cast(duration_ms as decimal(18,2))) as double) / count(*), 6) as mean_ms, round(quantile_cont(duration_ms, 0.5), 6) as p50_ms, min({_STAMP_MS}) as first_ts, max({_STAMP_MS}) as last_ts
            from e group by fingerprint, database""",
    ),
    "q2_1_21_entries_without_plan": Registered(
        lambda s, d: logs.entries(mixed_log(s, d), PREFIX, without_plan=True).select("duration_ms", "query_text", "plan_format", F.col("plan_text").isNotNull().alias("has_plan")),
        f"with {E} select duration_ms, 'select * from ' || fingerprint || ' where id = ' || seq as query_text, (['text', 'json', null])[seq % 3 + 1] as plan_format, seq % 3 < 2 as has_plan from e",
    ),
}
