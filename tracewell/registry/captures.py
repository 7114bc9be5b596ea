"""Queries over captures made of the events, typed plan nodes, and backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.parse import node_table
from ..plans.typed import typed
from ..sources import backends, captures
from ..sources import export as ex
from .data import E, Registered, executions, table
from .groups import SLO
from .plans import text_plans


def _captures(s, d):
    """Every event as a capture: a statement by type and number, every third without a plan, some with a broken one, query ids of some."""
    e = executions(s, d)
    plan = F.when(F.col("seq") % 3 == 0, "  ").when(F.col("seq") % 31 == 1, "no plan at all").otherwise("Seq Scan on t  (cost=0.00..1.00 rows=10 width=8)")
    sql = F.concat(F.lit("select * from t_"), F.col("fingerprint"), F.lit(" where id = "), F.col("seq").cast("string"))
    number = F.when(F.col("seq") % 4 == 0, 0).otherwise(F.length("fingerprint").cast("long") * 100)
    return e.select("ts", "duration_ms", sql.alias("query_text"), plan.alias("plan_text"), number.alias("query_id"), "database", (F.col("seq") % 900 + 100).alias("overhead_ns"))


_C = E + """, c as (select *, seq % 31 = 1 and seq % 3 <> 0 as broken, case when seq % 4 = 0 then 0 else length(fingerprint) * 100 end as query_id, 'SELECT * FROM t_' || fingerprint || ' WHERE id = $1' as normalized_query from e)"""
_LABELS = """(['Seq Scan on s."t' || node_id || '"', 'Index Scan using ix' || node_id || ' on t' || node_id])"""


def _server(s, d):
    return table(s, d, "region").select((F.col("r_regionkey") * 100 + 400).alias("query_id"), (F.col("r_regionkey") + 1).cast("long").alias("calls"), (F.col("r_regionkey") * 10.0).alias("total_ms"), (F.col("r_regionkey") * 7).cast("long").alias("rows"))


def _typed(s, d):
    """Text plans of one node for each order, of nine kinds with their property lines."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey").cast("string")
    plans = [F.concat(F.lit(f"{head}  (cost=0.00..1.00 rows=10 width=8)"), *[F.concat(F.lit(f"\n  {p}: "), F.lit(v) if not n else F.concat(F.lit(v), k)) for p, v, n in props]) for head, props in _KINDS]
    return typed(node_table(o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*plans), (F.col("o_orderkey") % len(_KINDS)).cast("int") + 1).alias("plan_text")), "plan_text", "id"))


#: Node lines with (property, value, whether the order's key follows).
_KINDS = (
    ("Bitmap Heap Scan on t", (("Recheck Cond", "x = ", True),)), ("Gather Merge", (("Workers Planned", "2", False), ("Workers Launched", "1", False))), ("Nested Loop", (("Inner Unique", "true", False),)),
    ("Hash Join", (("Hash Cond", "a = ", True),)), ("Merge Join", (("Merge Cond", "b = ", True),)), ("GroupAggregate", (("Group Key", "a, b", True), ("Output", "sum(x), f(y)", False))), ("Sort", (("Sort Key", "a DESC, b", True), ("Sort Method", "quicksort  Memory: 25kB", False))),
    ("Limit 10 offset 5", ()), ("Memoize", (("Cache Key", "t.", True), ("Cache Mode", "logical", False))), ("SubPlan 7", ()),
)


def _otlp(s, d):
    """Points read back from their JSON: name, whether they are counters, labels and value."""
    points = backends.otlp_points(ex.query_families(executions(s, d).withColumn("duration_ms", F.col("slow_ms"))))
    kind = "array<struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>,asDouble:double>>"
    x = points.select(F.from_json("json", f"struct<name:string,sum:struct<dataPoints:{kind},isMonotonic:boolean>,gauge:struct<dataPoints:{kind}>>").alias("j"))
    p = F.coalesce("j.sum.dataPoints", "j.gauge.dataPoints")[0]
    labels = F.concat(F.lit("{"), F.array_join(F.transform(p["attributes"], lambda a: F.concat(a["key"], F.lit('="'), a["value"]["stringValue"], F.lit('"'))), ","), F.lit("}"))
    return x.select(F.col("j.name").alias("name"), F.coalesce("j.sum.isMonotonic", F.lit(False)).alias("monotonic"), labels.alias("labels"), F.round(p["asDouble"], 4).alias("value"))


def _otlp_sql():
    from .sinks import QUERIES as sinks

    return f"select family as name, regexp_matches(family, '_(total|count|sum|bucket)$') as monotonic, labels, value from ({sinks['q2_23_query_families'].sql})"


QUERIES = {
    "q2_1_20_captured_plans": Registered(
        lambda s, d: captures.captured_executions(_captures(s, d)).select("duration_ms", "query_id", "normalized_query", F.size("nodes").alias("n")).withColumn("n", F.greatest("n", F.lit(0))),
        f"with {_C} select duration_ms, query_id::bigint as query_id, normalized_query, (seq % 3 <> 0)::integer as n from c where not broken",
    ),
    "q2_8_12_aggregate_captures": Registered(
        lambda s, d: captures.aggregate_captures(_captures(s, d), SLO).select("database", "normalized_query", "query_id", "calls", F.col("total_ms").cast("double").alias("total_ms"), "min_ms", "max_ms", "slo_breaches"),
        f"""with {_C} select database, normalized_query, (length(fingerprint) * 100)::bigint as query_id, count(*) as calls, cast(sum(cast(duration_ms as decimal(18,2))) as double) as total_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
            count(*) filter (duration_ms > {SLO}) as slo_breaches from c where not broken group by database, normalized_query, fingerprint""",
    ),
    "q2_12_14_server_statistics": Registered(
        lambda s, d: captures.with_server_statistics(captures.aggregate_captures(_captures(s, d)), _server(s, d)).select("database", "normalized_query", "calls", "server_calls", "server_total_ms", "rows_per_call"),
        f"""with {_C}, g as (select database, normalized_query, length(fingerprint) * 100 as query_id, count(*) as calls from c where not broken group by database, normalized_query, fingerprint)
            select database, normalized_query, calls, r_regionkey + 1 as server_calls, (r_regionkey * 10)::double as server_total_ms, round(r_regionkey * 7 / (r_regionkey + 1)::double, 6) as rows_per_call from g join region on query_id = r_regionkey * 100 + 400""",
    ),
    "q2_1_30_wanted": Registered(
        lambda s, d: captures.wanted(_captures(s, d), 50.0, 1.0).groupBy("database").agg(F.count("*").alias("n")).unionByName(captures.wanted(_captures(s, d), 50.0, 0.0).groupBy("database").agg(F.count("*").alias("n"))),
        f"with {E} select database, count(*) as n from e where duration_ms >= 50 group by database",
    ),
    "q2_1_33_sampled": Registered(
        lambda s, d: _captures(s, d).filter(captures.sampled(0.3, "query_text", "query_id")).groupBy("database", "query_id").agg(F.count("*").alias("n"), F.max("query_text").alias("last")),
        f"""with {_C}, t as (select database, query_id::bigint as query_id, 'select * from t_' || fingerprint || ' where id = ' || seq as q from c)
            select database, query_id, count(*) as n, max(q) as last from t where ('0x' || substr(md5(q || '|' || query_id), 1, 8))::bigint / 4294967296.0 < 0.3 group by database, query_id""",
    ),
    "q2_8_19_overhead": Registered(
        lambda s, d: captures.overhead(_captures(s, d), "overhead_ns", "database"),
        f"with {E} select database, count(*) as captures, round(avg(seq % 900 + 100), 6) as mean_ns, min(seq % 900 + 100) as min_ns, max(seq % 900 + 100) as max_ns, round(stddev_pop(seq % 900 + 100), 6) as stddev_ns from e group by database",
    ),
    "q2_7_22_too_many_groups": Registered(lambda s, d: captures.too_many_groups(executions(s, d), 10), f"with {E} select count(distinct (fingerprint, database)) as groups, count(distinct (fingerprint, database)) >= 10 as too_many from e"),
    "q2_5_15_typed_nodes": Registered(
        lambda s, d: _typed(s, d).select(
            "id", "label", "recheck_condition", "workers_planned", "workers_launched", "inner_unique", "hash_condition", "merge_condition", F.array_join("group_keys", "|").alias("group_keys"), F.array_join("functions", "|").alias("functions"),
            F.array_join(F.transform("sort_keys", lambda x: x.expression), "|").alias("sort_keys"), "sort_method", "limit_count", "limit_offset", "cache_key", "cache_mode", "subplan",
        ),
        """with o as (select o_orderkey as id, o_orderkey % 10 as k from orders) select id, (['Bitmap Heap Scan on t', 'Gather Merge', 'Nested Loop', 'Hash Join', 'Merge Join', 'GroupAggregate', 'Sort', 'Limit 10 offset 5', 'Memoize', 'SubPlan 7'])[k + 1] as label,
            case k when 0 then 'x = ' || id end as recheck_condition, case k when 1 then 2 end as workers_planned, case k when 1 then 1 end as workers_launched, case k when 2 then true end as inner_unique, case k when 3 then 'a = ' || id end as hash_condition,
            case k when 4 then 'b = ' || id end as merge_condition, null::varchar as group_keys, case k when 5 then 'sum' end as functions, case k when 6 then 'a|b' || id end as sort_keys, case k when 6 then 'quicksort' end as sort_method,
            case k when 7 then 10::bigint end as limit_count, case k when 7 then 5::bigint end as limit_offset, case k when 8 then 't.' || id end as cache_key, case k when 8 then 'logical' end as cache_mode, case k when 9 then '7' end as subplan from o""",
    ),
    "q2_2_12_otlp_points": Registered(_otlp, _otlp_sql()),
}
