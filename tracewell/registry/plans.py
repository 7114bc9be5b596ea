"""Queries over plan trees built from lineitem: the lines of an order are the nodes of a binary tree, heap-numbered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import engine, rules
from ..operators.config import DEFAULT
from ..plans import nodes as n
from ..plans import properties as pr
from ..plans.parse import node_table
from .data import Registered, table

KINDS = ("SeqScan", "IndexScan", "BitmapHeapScan", "NestedLoop", "HashJoin", "MergeJoin", "Sort", "Materialize", "HashAggregate")
_CATEGORY = ("scan", "scan", "scan", "join", "join", "join", "utility", "utility", "aggregate")


def _known(*pairs):
    """A map of the names whose values aren't null, in compiled code and made at once; no value is empty."""
    names, values = zip(*[(F.when(v.isNotNull(), name).otherwise(""), F.coalesce(v, F.lit(""))) for name, v in zip(pairs[::2], pairs[1::2], strict=True)])
    return F.map_from_arrays(F.array_remove(F.array(*names), ""), F.array_remove(F.array(*values), ""))


def plan_nodes(s, d):
    """Node table with 1-based heap numbers, so that a node's parent is half its number and its path the bits below the first.

    As parsed nodes do, they carry the estimates of their two children.
    """
    line = table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = (F.col("l_suppkey") % 9).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), k + 1)
    depth = F.length(F.bin("node_id")) - 1
    path = F.when(depth > 0, F.split(F.substring(F.bin("node_id"), F.lit(2), depth), "").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    total = F.floor(F.col("l_extendedprice") * 20).cast("double")
    odd = F.col("l_partkey") % 2 == 1
    props = _known(
        F.lit("Filter"), F.when(F.col("l_partkey") % 3 == 0, "lower(x) = 1").when(F.col("l_partkey") % 3 == 1, "y LIKE '%a'"),
        F.lit("Rows Removed by Filter"), (F.col("l_partkey") * 100).cast("string"), F.lit("Heap Fetches"), F.when(odd, (F.col("l_partkey") * 10).cast("string")),
        F.lit("Sort Method"), F.when(k == 6, "external merge"), F.lit("Sort Space Used"), F.concat((F.col("l_partkey") * 100).cast("string"), F.lit("kB")),
        F.lit("Batches"), F.when(k == 4, (F.col("l_linenumber") * 2).cast("string")),
    )
    rows, width = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint"), (F.col("l_linenumber") * 100).cast("int")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = line.withColumns({"node_id": F.row_number().over(w), "_all": F.collect_list(F.struct(rows.alias("r"), width.alias("w"))).over(every)})
    left, right = F.get("_all", 2 * F.col("node_id") - 1), F.get("_all", 2 * F.col("node_id"))
    return x.select(
        left["r"].alias("left_est_rows"), left["w"].alias("left_width"), right["r"].alias("right_est_rows"), right["w"].alias("right_width"),
        F.col("l_orderkey").alias("plan_id"), "node_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2).cast("int")).alias("parent_id"), path.alias("path"), depth.alias("depth"),
        pick(_CATEGORY).alias("category"), pick(KINDS).alias("kind"), total.alias("total_cost"), F.floor(total * F.col("l_quantity") / 50).cast("double").alias("startup_cost"),
        F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint").alias("est_rows"), (F.col("l_linenumber") * 100).cast("int").alias("width"),
        F.when(odd, F.col("l_partkey")).alias("actual_rows"), F.when(odd, F.lit(1)).alias("actual_loops"), props.alias("props"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


N = f"""l as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as integer) as node_id from lineitem),
    n as (select l_orderkey as plan_id, node_id, case when node_id > 1 then node_id // 2 end as parent_id, cast(floor(log2(node_id)) as integer) as depth,
      ({_list(_CATEGORY)})[l_suppkey % 9 + 1] as category, ({_list(KINDS)})[l_suppkey % 9 + 1] as kind, floor(l_extendedprice * 20) as total_cost,
      floor(floor(l_extendedprice * 20) * l_quantity / 50) as startup_cost, cast(floor(l_extendedprice * l_quantity) as bigint) as est_rows, cast(l_linenumber * 100 as integer) as width,
      case when l_partkey % 2 = 1 then l_partkey end as actual_rows, case l_partkey % 3 when 0 then 'lower(x) = 1' when 1 then 'y LIKE ''%a''' end as flt,
      l_partkey * 100 as removed, case when l_partkey % 2 = 1 then l_partkey * 10 end as fetches, l_suppkey % 9 = 6 as external, l_partkey * 100 as space,
      case when l_suppkey % 9 = 4 then l_linenumber * 2 end as batches from l)"""


def class_of(v: str, t=DEFAULT.rows) -> str:
    return f"case when {v} >= {t[2]} then 3 when {v} >= {t[1]} then 2 when {v} >= {t[0]} then 1 else 0 end"


ROWS_CLASS, COST_CLASS = class_of("est_rows"), class_of("total_cost", DEFAULT.cost)
_SEV = "(['Low','Medium','High','Critical'])[{0} + 1]"
MEMORY = """(((least(lr, rr)::double * least(lw, rw) + 24 * least(lr, rr)::double + 8 * greatest(1.5 * least(lr, rr)::double, 1024.0)) * 1.12
    + 1024 * greatest(least(lr, rr)::double / 10000, 1.0)) / 1024 * 1.1 / 4096)"""
NODE_RULES = (
    ("RowEstimation", "excessive_rows", _SEV.format("r"), "r >= 1"),
    ("RowEstimation", "cartesian", "'Critical'", "kind = 'NestedLoop' and est_rows > 10000 and est_rows / greatest(lr::double * rr::double, 1.0) > 0.8"),
    ("Scan", "seq_scan", _SEV.format("s"), "kind = 'SeqScan' and s >= 1"),
    ("Scan", "index_scan", _SEV.format("greatest(r, c)"), "kind = 'IndexScan' and greatest(r, c) >= 2"),
    ("Scan", "bitmap_scan", _SEV.format("r"), "kind = 'BitmapHeapScan' and r >= 2"),
    ("Join", "nested_loop", _SEV.format("greatest(r, c)"), "kind = 'NestedLoop' and greatest(r, c) >= 2"),
    ("Join", "hash_memory", f"case when {MEMORY} > 20 then 'Critical' when {MEMORY} > 5 then 'High' when {MEMORY} > 2 then 'Medium' else 'Low' end", f"kind = 'HashJoin' and (r = 3 or (c >= 2 and est_rows > 1000000)) and {MEMORY} > 1.2"),
    ("Join", "merge_join", _SEV.format("c"), "kind = 'MergeJoin' and c >= 2"),
    ("QueryPattern", "function_in_filter", "'Medium'", "flt like 'lower(%'"),
    ("QueryPattern", "wide_row", "'Low'", "width > 500"),
    ("StartupCost", "high", "case when startup_cost > 100000 then 'Critical' when startup_cost > 50000 then 'High' else 'Medium' end", "startup_cost > 10000"),
    ("StartupCost", "dominant", "'Medium'", "startup_cost > 1000 and startup_cost / total_cost > 0.9"),
    ("StartupCost", "external_sort", "'High'", "external and startup_cost > 5000"),
    ("StartupCost", "materialize", "'Medium'", "kind = 'Materialize' and startup_cost > 5000"),
    ("IndexUsage", "missing_index", "case when est_rows > 100000 then 'High' when est_rows > 10000 then 'Medium' else 'Low' end", "kind = 'SeqScan' and flt like '%=%' and est_rows > 1000 and est_rows < 1000000"),
    ("IndexUsage", "function_in_filter", "'Medium'", "kind = 'SeqScan' and flt like 'lower(%'"),
    ("IndexUsage", "leading_wildcard", "'Medium'", "kind = 'SeqScan' and flt like '%LIKE ''\\%%' escape '\\'"),
    ("IndexUsage", "large_index_scan", "'Medium'", "kind = 'IndexScan' and est_rows > 50000"),
    ("IndexUsage", "large_bitmap", "'Medium'", "kind = 'BitmapHeapScan' and est_rows > 100000"),
    ("SortMemory", "disk_sort", "case when space > 100000 then 'High' else 'Medium' end", "external"),
    ("SortMemory", "hash_batches", "case when batches > 8 then 'High' else 'Medium' end", "batches > 1"),
    ("FilterEfficiency", "wasteful_filter", "case when removed >= 1000000 then 'Critical' when removed >= 100000 then 'High' else 'Medium' end", "removed >= 10000 and (actual_rows is null or actual_rows / (actual_rows + removed)::double < 0.10)"),
    ("IndexEfficiency", "heap_fetches", "case when fetches >= 100000 then 'High' else 'Medium' end", "fetches >= 1000 and (actual_rows is null or actual_rows = 0 or fetches / actual_rows::double > 0.10)"),
)
RULES = (
    N
    + f""", ch as (select p.*, coalesce(a.est_rows, 1) as lr, coalesce(b.est_rows, 1) as rr, coalesce(a.width, 0) as lw, coalesce(b.width, 0) as rw, {ROWS_CLASS.replace("est_rows", "p.est_rows")} as r,
    {COST_CLASS.replace("total_cost", "p.total_cost")} as c, {class_of("coalesce(p.actual_rows, p.est_rows)")} as s
    from n p left join n a on a.plan_id = p.plan_id and a.node_id = 2 * p.node_id left join n b on b.plan_id = p.plan_id and b.node_id = 2 * p.node_id + 1),
    f as ("""
    + " union all ".join(f"select plan_id, node_id, '{a}' as analyzer, '{r}' as rule, {s} as severity from ch where {c}" for a, r, s, c in NODE_RULES)
    + ")"
)
_SELF = "greatest(total_cost - coalesce((select sum(total_cost) from n k where k.plan_id = n.plan_id and k.parent_id = n.node_id), 0), 0)"
PLAN_RULES = f"""{N}, k as (select plan_id, parent_id as node_id, sum(total_cost) as kc from n where parent_id is not null group by all),
    e as (select n.*, greatest(n.total_cost - coalesce(kc, 0), 0.0) as self_cost,
        case when actual_rows is not null then greatest(greatest(est_rows, 1) / greatest(actual_rows, 1)::double, greatest(actual_rows, 1) / greatest(est_rows, 1)::double) end as er
        from n left join k on k.plan_id = n.plan_id and k.node_id = n.node_id),
    p as (select plan_id, count(*) as nodes, max(depth) as depth, count(*) filter (category = 'join') as joins, count(*) filter (category = 'aggregate') as aggs,
        max(total_cost) filter (depth = 0) as root_cost, max(self_cost) as top, arg_max(node_id, (self_cost, -node_id)) as top_id, count(er) as measured, count(*) filter (er >= 2) as sig,
        count(*) filter (er >= 2 and est_rows > actual_rows) as overs, max(er) as worst, sum(er) filter (er >= 2) / nullif(count(*) filter (er >= 2), 0) as avg_ratio from e group by plan_id),
    g as (select plan_id, cast(null as integer) as node_id, 'QueryPattern' as analyzer, 'complexity' as rule, case when 10 * joins + 5 * aggs + 3 * depth * depth > 200 then 'High' else 'Medium' end as severity
            from p where 10 * joins + 5 * aggs + 3 * depth * depth > 100
        union all select plan_id, null, 'QueryPattern', 'depth', 'Medium' from p where depth > 5
        union all select plan_id, null, 'PlanShape', 'complex', 'Medium' from p where depth + 1 >= 12 or nodes >= 40
        union all select plan_id, top_id, 'PlanShape', 'dominant_node', 'Medium' from p where nodes >= 2 and root_cost > 1000 and top / root_cost >= 0.7
        union all select plan_id, null, 'EstimationHealth', 'systematic', case when avg_ratio >= 10 then 'High' else 'Medium' end from p
            where measured >= 4 and sig >= 2 and greatest(overs, sig - overs) / sig::double >= 0.8 and avg_ratio >= 3
        union all select plan_id, null, 'EstimationHealth', 'outlier', 'Medium' from p where measured >= 2 and sig = 1 and worst >= 50)"""


def _findings(s, d):
    return rules.node_findings(plan_nodes(s, d), DEFAULT)


#: For each of KINDS: how a text plan names the node ({0}: its number), the name in JSON, the kind that is read back, the words of its description.
NAMES = (
    ('Seq Scan on s."t{0}"', "Seq Scan", "SeqScan", "Sequential Scan"), ("Index Scan using ix{0} on t{0}", "Index Scan", "IndexScan", "Index Scan"), ("Bitmap Heap Scan on t{0}", "Bitmap Heap Scan", "BitmapHeapScan", "Bitmap Heap Scan"),
    ("Nested Loop", "Nested Loop", "NestedLoop", "Nested Loop"), ("Hash Join", "Hash Join", "HashJoin", "Hash Join"), ("Merge Join", "Merge Join", "MergeJoin", "Merge Join"), ("Sort", "Sort", "Sort", "Sort"),
    ("Materialize", "Materialize", "Materialize", "Materialize"), ("HashAggregate", "Aggregate", "Aggregate", "Aggregate"),
)


#: Heap numbers of the largest tree that the tables hold, and some more.
MOST_NODES = 31


def _of_kind(k: int):
    return F.element_at(F.create_map(*[F.lit(x) for kind, names in zip(KINDS, NAMES, strict=True) for x in (kind, names[k])]), F.col("kind"))


def labelled_nodes(s, d):
    """plan_nodes with table and index names."""
    scan = F.col("category") == "scan"
    number = F.col("node_id").cast("string")
    table_name = F.when(F.col("kind") == "SeqScan", F.concat(F.lit("s.t"), number)).when(scan, F.concat(F.lit("t"), number))
    return plan_nodes(s, d).withColumns({"table_name": table_name, "index_name": F.when(F.col("kind") == "IndexScan", F.concat(F.lit("ix"), number))})


def _text():
    """The aggregate that makes a text plan of labelled nodes."""
    fill = F.replace(_of_kind(0), F.lit("{0}"), F.col("node_id").cast("string"))
    indent = F.when(F.col("depth") == 0, 0).otherwise(6 * F.col("depth") - 4)
    actual = F.when(F.col("actual_rows").isNotNull(), F.concat(F.lit(" (actual time=0.010..1.500 rows="), F.col("actual_rows").cast("string"), F.lit(" loops=1)"))).otherwise("")
    head = F.concat(F.repeat(F.lit(" "), indent), F.when(F.col("depth") > 0, "->  ").otherwise(""), fill, F.format_string("  (cost=%.2f..%.2f rows=%d width=%d)", "startup_cost", "total_cost", "est_rows", "width"), actual)
    inner = F.repeat(F.lit(" "), 6 * F.col("depth") + 2)
    lines = F.concat(F.array(head), F.transform(F.map_entries("props"), lambda p: F.concat(inner, p.key, F.lit(": "), p.value)))
    return F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("path", lines.alias("lines")))), lambda x: x.lines)), "\n")


def text_plans(s, d):
    """The trees as text plans: (plan_id, plan_text)."""
    return labelled_nodes(s, d).groupBy("plan_id").agg(_text().alias("plan_text"))


def _json_nodes():
    """The aggregate that makes a map of labelled nodes, as JSON objects left open, by their numbers."""
    own = F.to_json(F.struct(
        _of_kind(1).alias("Node Type"), F.element_at(F.split("table_name", r"\."), -1).alias("Relation Name"), F.when(F.col("kind") == "SeqScan", "s").alias("Schema"), F.col("index_name").alias("Index Name"), F.col("startup_cost").alias("Startup Cost"),
        F.col("total_cost").alias("Total Cost"), F.col("est_rows").alias("Plan Rows"), F.col("width").alias("Plan Width"), F.col("actual_rows").alias("Actual Rows"), F.col("actual_loops").alias("Actual Loops"),
        F.try_element_at("props", F.lit("Filter")).alias("Filter"),
    ))
    return F.map_from_entries(F.collect_list(F.struct("node_id", F.substr(own, F.lit(1), F.length(own) - 1).alias("j"))))


def _json_tree(k: int = 1):
    """The node of a number and all below it, nested as deep as MOST_NODES need, from the map `m`."""
    node = F.try_element_at("m", F.lit(k))
    if 2 * k > MOST_NODES:
        return F.concat(node, F.lit("}"))
    return F.concat(node, F.lit(',"Plans":['), F.concat_ws(",", _json_tree(2 * k), _json_tree(2 * k + 1)), F.lit("]}"))


def both_plans(s, d):
    """The trees as text and as JSON plans, from one pass over the nodes: (plan_id, format, plan_text)."""
    plans = labelled_nodes(s, d).groupBy("plan_id").agg(_text().alias("t"), _json_nodes().alias("m"))
    json = F.concat(F.lit('[{"Plan": '), _json_tree(), F.lit("}]"))
    forms = F.array(F.struct(F.lit("text").alias("format"), F.col("t").alias("plan_text")), F.struct(F.lit("json").alias("format"), json.alias("plan_text")))
    return plans.select("plan_id", F.inline(forms))


#: What the rows of q2_5_1_parse_plans are made from.
_FIELDS = ("node_id", "parent_id", "depth", "category", "kind", "table_name", "index_name", "startup_cost", "total_cost", "est_rows", "width", "actual_rows", "props")


def _parsed(s, d):
    return node_table(both_plans(s, d), "plan_text", "plan_id", "format", fields=_FIELDS)


#: The nodes in pre-order, with names; bits of the heap number below the first are the path.
M = f"""{N}, m as (select n.*, cast(row_number() over (partition by plan_id order by substr(bin(node_id), 2)) as integer) as pre,
      case when kind = 'SeqScan' then 's.t' || node_id when category = 'scan' then 't' || node_id end as table_name, case when kind = 'IndexScan' then 'ix' || node_id end as index_name,
      ({_list(x[2] for x in NAMES)})[list_position({_list(KINDS)}, kind)] as read_kind, ({_list(x[3] for x in NAMES)})[list_position({_list(KINDS)}, kind)] as words from n)"""
_DESCRIPTION = "concat_ws(' ', case kind when 'SeqScan' then 'Sequential Scan' when 'HashAggregate' then 'Hash Aggregate' else words end, 'using ' || index_name, 'on ' || table_name)"
_LINE = f"""repeat('  ', depth) || case when depth > 0 then '-> ' else '' end || {_DESCRIPTION} || '  (cost=' || printf('%.2f', startup_cost) || '..' || printf('%.2f', total_cost) || ' rows=' || est_rows || ' width=' || width || ')'
    || coalesce(' (actual rows=' || actual_rows || ' loops=1)', '')"""


QUERIES = {
    "q2_5_1_parse_plans": Registered(
        lambda s, d: _parsed(s, d).select("plan_id", "format", "node_id", "parent_id", "depth", "category", "kind", "table_name", "index_name", "startup_cost", "total_cost", "est_rows", "width", "actual_rows", F.try_element_at("props", F.lit("Filter")).alias("flt")),
        f"""with {M} select m.plan_id, format, m.pre as node_id, u.pre as parent_id, m.depth, m.category, m.read_kind as kind, m.table_name, m.index_name, m.startup_cost::double as startup_cost, m.total_cost::double as total_cost, m.est_rows, m.width,
            m.actual_rows, m.flt from m left join m u on u.plan_id = m.plan_id and u.node_id = m.parent_id, (values ('text'), ('json')) f(format)""",
    ),
    "q2_5_6_properties": Registered(
        lambda s, d: node_table(text_plans(s, d), "plan_text", "plan_id", fields=("node_id", "props")).select("plan_id", "node_id", F.explode("props").alias("name", "value")),
        f"""with {M} select plan_id, pre as node_id, unnest(p, recursive := true) from (select *, list_filter([{{'name': 'Filter', 'value': flt}}, {{'name': 'Rows Removed by Filter', 'value': removed::varchar}}, {{'name': 'Heap Fetches', 'value': fetches::varchar}},
            {{'name': 'Sort Method', 'value': case when external then 'external merge' end}}, {{'name': 'Sort Space Used', 'value': space || 'kB'}}, {{'name': 'Batches', 'value': batches::varchar}}], lambda x: x.value is not null) as p from m)""",
    ),
    "q2_5_27_property_lists": Registered(
        lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("k")).select("id", F.concat(F.lit("a"), "k", F.lit(" DESC, b , c ASC")).alias("keys"), F.concat(F.when(F.col("id") % 2 == 0, "count(x), f").otherwise("g(a), h(f"), "k", F.lit("(y))")).alias("output"))
        .select("id", pr.sort_keys(F.col("keys")).alias("k"), pr.group_keys(F.col("keys")).alias("g"), pr.aggregate_functions(F.col("output")).alias("f"))
        .select("id", F.array_join(F.transform("k", lambda x: F.concat(x.expression, F.lit("/"), F.coalesce(x.direction, F.lit("-")))), "|").alias("sort_keys"), F.array_join("g", "|").alias("group_keys"), F.array_join("f", "|").alias("functions")),
        "select o_orderkey as id, 'a' || o_orderkey || '/DESC|b/-|c/ASC' as sort_keys, 'a' || o_orderkey || ' DESC|b|c ASC' as group_keys, case when o_orderkey % 2 = 0 then 'count' else 'g|h|f' || o_orderkey end as functions from orders",
    ),
    "q2_6_6_descriptions": Registered(
        lambda s, d: labelled_nodes(s, d).select("plan_id", "node_id", pr.description().alias("label"), pr.table_or_fallback().alias("tbl"), pr.index_or_fallback().alias("idx"), pr.average_cost().alias("avg_cost"), F.round(pr.cost_span(), 6).alias("span")),
        f"""with {M} select plan_id, node_id, {_DESCRIPTION} as label, coalesce(table_name, 'unknown_table') as tbl, case when kind = 'SeqScan' then 'no_index' else coalesce(index_name, 'unknown_index') end as idx,
            ((startup_cost + total_cost) / 2)::double as avg_cost, round((total_cost - startup_cost)::double, 6) as span from m""",
    ),
    "q2_6_32_render_plan": Registered(lambda s, d: pr.render_plans(labelled_nodes(s, d), "plan_id"), f"with {M} select plan_id, string_agg({_LINE}, chr(10) order by pre) as plan from m group by plan_id"),
    "q2_6_33_render_compact": Registered(
        lambda s, d: pr.render_compact(labelled_nodes(s, d), "plan_id"), f"with {M} select plan_id, string_agg(repeat('  ', depth) || {_DESCRIPTION}, chr(10) order by pre) as plan from m group by plan_id"
    ),
    "q2_6_8_tables": Registered(
        lambda s, d: n.tables(labelled_nodes(s, d)).select("plan_id", F.array_join("tables", ",").alias("tables")), f"with {M} select plan_id, coalesce(string_agg(distinct table_name, ',' order by table_name), '') as tables from m group by plan_id"
    ),
    "q2_6_4_scan_nodes": Registered(lambda s, d: n.of_category(plan_nodes(s, d), "scan", "join").select("plan_id", "node_id", "category", "kind"), f"with {N} select plan_id, node_id, category, kind from n where category in ('scan', 'join')"),
    "q2_6_10_uses_parallel": Registered(
        lambda s, d: n.uses_workers(plan_nodes(s, d).withColumn("props", F.when(F.col("est_rows") % 5 == 0, F.create_map(F.lit("Workers Planned"), (F.col("width") % 3).cast("string"))).otherwise(F.col("props")))),
        f"with {N} select plan_id, bool_or(est_rows % 5 = 0 and width % 3 > 0) as uses_workers, max(case when est_rows % 5 = 0 then width % 3 else 0 end)::integer as workers from n group by plan_id",
    ),
    "q2_6_34_shortened": Registered(
        lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.length(pr.shortened(F.repeat(F.lit("x"), (F.col("l_partkey") % 240).cast("int")))).alias("n")),
        "select l_orderkey as id, cast(least(l_partkey % 240, 120) as integer) as n from lineitem",
    ),
    "q2_6_1_plan_summary": Registered(
        lambda s, d: n.summary(plan_nodes(s, d)),
        f"""with {N} select plan_id, count(*) as node_count, max(depth) + 1 as max_depth, sum(total_cost) as total_cost, sum(startup_cost) as startup_cost, count(*) filter (category = 'scan') as scans,
            count(*) filter (category = 'join') as joins, bool_or(kind = 'IndexScan') as uses_indexes, false as uses_parallel from n group by plan_id""",
    ),
    "q2_6_9_node_kinds": Registered(lambda s, d: n.kind_counts(plan_nodes(s, d)), f"with {N} select kind, count(*) as nodes from n group by kind"),
    "q2_6_17_breadth_first": Registered(lambda s, d: n.breadth_first(plan_nodes(s, d)).select("plan_id", "node_id", "bfs"), f"with {N} select plan_id, node_id, node_id as bfs from n"),
    "q2_6_16_post_order": Registered(
        lambda s, d: n.post_order(plan_nodes(s, d)).select("plan_id", "node_id", "post"),
        f"""with {N}, b as (select *, lpad(rpad(substr(bin(node_id), 2), 8, '2'), 8, '2') as k from n) select plan_id, node_id, cast(row_number() over (partition by plan_id order by k) as integer) as post from b""",
    ),
    "q2_6_20_leaves": Registered(lambda s, d: n.leaves(plan_nodes(s, d)).select("plan_id", "node_id"), f"with {N} select plan_id, node_id from n where (plan_id, node_id) not in (select (plan_id, parent_id) from n where parent_id is not null)"),
    "q2_6_21_at_depth": Registered(lambda s, d: n.at_depth(plan_nodes(s, d), 2).select("plan_id", "node_id"), f"with {N} select plan_id, node_id from n where depth = 2"),
    "q2_6_22_edges": Registered(lambda s, d: n.edges(plan_nodes(s, d)), f"with {N} select plan_id, parent_id as parent, node_id as child from n where parent_id is not null"),
    "q2_6_24_siblings": Registered(lambda s, d: n.siblings(plan_nodes(s, d)), f"with {N} select a.plan_id, a.node_id as node, b.node_id as sibling from n a join n b on a.plan_id = b.plan_id and a.parent_id = b.parent_id and a.node_id <> b.node_id"),
    "q2_6_25_ancestors": Registered(
        lambda s, d: n.ancestors(plan_nodes(s, d)),
        f"with {N} select plan_id, node_id as node, cast(node_id >> k as integer) as ancestor, cast(k as integer) as distance from n, range(1, 20) r(k) where k <= depth",
    ),
    "q2_6_26_descendants": Registered(
        lambda s, d: n.descendants(plan_nodes(s, d)),
        f"with {N} select plan_id, cast(node_id >> k as integer) as node, node_id as descendant, cast(k as integer) as distance from n, range(1, 20) r(k) where k <= depth",
    ),
    "q2_6_28_node_at_path": Registered(lambda s, d: n.at_path(plan_nodes(s, d), [1, 0]).select("plan_id", "node_id"), f"with {N} select plan_id, node_id from n where node_id = 6"),
    "q2_6_30_node_metrics": Registered(
        lambda s, d: n.metrics(plan_nodes(s, d)),
        f"""with {N} select plan_id, node_id, metric, value from (select plan_id, node_id, unnest([{{'metric': 'total_cost', 'value': total_cost}}, {{'metric': 'startup_cost', 'value': startup_cost}},
            {{'metric': 'estimated_rows', 'value': est_rows::double}}, {{'metric': 'estimated_width', 'value': width::double}}, {{'metric': 'actual_rows', 'value': actual_rows::double}}], recursive := true) from n) where value is not null""",
    ),
    "q2_14_10_self_cost": Registered(
        lambda s, d: n.self_cost(plan_nodes(s, d)).select("plan_id", "node_id", "self_cost"),
        f"""with {N}, k as (select plan_id, parent_id as node_id, sum(total_cost) as kc from n where parent_id is not null group by all)
            select plan_id, node_id, greatest(total_cost - coalesce(kc, 0), 0.0) as self_cost from n left join k using (plan_id, node_id)""",
    ),
    "q2_11_node_findings": Registered(_findings, f"with {RULES} select * from f"),
    "q2_11_plan_findings": Registered(lambda s, d: rules.plan_findings(plan_nodes(s, d)), f"with {PLAN_RULES} select * from g"),
    "q2_8_21_findings_summary": Registered(
        lambda s, d: rules.findings_summary(_findings(s, d)),
        f"""with {RULES}, c as (select plan_id, count(*) as findings, count(*) filter (severity = 'Low') as low, count(*) filter (severity = 'Medium') as medium, count(*) filter (severity = 'High') as high,
            count(*) filter (severity = 'Critical') as critical from f group by plan_id)
            select *, case when critical > 0 then 'Critical' when high > 0 then 'High' when medium > 0 then 'Medium' else 'Low' end as max_severity,
            case when critical >= 3 then 'Critical' when critical >= 1 or high >= 5 then 'Poor' when high >= 2 or medium >= 5 then 'Fair' when high >= 1 or medium >= 2 then 'Good' else 'Excellent' end as assessment from c""",
    ),
    "q2_13_3_top_findings": Registered(
        lambda s, d: rules.top_findings(_findings(s, d)),
        f"""with {RULES} select *, cast(row_number() over w as integer) as place from f window w as (partition by plan_id order by list_position(['Critical','High','Medium','Low'], severity), node_id, analyzer, rule)
            qualify row_number() over w <= 5""",
    ),
    "q2_18_5_one_analyzer": Registered(lambda s, d: rules.node_findings(plan_nodes(s, d).drop("left_est_rows", "left_width", "right_est_rows", "right_width"), DEFAULT, analyzers=("Join",)), f"with {RULES} select * from f where analyzer = 'Join'"),
    "q2_11_24_buffers": Registered(
        lambda s, d: rules.buffer_findings(
            plan_nodes(s, d).withColumn("props", F.create_map(F.lit("Buffers"), F.concat(F.lit("shared hit=5 read="), (F.col("est_rows") / 100).cast("bigint").cast("string"), F.lit(", temp read="), F.col("width").cast("string"), F.lit(" written=3")), F.lit("WAL"), F.concat(F.lit("records=1 bytes="), (F.col("est_rows") * 4).cast("string"))))
        ),
        f"""with {N}, x as (select *, cast(floor(est_rows / 100) as bigint) as sr, width as tr, 3 as tw, est_rows * 4 as wb from n),
            k as (select plan_id, parent_id as node_id, sum(sr) as csr, sum(tr) as ctr, sum(tw) as ctw, sum(wb) as cwb from x where parent_id is not null group by all),
            o as (select x.plan_id, x.node_id, greatest(tr - coalesce(ctr, 0), 0) + greatest(tw - coalesce(ctw, 0), 0) as t, greatest(sr - coalesce(csr, 0), 0) as r, greatest(wb - coalesce(cwb, 0), 0) as w
                from x left join k on k.plan_id = x.plan_id and k.node_id = x.node_id)
            select plan_id, node_id, 'BufferWal' as analyzer, 'temp_spill' as rule, case when t * 8192 / 1e6 >= 100 then 'Critical' when t * 8192 / 1e6 >= 10 then 'High' when t * 8192 / 1e6 >= 1 then 'Medium' else 'Low' end as severity from o where t >= 1
            union all select plan_id, node_id, 'BufferWal', 'disk_reads', case when r * 8192 / 1e6 >= 512 then 'High' when r * 8192 / 1e6 >= 64 then 'Medium' else 'Low' end from o where r >= 1024
            union all select plan_id, node_id, 'BufferWal', 'wal', case when w >= 64e6 then 'High' when w >= 8e6 then 'Medium' else 'Low' end from o where w >= 1048576""",
    ),
    "q2_11_39_missed_parallel": Registered(
        lambda s, d: rules.missed_parallelism(plan_nodes(s, d), DEFAULT),
        f"""with {N}, c as (select *, greatest({ROWS_CLASS}, {COST_CLASS}) as g from n) select plan_id, node_id, 'Parallelization' as analyzer, 'missed' as rule, {_SEV.format("g")} as severity
            from c where g >= 2 and (category in ('scan', 'aggregate') or kind in ('HashJoin', 'MergeJoin'))""",
    ),
    "q2_6_31_scan_types": Registered(
        lambda s, d: n.kind_counts(plan_nodes(s, d).filter("category in ('scan', 'join')").withColumn("database", F.concat(F.lit("db"), (F.col("plan_id") % 3).cast("string"))), "database", "category"),
        f"with {N} select 'db' || plan_id % 3 as database, category, kind, count(*) as nodes from n where category in ('scan', 'join') group by all",
    ),
    "q2_18_4_engine": Registered(
        lambda s, d: engine.Engine.default().run(plan_nodes(s, d), lambda name: name in ("Scan", "Join")).findings.groupBy("analyzer", "rule", "severity").agg(F.count("*").alias("findings")),
        f"with {RULES} select analyzer, rule, severity, count(*) as findings from f where analyzer in ('Scan', 'Join') group by all",
    ),
}
