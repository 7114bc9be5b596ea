"""Queries over plan trees as wholes: structural patterns, the dictionary of equal trees, and findings attached to groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engine, group_findings, rules
from ..operators.config import DEFAULT, Thresholds
from ..plans import dictionary, patterns
from ..plans import nodes as n
from ..plans import properties as pr
from .data import E, Registered
from .lines import PREFIX, stamped
from .plans import COST_CLASS, MEMORY, NODE_RULES, PLAN_RULES, ROWS_CLASS, RULES, N, class_of, plan_nodes


def _is(kind: str, child: bool = False) -> patterns.Step:
    return patterns.Step(F.col("kind") == kind, child)


def _category(name: str, child: bool = False) -> patterns.Step:
    return patterns.Step(F.col("category") == name, child)


def _matches(s, d, *steps):
    found = patterns.find(plan_nodes(s, d), *steps)
    return found.select("plan_id", *[F.col("matched")[k].alias(f"step{k}") for k in range(len(steps))])


#: Whether heap number x is above y.
_ABOVE = "{y}.plan_id = {x}.plan_id and {y}.depth > {x}.depth and ({y}.node_id >> ({y}.depth - {x}.depth)) = {x}.node_id"


def findings_log(s, d):
    """The events as entries of plans whose one node's rows and cost grow with the event's number and duration."""
    e = stamped(s, d)
    head = F.concat(F.col("stamp"), F.lit(" [7] u@"), F.col("database"), F.lit(" LOG:  duration: "), F.col("duration_ms").cast("string"), F.lit(" ms  plan:"))
    node = F.format_string("\tSeq Scan on t  (cost=0.00..%.2f rows=%d width=8)", F.col("duration_ms") * 1000, F.col("seq") * 2000)
    body = F.array(head, F.concat(F.lit("\tQuery Text: select * from "), F.col("fingerprint"), F.lit(" where id = "), F.col("seq").cast("string")), node)
    rows = e.select((F.col("seq") % 5).cast("string").alias("file"), "seq", F.posexplode(body).alias("k", "value"))
    return rows.select("file", F.floor(F.col("seq") / 100).cast("long").alias("block"), (F.col("seq") * 10 + F.col("k")).alias("place"), "value")


def _group_findings(s, d):
    found = group_findings.log_group_findings(findings_log(s, d), PREFIX)
    return found.select("normalized_query", "database", "calls", "max_ms", F.explode_outer("findings").alias("f")).select("normalized_query", "database", "calls", "max_ms", "f.analyzer", "f.rule", "f.severity")


_SEEN = f"""ch as (select fingerprint, database, count(*) as calls, max(duration_ms) as max_ms, 'SeqScan' as kind, arg_max(seq, (duration_ms, cast(seq % 5 as varchar), seq)) * 2000 as est_rows,
        max(duration_ms) * 1000 as total_cost, 0.0 as startup_cost, 8 as width, cast(null as varchar) as flt, 1 as lr, 1 as rr, 0 as lw, 0 as rw, false as external, null as space, null as batches, null as removed, null as fetches, null as actual_rows
        from e group by fingerprint, database),
    cl as (select *, {ROWS_CLASS} as r, {COST_CLASS} as c, {class_of("est_rows")} as s from ch),
    f as ({" union all ".join(f"select fingerprint, database, '{a}' as analyzer, '{r}' as rule, {s} as severity from cl where {c}" for a, r, s, c in NODE_RULES)})"""

#: The numbers behind each rule's findings, in SQL over a node with its rules' classes (ch) and its children (l.., r..).
EVIDENCE = {
    "excessive_rows": {"estimated_rows": "est_rows", "cost": "total_cost"},
    "cartesian": {"result_rows": "est_rows", "left_input_rows": "lr", "right_input_rows": "rr", "cartesian_ratio": "est_rows / greatest(lr::double * rr::double, 1.0)"},
    "seq_scan": {"row_count": "coalesce(actual_rows, est_rows)", "estimated_rows": "est_rows", "cost": "total_cost", "severity_threshold": f"({[*DEFAULT.rows]})[s]"},
    "index_scan": {"row_count": "est_rows", "cost": "total_cost", "cost_threshold": f"({[*DEFAULT.cost]})[greatest(r, c)]"},
    "bitmap_scan": {"row_count": "est_rows", "cost": "total_cost", "severity_threshold": f"({[*DEFAULT.rows]})[r]"},
    "nested_loop": {"result_rows": "est_rows", "cost": "total_cost", "left_input_rows": "coalesce(ll, 0)", "right_input_rows": "coalesce(rl, 0)"},
    "hash_memory": {
        "result_rows": "est_rows", "cost": "total_cost", "left_input_rows": "coalesce(ll, 0)", "right_input_rows": "coalesce(rl, 0)", "left_width_bytes": "coalesce(lwidth, 100)", "right_width_bytes": "coalesce(rwidth, 100)",
        "estimated_memory_kb": f"{MEMORY} * 4096", "work_mem_kb": "4096", "memory_pressure_ratio": MEMORY,
    },
    "merge_join": {"cost": "total_cost", "estimated_rows": "est_rows"},
    "wide_row": {"row_width_bytes": "width"},
    "high": {"startup_cost": "startup_cost", "total_cost": "total_cost", "startup_ratio": "startup_cost / total_cost"},
    "dominant": {"startup_cost": "startup_cost", "total_cost": "total_cost", "startup_percentage": "startup_cost / total_cost * 100"},
    "external_sort": {"startup_cost": "startup_cost"},
    "materialize": {"startup_cost": "startup_cost"},
    "missing_index": {"estimated_rows": "est_rows"},
    "large_index_scan": {"estimated_rows": "est_rows"},
    "large_bitmap": {"estimated_rows": "est_rows"},
    "disk_sort": {"sort_space_used_kb": "space", "work_mem_kb": "4096"},
    "hash_batches": {"batches": "batches", "work_mem_kb": "4096"},
    "wasteful_filter": {"rows_removed": "removed", "rows_kept": "actual_rows", "selectivity": "actual_rows / (actual_rows + removed)::double"},
    "heap_fetches": {"heap_fetches": "fetches", "actual_rows": "actual_rows", "heap_fetch_ratio": "fetches / nullif(actual_rows, 0)::double"},
}


def _evidence_sql() -> str:
    parts = []
    for analyzer, rule, _, condition in NODE_RULES:
        for name, value in EVIDENCE.get(rule, {}).items():
            parts.append(f"select plan_id, node_id, '{analyzer}' as analyzer, '{rule}' as rule, '{name}' as name, round(({value})::double, 4) as value from x where {condition} and ({value}) is not null")
    return f"""with {RULES}, x as (select ch.*, l.est_rows as ll, l.width as lwidth, q.est_rows as rl, q.width as rwidth from ch
        left join n l on l.plan_id = ch.plan_id and l.node_id = 2 * ch.node_id left join n q on q.plan_id = ch.plan_id and q.node_id = 2 * ch.node_id + 1)
        {" union all ".join(parts)}"""


def _evidence(s, d):
    found = rules.node_findings(plan_nodes(s, d), DEFAULT, evidence=True)
    return found.select("plan_id", "node_id", "analyzer", "rule", F.explode("evidence").alias("name", "value")).withColumn("value", F.round("value", 4))


def _typed(s, d):
    """Properties with one set in every other node under the name that JSON plans use."""
    x = plan_nodes(s, d)
    x = x.withColumn("props", pr.set_property(F.col("props"), "Hash Batches", F.when(F.col("node_id") % 2 == 0, F.when(F.col("node_id") % 3 == 0, "many").otherwise("3"))))
    return pr.typed_properties(x, "plan_id", "node_id").select("plan_id", "node_id", "key", "kind", "number", "text")


_RARE = {
    "Operation": ("'Unique'", "node_id % 2 = 0"), "Index Cond": ("'a = 1'", "true"), "Rows Removed by Index Recheck": ("removed * 3", "true"), "Rows Removed by Join Filter": ("removed * 5", "node_id % 3 = 0"),
    "Exact Heap Blocks": ("width", "true"), "Lossy Heap Blocks": ("width / 2", "node_id % 2 = 1"), "Workers Planned": ("4", "true"), "Workers Launched": ("node_id % 4", "true"),
}


def _rare(s, d):
    """Nodes with properties that rules look for which the other queries' nodes don't have."""
    x = plan_nodes(s, d).withColumn("removed", F.try_element_at("props", F.lit("Rows Removed by Filter")).cast("bigint"))
    props = F.map_filter(F.create_map(*[c for name, (value, where) in _RARE.items() for c in (F.lit(name), F.expr(f"case when {where} then cast(cast({value} as {'string' if value.startswith(chr(39)) else 'bigint'}) as string) end"))]), lambda _, v: v.isNotNull())
    found = rules.node_findings(x.withColumn("props", props), DEFAULT)
    return found.filter(F.col("rule").isin("distinct", "recheck", "join_filter", "lossy_bitmap", "inefficient"))


def _all(s, d):
    found = rules.all_findings(plan_nodes(s, d), DEFAULT)
    return found.groupBy("analyzer", "rule", "severity").agg(F.count("*").alias("findings"), F.countDistinct("plan_id").alias("plans"))


_STRICT = Thresholds(rows=(1_000, 10_000, 100_000), cost=DEFAULT.cost)


def _engine(s, d):
    """The default analyzers, one of them with its own thresholds, and a user's."""
    e = engine.Engine.default()
    e.configure("Scan", _STRICT)
    own = lambda x: x.filter("width >= 500").select("plan_id", "node_id", F.lit("Mine").alias("analyzer"), F.lit("wide").alias("rule"), F.lit("Low").alias("severity"))
    e.add("Mine", own)
    return e.run(plan_nodes(s, d), only=lambda name: name in ("Scan", "Join", "Mine")).findings


_STRICT_SEQ = class_of("coalesce(actual_rows, est_rows)", _STRICT.rows)
_STRICT_ROWS = class_of("est_rows", _STRICT.rows)
_LEVEL = "(['Low','Medium','High','Critical'])[{0} + 1]"

QUERIES = {
    "q2_11_rare_findings": Registered(
        _rare,
        f"""with {N} select plan_id, node_id, 'QueryPattern' as analyzer, 'distinct' as rule, 'Low' as severity from n where node_id % 2 = 0
            union all select plan_id, node_id, 'FilterEfficiency', 'recheck', case when removed * 3 >= 1000000 then 'Critical' when removed * 3 >= 100000 then 'High' else 'Medium' end from n where removed * 3 >= 10000
            union all select plan_id, node_id, 'FilterEfficiency', 'join_filter', case when removed * 5 >= 1000000 then 'Critical' when removed * 5 >= 100000 then 'High' else 'Medium' end from n where node_id % 3 = 0 and removed * 5 >= 10000
            union all select plan_id, node_id, 'IndexEfficiency', 'lossy_bitmap', 'Medium' from n where node_id % 2 = 1 and width // 2 >= 64
            union all select plan_id, node_id, 'Parallelization', 'inefficient', 'Medium' from n where node_id % 4 = 1""",
    ),
    "q2_8_26_all_findings": Registered(
        _all,
        f"""with {RULES}, {PLAN_RULES.removeprefix(N).lstrip(", ")}, z as (select plan_id, analyzer, rule, severity from f union all select plan_id, analyzer, rule, severity from g)
            select analyzer, rule, severity, count(*) as findings, count(distinct plan_id) as plans from z group by all""",
    ),
    "q2_18_2_configured_engine": Registered(
        _engine,
        f"""with {RULES}, t as (select *, {_STRICT_SEQ} as q, {_STRICT_ROWS} as w from ch)
            select * from f where analyzer = 'Join' union all select plan_id, node_id, 'Mine', 'wide', 'Low' from ch where width >= 500
            union all select plan_id, node_id, 'Scan', 'seq_scan', {_LEVEL.format("q")} from t where kind = 'SeqScan' and q >= 1
            union all select plan_id, node_id, 'Scan', 'index_scan', {_LEVEL.format("greatest(w, c)")} from t where kind = 'IndexScan' and greatest(w, c) >= 2
            union all select plan_id, node_id, 'Scan', 'bitmap_scan', {_LEVEL.format("w")} from t where kind = 'BitmapHeapScan' and w >= 2""",
    ),
    "q2_6_27_is_ancestor": Registered(
        lambda s, d: (lambda x: x.select("plan_id", F.col("node_id").alias("above"), F.col("path").alias("p")).join(x.select("plan_id", F.col("node_id").alias("below"), F.col("path").alias("q")), "plan_id").filter(n.is_ancestor(F.col("p"), F.col("q"))).select("plan_id", "above", "below"))(plan_nodes(s, d)),
        f"with {N} select a.plan_id, a.node_id as above, b.node_id as below from n a join n b on {_ABOVE.format(x='a', y='b')}",
    ),
    "q2_6_19_find_nodes": Registered(
        lambda s, d: _matches(s, d, patterns.Step((F.col("category") == "scan") & (F.col("total_cost") > 100_000))),
        f"with {N} select plan_id, node_id as step0 from n where category = 'scan' and total_cost > 100000",
    ),
    "q2_5_34_typed_properties": Registered(
        _typed,
        f"""with {N}, p as (select plan_id, node_id, unnest([{{'key': 'Filter', 'text': flt}}, {{'key': 'Rows Removed by Filter', 'text': removed::varchar}}, {{'key': 'Heap Fetches', 'text': fetches::varchar}},
                {{'key': 'Sort Method', 'text': case when external then 'external merge' end}}, {{'key': 'Sort Space Used', 'text': space || 'kB'}},
                {{'key': 'Batches', 'text': case when node_id % 6 = 0 then 'many' when node_id % 2 = 0 then '3' else batches::varchar end}}], recursive := true) from n),
            k as (select *, case when key in ('Rows Removed by Filter', 'Heap Fetches', 'Batches') then try_cast(text as bigint) end as number from p where text is not null)
            select plan_id, node_id, key, case when number is not null then 'whole' when key = 'Batches' then 'custom' else 'text' end as kind, number, text from k""",
    ),
    "q2_13_8_insights": Registered(
        lambda s, d: rules.insights(rules.node_findings(plan_nodes(s, d), DEFAULT)).select("plan_id", F.array_join("insights", "|").alias("insights")),
        f"""with {RULES}, o as (select *, analyzer || ' ' || rule as says, row_number() over (partition by plan_id order by list_position(['Critical', 'High', 'Medium', 'Low'], severity), node_id, analyzer, rule) as k from f)
            select plan_id, string_agg(says, '|' order by k) as insights from o where k <= 3 group by plan_id""",
    ),
    "q2_11_finding_evidence": Registered(_evidence, _evidence_sql()),
    "q2_18_8_plan_pattern": Registered(
        lambda s, d: _matches(s, d, _is("NestedLoop"), _category("join"), _is("SeqScan")),
        f"""with {N} select a.plan_id, a.node_id as step0, b.node_id as step1, c.node_id as step2 from n a join n b on {_ABOVE.format(x="a", y="b")} join n c on {_ABOVE.format(x="b", y="c")}
            where a.kind = 'NestedLoop' and b.category = 'join' and c.kind = 'SeqScan'""",
    ),
    "q2_18_9_child_pattern": Registered(
        lambda s, d: _matches(s, d, _category("join"), _category("scan", True), patterns.Step(F.col("est_rows") > 1000)),
        f"""with {N} select a.plan_id, a.node_id as step0, b.node_id as step1, c.node_id as step2 from n a join n b on {_ABOVE.format(x="a", y="b")} and b.parent_id = a.node_id join n c on {_ABOVE.format(x="b", y="c")}
            where a.category = 'join' and b.category = 'scan' and c.est_rows > 1000""",
    ),
    "q2_6_18_descendant_counts": Registered(
        lambda s, d: patterns.descendant_counts(plan_nodes(s, d)),
        f"with {N} select a.plan_id, a.node_id, cast(count(b.node_id) as integer) as descendants from n a left join n b on {_ABOVE.format(x='a', y='b')} group by a.plan_id, a.node_id",
    ),
    "q2_7_23_plan_dictionary": Registered(
        lambda s, d: dictionary.members(plan_nodes(s, d), "kind").groupBy("tree").agg(F.min("first").alias("first"), F.count("*").alias("plans")).select("first", "plans"),
        f"with {N}, t as (select plan_id, string_agg(kind, ',' order by node_id) as tree from n group by plan_id) select min(plan_id) as first, count(*) as plans from t group by tree",
    ),
    "q2_7_24_subtrees": Registered(
        lambda s, d: dictionary.subtrees(plan_nodes(s, d), "kind").groupBy("digest", "size").agg(F.count("*").alias("places"), F.min("plan_id").alias("first")).select("size", "places", "first"),
        f"""with {N}, u as (select a.plan_id, a.node_id, b.kind, (1 << (b.depth - a.depth)) + b.node_id - (a.node_id << (b.depth - a.depth)) as k from n a join n b on ({_ABOVE.format(x="a", y="b")}) or (a.plan_id = b.plan_id and a.node_id = b.node_id)),
            t as (select plan_id, cast(count(*) as integer) as size, string_agg(k || kind, ',' order by k) as tree from u group by plan_id, node_id)
            select size, count(*) as places, min(plan_id) as first from t group by tree, size""",
    ),
    "q2_8_13_findings_once_each": Registered(lambda s, d: dictionary.once_each(plan_nodes(s, d), lambda x: rules.node_findings(x, DEFAULT)), f"with {RULES} select * from f"),
    "q2_8_13_group_findings": Registered(
        _group_findings,
        f"""with {E}, {_SEEN} select 'SELECT * FROM ' || fingerprint || ' WHERE id = $1' as normalized_query, database, calls, max_ms, analyzer, rule, severity from ch left join f using (fingerprint, database)""",
    ),
}
