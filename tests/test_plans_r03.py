"""Findings F3 and F7 of round 3: plans are parsed once, a batch at once where they are plain."""

import pyarrow as pa

from tracewell.plans import parse
from tracewell.plans.plain import plain_texts
from tracewell.registry import plans as registry

from .test_queries import SF

NAMES = tuple(f.name for f in parse._NODE_TYPE)
ODD = [
    "Limit  (cost=0.1..1.0 rows=1 width=4)\n  ->  Hash Join  (cost=0.1..1.0 rows=1 width=4)\n        Hash Cond: (a = b)\n        ->  Seq Scan on a  (cost=0..1 rows=1 width=4)\n  Output: x: y \n  Output: z\nPlanning Time: 1 ms",
    "Sort  (cost=0.1..1.0 rows=1 width=4) (actual time=0.1..0.5 rows=2.6 loops=3)\n  Sort Method: quicksort  Memory: 25kB\n  :empty\n  no colon",
    "Seq Scan on s. (cost=0.1..1.0 rows=1 width=4)\n\tFilter: a", "->  (cost=0..2 rows=3  width=4)", "Index Only Scan using (cost=1..2 rows=1 width=1)", 'Seq Scan on "a b"."c d" (cost=1..2 rows=1 width=1)\r\n  Filter: b',
    "", None, "Filter: a", '{"Plan": {"Node Type": "Seq Scan", "Relation Name": "t", "Plans": [{"Node Type": "Bitmap Index Scan", "Index Name": "i", "Inner Unique": true}]}}', "{",
    "Seq Scan on é (cost=1..2 rows=1 width=1)\n  Filter: ж:", "A  (cost=1..2 rows=99999999999999 width=1)\n  B  (cost=1..2 rows=1 width=2)\n  C  (cost=1..2 rows=1 width=2)\n   D (cost=x)\n  E  (cost=1..2 rows=1 width=2) (never executed)",
    "\n".join(" " * 2 * i + "->  Sort  (cost=0.1..1.0 rows=1 width=4)" for i in range(257)),
]


def one(plan):
    try:
        return None if plan is None else parse.parse_plan(plan)
    except ValueError:
        return None


def rows(plans):
    return [None if r is None else [{n: list(x["props"].items()) if n == "props" else x.get(n) for n in NAMES} for x in r] for r in map(one, plans)]


def test_a_batch_is_as_one_by_one(spark):
    plans = [r.plan_text for r in registry.both_plans(spark, SF).collect()]
    assert parse.parsed_plans(pa.array(plans + ODD), parse.FORMATS, NAMES).to_pylist() == rows(plans + ODD)
    texts = [p for p in plans if p[0] != "["]
    assert plain_texts(pa.array(texts), NAMES)[0].all()  # none is parsed line by line


def test_plans_are_parsed_once(spark):
    for plans in (registry.text_plans(spark, SF), registry.both_plans(spark, SF)):
        found = parse.node_table(plans, "plan_text", "plan_id")
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_unparsable_plans_give_no_nodes(spark):
    plans = spark.createDataFrame([(k, p) for k, p in enumerate(ODD)], "id long, plan_text string")
    assert parse.node_table(plans, "plan_text", "id").count() == sum(len(r or ()) for r in rows(ODD))
    only = parse.node_table(plans, "plan_text", "id", fields=("node_id", "kind"))
    assert only.columns == ["id", "node_id", "kind"]
