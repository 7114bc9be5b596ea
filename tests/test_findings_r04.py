"""Finding F1 of round 4: findings of equal plans, with each plan's digest worked out once and in compiled code."""

from pyspark.sql import functions as F

from tracewell.operators import rules
from tracewell.operators.config import DEFAULT
from tracewell.plans import dictionary
from tracewell.registry import plans as registry
from tracewell.registry import registered

from .test_queries import SF

SCHEMA = "plan_id long, node_id int, parent_id int, path array<int>, depth int, kind string, est_rows long, width int, props map<string,string>"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


def test_digests_are_worked_out_once(spark):
    found = registered()["q2_8_13_findings_once_each"].run(spark, SF)
    assert executed(found).count("row_number()") == 1  # the analysed nodes; the digests are read
    assert "lambda" not in executed(dictionary.trees(registry.plan_nodes(spark, SF)))


def test_only_findings_are_exploded(spark):
    nodes = registry.plan_nodes(spark, SF)
    found = rules.node_findings(nodes, DEFAULT)
    assert "explode(_found" in executed(found) and "array_remove(" in executed(found)
    assert sorted_rows(found) == sorted_rows(rules.node_findings(nodes, DEFAULT, evidence=True).select(found.columns))


def test_equal_plans_share_their_findings(spark):
    """Plans of three shifts have the findings of the first; an analysis sees one of them."""
    nodes = registry.plan_nodes(spark, SF).localCheckpoint()
    last = nodes.agg(F.max("plan_id")).first()[0] + 1
    thrice = nodes.withColumn("plan_id", F.explode(F.array(*[F.col("plan_id") + k * last for k in range(3)])))
    seen = []

    def analysis(x):
        seen.append(x.select("plan_id").distinct().count())
        return rules.node_findings(x, DEFAULT)

    found = dictionary.once_each(thrice, analysis)
    assert sorted_rows(found.select("plan_id", "node_id", "analyzer", "rule", "severity")) == sorted_rows(rules.node_findings(thrice, DEFAULT))
    assert seen == [dictionary.trees(nodes).select("tree").distinct().count()]


def test_places_and_lost_parents_tell_trees_apart(spark):
    a, b = {"a": "1", "b": "2"}, {"b": "2", "a": "1"}
    rows = [
        (1, 1, None, [], 0, "Join", 5, 1, a), (1, 2, 1, [0], 1, "Scan", 7, 1, None),
        (2, 1, None, [], 0, "Join", 5, 1, a), (2, 3, 1, [1], 1, "Scan", 7, 1, None),  # its second child alone
        (3, 1, None, [], 0, "Join", 5, 1, b), (3, 2, 1, [0], 1, "Scan", 7, 1, None),  # as 1: properties in another order
        (4, 1, None, [], 0, "Join", 5, 1, a), (4, 2, 1, [0], 1, "Scan", 7, 1, None), (4, 9, 4, [1, 0, 0], 3, "Sort", 9, 1, None),  # a node whose parents are lost
    ]
    nodes = spark.createDataFrame(rows, SCHEMA)
    assert sorted_rows(dictionary.members(nodes).select("plan_id", "first")) == [(1, 1), (2, 2), (3, 1), (4, 4)]
    assert sorted_rows(dictionary.trees(nodes).select("plan_id", "size")) == [(1, 2), (2, 2), (3, 2), (4, 3)]
    known = {r.plan_id: r.tree for r in dictionary.trees(nodes).collect()}
    assert {r.plan_id: r.tree for r in dictionary.members(nodes).collect()} == known
