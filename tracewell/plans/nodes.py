"""Algebra of plan trees over the node table (plan_id, node_id, parent_id, path, depth, ...).

Ancestors and descendants come from the path of child numbers that each node carries, exploded into its prefixes, so
that every relation in a tree is an equi-join within a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAN = "plan_id"


def summary(nodes: DataFrame) -> DataFrame:
    """Nodes, depth (leaf-only plan: 1), summed costs, and use of indexes and workers, of each plan."""
    return nodes.groupBy(PLAN).agg(
        F.count("*").alias("node_count"), (F.max("depth") + 1).alias("max_depth"), F.sum("total_cost").alias("total_cost"), F.sum("startup_cost").alias("startup_cost"),
        F.count_if(F.col("category") == "scan").alias("scans"), F.count_if(F.col("category") == "join").alias("joins"),
        F.bool_or(F.col("kind").isin("IndexScan", "IndexOnlyScan", "BitmapIndexScan")).alias("uses_indexes"), F.bool_or(F.col("kind").isin("GatherMerge", "ParallelBitmapHeapScan")).alias("uses_parallel"),
    )


def kind_counts(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "kind").agg(F.count("*").alias("nodes"))


def of_category(nodes: DataFrame, *categories: str) -> DataFrame:
    """The scans, joins or other nodes of the named categories."""
    return nodes.filter(F.col("category").isin(*categories))


def tables(nodes: DataFrame) -> DataFrame:
    """(plan, tables): the different tables of each plan, in order; plans without scans have none."""
    return nodes.groupBy(PLAN).agg(F.sort_array(F.collect_set("table_name")).alias("tables"))


def uses_workers(nodes: DataFrame) -> DataFrame:
    """(plan, uses_workers, workers): whether a node gathers from workers, or plans or launches some, and how many at most."""
    planned = F.greatest(*[F.coalesce(F.try_element_at("props", F.lit(k)).try_cast("int"), F.lit(0)) for k in ("Workers Planned", "Workers Launched")])
    parallel = F.col("kind").isin("GatherMerge", "ParallelBitmapHeapScan") | (planned > 0)
    return nodes.groupBy(PLAN).agg(F.bool_or(parallel).alias("uses_workers"), F.max(planned).alias("workers"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.select(PLAN, F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
    return nodes.join(parents, [PLAN, "node_id"], "left_anti")


def at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("depth") == depth)


def edges(nodes: DataFrame) -> DataFrame:
    """(plan, parent, child)."""
    return nodes.filter("parent_id is not null").select(PLAN, F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))


def siblings(nodes: DataFrame) -> DataFrame:
    """(plan, node, sibling): the other children of its parent."""
    e = edges(nodes)
    a, b = e.select(PLAN, "parent", F.col("child").alias("node")), e.select(PLAN, "parent", F.col("child").alias("sibling"))
    return a.join(b, [PLAN, "parent"]).filter("node <> sibling").select(PLAN, "node", "sibling")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(plan, node, ancestor, distance), nearest first at distance 1."""
    key = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    above = nodes.filter("depth > 0").select(PLAN, F.col("node_id").alias("node"), "depth", "path", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("up"))
    above = above.withColumn("_k", F.array_join(F.slice(F.col("path").cast("array<string>"), F.lit(1), F.col("up")), "."))
    tops = nodes.select(PLAN, F.col("node_id").alias("ancestor"), key("path").alias("_k"), F.col("depth").alias("up"))
    return above.join(tops, [PLAN, "up", "_k"]).select(PLAN, "node", "ancestor", (F.col("depth") - F.col("up")).alias("distance"))


def descendants(nodes: DataFrame) -> DataFrame:
    return ancestors(nodes).select(PLAN, F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether path a is a proper prefix of path b."""
    return (F.size(a) < F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def at_path(nodes: DataFrame, path: list[int]) -> DataFrame:
    return nodes.filter(F.col("path") == F.array(*map(F.lit, path)) if path else F.size("path") == 0)


def with_children(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes with the sums of columns over their direct children, child_<column> (0 for leaves)."""
    sums = nodes.filter("parent_id is not null").groupBy(PLAN, F.col("parent_id").alias("node_id")).agg(*[F.sum(c).alias(f"child_{c}") for c in columns], F.count("*").alias("children"))
    out = nodes.join(sums, [PLAN, "node_id"], "left")
    return out.fillna(0, [*[f"child_{c}" for c in columns], "children"])


def self_cost(nodes: DataFrame) -> DataFrame:
    """nodes with self_cost: total minus the children's totals, at least 0."""
    return with_children(nodes, "total_cost").withColumn("self_cost", F.greatest(F.col("total_cost") - F.col("child_total_cost"), F.lit(0.0)))


def metrics(nodes: DataFrame) -> DataFrame:
    """(plan, node, metric, value): one row a number of each node; missing actuals give none."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in (
        ("total_cost", "total_cost"), ("startup_cost", "startup_cost"), ("estimated_rows", "est_rows"), ("estimated_width", "width"), ("actual_rows", "actual_rows"),
    )])
    return nodes.select(PLAN, "node_id", F.explode(pairs).alias("m")).select(PLAN, "node_id", "m.*").filter("value is not null")


def breadth_first(nodes: DataFrame) -> DataFrame:
    """nodes with `bfs`, their place in level order within the plan."""
    return nodes.withColumn("bfs", F.row_number().over(Window.partitionBy(PLAN).orderBy("depth", "path")))


def post_order(nodes: DataFrame) -> DataFrame:
    """nodes with `post`, their place when children come before their parent: deeper paths first within a common prefix."""
    # a path followed by a number above all children sorts behind the whole subtree
    w = Window.partitionBy(PLAN).orderBy(F.concat(F.col("path"), F.array(F.lit(2**31 - 1))))
    return nodes.withColumn("post", F.row_number().over(w))


def children_estimates(nodes: DataFrame) -> DataFrame:
    """nodes with the estimated rows and widths of their first and second child (null where missing).

    Parsed nodes carry them; a table without them is joined with its children.
    """
    if {"left_est_rows", "left_width", "right_est_rows", "right_width"} <= set(nodes.columns):
        return nodes
    kids = nodes.filter("parent_id is not null").withColumn("_k", F.element_at("path", -1))
    picked = kids.groupBy(PLAN, F.col("parent_id").alias("node_id")).agg(*[
        F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{side}_{c}") for k, side in ((0, "left"), (1, "right")) for c in ("est_rows", "width")
    ])
    return nodes.join(picked, [PLAN, "node_id"], "left")
