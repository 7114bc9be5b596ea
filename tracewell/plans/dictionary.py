"""A dictionary of plan trees: equal trees are known by a digest and kept, parsed and analysed once.

A plan's digest is one of its nodes in pre-order, each with its depth and place among its siblings, which tell the tree; it is
worked out in compiled code, and once.

A subtree's digest is one of its node's content and its children's digests in order. A plan's nodes, in reverse pre-order, are
folded with a stack in the JVM: when a node comes, the entries one level deeper are its children. So the work is linear in the
nodes, whatever the depth, and nothing is exchanged but the gathering of a plan's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .nodes import PLAN

#: What makes two nodes equal, unless the caller says otherwise.
CONTENT = ("category", "kind", "table_name", "index_name", "startup_cost", "total_cost", "est_rows", "width", "actual_time_ms", "actual_rows", "actual_loops", "props")


def content(nodes: DataFrame, *columns: str) -> Column:
    """A text that is equal for nodes equal in these columns (of CONTENT those that the table has, if none are named)."""
    kinds = dict(nodes.dtypes)
    names = columns or tuple(c for c in CONTENT if c in kinds)
    plain = [F.to_json(F.sort_array(F.map_entries(c))) if kinds[c].startswith("map") else F.col(c).cast("string") for c in names]
    return F.concat_ws(" ", *[F.concat(F.coalesce(F.octet_length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in plain])


def _folded(nodes: Column) -> Column:
    """array<struct<node_id, digest, size>> of all subtrees, root first, of nodes in reverse pre-order."""
    empty = F.struct(F.expr("cast(array() as array<struct<depth:int,digest:string,size:int>>)").alias("open"), F.expr("cast(array() as array<struct<node_id:int,digest:string,size:int>>)").alias("done"))

    def step(a: Column, x: Column) -> Column:
        children = F.filter(a.open, lambda o: o.depth == x.depth + 1)
        digest = F.sha2(F.concat(x.content, F.lit("("), F.array_join(F.transform(children, lambda c: c.digest), ","), F.lit(")")), 256)
        size = F.aggregate(children, F.lit(1), lambda s, c: s + c.size)
        own = F.struct(digest.alias("digest"), size.alias("size"))
        # children that come later in reverse order stand before those that came earlier
        return F.aggregate(
            F.array(own), a,
            lambda s, o: F.struct(
                F.concat(F.array(F.struct(x.depth.alias("depth"), o.digest.alias("digest"), o.size.alias("size"))), F.filter(s.open, lambda e: e.depth <= x.depth)).alias("open"),
                F.concat(s.done, F.array(F.struct(x.node_id.alias("node_id"), o.digest.alias("digest"), o.size.alias("size")))).alias("done"),
            ),
        )

    return F.aggregate(nodes, empty, step, lambda a: F.reverse(a.done))


def subtrees(nodes: DataFrame, *columns: str) -> DataFrame:
    """(plan, node_id, digest, size): each node's subtree by its digest and number of nodes."""
    node = F.struct("path", F.col("depth").cast("int").alias("depth"), F.col("node_id").cast("int").alias("node_id"), content(nodes, *columns).alias("content"))
    gathered = nodes.select(PLAN, node.alias("_x")).groupBy(PLAN).agg(F.sort_array(F.collect_list("_x"), asc=False).alias("_n"))
    return gathered.select(PLAN, F.explode(_folded(F.col("_n"))).alias("s")).select(PLAN, "s.*")


def trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """(plan, tree, size): each plan's digest and number of nodes. The digest is of the plan as a whole and isn't one of `subtrees`."""
    place = F.concat_ws(".", F.col("depth").cast("string"), F.get("path", F.size("path") - 1).cast("string"))
    whole = content(nodes, *columns)
    node = F.struct("path", F.concat(place, F.lit(":"), F.octet_length(whole).cast("string"), F.lit(":"), whole).alias("said"))
    # a column of its own, as an aggregate would evaluate it as an expression tree
    gathered = nodes.select(PLAN, node.alias("_x")).groupBy(PLAN).agg(F.sort_array(F.collect_list("_x")).alias("_n"))
    return gathered.select(PLAN, F.sha2(F.array_join("_n.said", "\n"), 256).alias("tree"), F.size("_n").alias("size"))


def _members(nodes: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(plan, tree as bytes, first) and the least plans alone, with the digests worked out once."""
    known = stored(trees(nodes, *columns).select(PLAN, F.unhex("tree").alias("tree")))
    first = known.groupBy("tree").agg(F.min(PLAN).alias("first"))
    return known.join(first, "tree").select(PLAN, "tree", "first"), first.select(F.col("first").alias(PLAN))


def members(nodes: DataFrame, *columns: str) -> DataFrame:
    """(plan, tree, first): which tree each plan is, and the least plan that is the same."""
    return _members(nodes, *columns)[0].withColumn("tree", F.lower(F.hex("tree")))


def distinct_plans(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes of one plan for each tree, from `members`."""
    return nodes.join(of.filter(F.col(PLAN) == F.col("first")).select(PLAN), PLAN, "left_semi")


def once_each(nodes: DataFrame, analysis, *columns: str) -> DataFrame:
    """What an analysis (of nodes, with a plan column) finds, worked out for one plan of each tree and given to all equal plans."""
    of, first = _members(nodes, *columns)
    found = analysis(nodes.join(first, PLAN, "left_semi")).withColumnRenamed(PLAN, "first")
    return of.select(PLAN, "first").join(found, "first").drop("first")
