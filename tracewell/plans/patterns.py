"""Structural joins over plan trees: patterns such as "a sort above a nested loop above a sequential scan".

A node's interval of places in pre-order covers exactly its subtree, so ancestor and descendant are a containment of
intervals. The nodes that some step of a pattern wants are dealt by plan and sorted by place; one pass with a stack for each step
finds all matches, in work proportional to these nodes and the matches. No path is exploded and no pair is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import PLAN

_MATCH = f"{PLAN} {{kind}}, matched array<int>"


@dataclass(frozen=True)
class Step:
    """A condition on a node, and whether it must be a child of the step before or may be any descendant."""

    condition: Column
    child: bool = False


def with_intervals(nodes: DataFrame) -> DataFrame:
    """nodes with `pre`, their place in pre-order from 0, and `last`, the place of their last descendant (`pre` for a leaf).

    What comes before a node in pre-order are its ancestors and all to its left, in post-order its descendants and all to its
    left: so it has post - pre + depth descendants.
    """
    by_path = Window.partitionBy(PLAN).orderBy("path")
    after = Window.partitionBy(PLAN).orderBy(F.concat(F.col("path"), F.array(F.lit(2**31 - 1))))
    return nodes.withColumn("pre", F.row_number().over(by_path) - 1).withColumn("last", (F.row_number().over(after) - 1 + F.col("depth")).cast("int"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(plan, node, descendants): how many nodes are below each, from the intervals alone."""
    return with_intervals(nodes).select(PLAN, "node_id", (F.col("last") - F.col("pre")).alias("descendants"))


class PathStacks:
    """Matches of a chain of steps within one plan whose wanted nodes come in pre-order."""

    def __init__(self, child: list[bool]) -> None:
        self.child = child
        self.stacks: list[list[tuple]] = [[] for _ in child]

    def _chains(self, step: int, below: int, depth: int) -> Iterator[list[int]]:
        """Node ids for steps up to `step`, from the first `below` open nodes of that step, above a node of this depth."""
        stack = self.stacks[step]
        if self.child[step + 1]:
            found = [stack[below - 1]] if below and stack[below - 1][2] == depth - 1 else []
        else:
            found = stack[:below]
        for node, _, at, under in found:
            if step == 0:
                yield [node]
            else:
                for chain in self._chains(step - 1, under, at):
                    chain.append(node)
                    yield chain

    def add(self, node: int, pre: int, last: int, depth: int, mask: int) -> Iterator[list[int]]:
        for stack in self.stacks:
            while stack and stack[-1][1] < pre:
                stack.pop()
        for step in range(len(self.child) - 1, -1, -1):  # the last step first: a node isn't its own ancestor
            if mask >> step & 1:
                under = len(self.stacks[step - 1]) if step else 0
                if step == len(self.child) - 1:
                    if step == 0:
                        yield [node]
                    for chain in self._chains(step - 1, under, depth) if step else ():
                        chain.append(node)
                        yield chain
                elif step == 0 or under:
                    self.stacks[step].append((node, last, depth, under))


def _matching(child: list[bool], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, stacks = object(), None
        for batch in batches:
            plans, out = [], []
            for own, node, pre, last, depth, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != plan:
                    plan, stacks = own, PathStacks(child)
                for chain in stacks.add(node, pre, last, depth, mask):
                    plans.append(plan)
                    out.append(chain)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(plans, kind), pa.array(out, pa.list_(pa.int32()))], names=[PLAN, "matched"])
                    plans, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(plans, kind), pa.array(out, pa.list_(pa.int32()))], names=[PLAN, "matched"])

    return run


def find(nodes: DataFrame, *steps: Step) -> DataFrame:
    """(plan, matched): one row for each way to match the steps along a path from above to below; matched has their node ids.

    A null condition doesn't match. Nodes with a null plan take no part.
    """
    from ..session import ship_package

    ship_package(nodes.sparkSession)
    mask = F.lit(0)
    for k, step in enumerate(steps):
        mask = mask.bitwiseOR(F.when(F.coalesce(step.condition, F.lit(False)), 1 << k).otherwise(0))
    wanted = with_intervals(nodes.withColumn("_mask", mask).filter(F.col(PLAN).isNotNull())).filter("_mask > 0")
    kind = dict(nodes.dtypes)[PLAN]
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    dealt = wanted.select(PLAN, F.col("node_id").cast("int"), F.col("pre").cast("int"), "last", F.col("depth").cast("int"), "_mask").sortWithinPartitions(PLAN, "pre")
    return dealt.mapInArrow(_matching([s.child for s in steps], arrow), _MATCH.format(kind=kind))
