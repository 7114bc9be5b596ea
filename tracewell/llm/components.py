"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges shrunk to stars around the smallest vertex of each of its own components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(names))
        while True:
            before = root.copy()
            np.minimum.at(root, root[u], root[v].copy())
            np.minimum.at(root, root[v], root[u].copy())
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            if (root == before).all():
                break
        out = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[root[out]])], ["a", "b"])


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest vertex reachable from each vertex that has an edge to another one.

    Vertices are longs. Null vertices and self-loops are ignored; repeated edges and an empty input are fine. Nothing
    is collected to the driver but two numbers a round; each round is written to the shared folder.
    """
    e = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    e = e.mapInArrow(trimmed(_forest), "a long, b long").distinct()
    e, seen = materialize(e, "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").hint("merge").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.filter("m < a").select("a", F.col("m").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        ).distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components aren't complete after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
