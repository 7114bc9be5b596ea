"""What a node's kind says about its properties: a second look at each node with its property lines read.

Each column holds for some kinds only and is null for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .properties import aggregate_functions, group_keys, prop, sort_keys


def _when(kinds: tuple[str, ...], value: Column) -> Column:
    return F.when(F.col("kind").isin(*kinds), value)


def _from_line(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("original_text", pattern, 1), F.lit(""))


def _number(name: str) -> Column:
    return prop(name).try_cast("int")


def node_label() -> Column:
    """A node's line without its numbers."""
    return F.trim(F.split_part("original_text", F.lit("  (cost"), F.lit(1)))


def typed(nodes: DataFrame) -> DataFrame:
    """nodes with the columns that their kinds give a meaning: conditions, workers, keys, functions, methods, limits, caches, subplans."""
    aggregates, grouped = ("Aggregate", "GroupAggregate", "HashAggregate"), ("GroupAggregate", "HashAggregate")
    return nodes.withColumns({
        "label": node_label(),
        "recheck_condition": _when(("BitmapHeapScan",), prop("Recheck Cond")),
        "workers_planned": _when(("ParallelBitmapHeapScan", "GatherMerge"), F.coalesce(_number("Workers Planned"), _from_line(r"Workers Planned: (\d+)").try_cast("int"))),
        "workers_launched": _when(("GatherMerge",), _number("Workers Launched")),
        "inner_unique": _when(("NestedLoop", "NestedLoopLeftJoin"), F.lower(F.coalesce(prop("Inner Unique"), _from_line(r"Inner Unique: (true|false)"), F.lit("false"))) == "true"),
        "hash_condition": _when(("HashJoin",), prop("Hash Cond")), "merge_condition": _when(("MergeJoin",), prop("Merge Cond")),
        "group_keys": _when(grouped, group_keys(prop("Group Key"))), "functions": _when(aggregates, aggregate_functions(prop("Output"))),
        "hash_batches": _when(("HashAggregate",), F.coalesce(_number("Batches"), _number("Hash Batches"))),
        "hash_buckets": _when(("Hash",), F.coalesce(_number("Buckets"), _number("Hash Buckets"))),
        "sort_keys": _when(("Sort",), sort_keys(prop("Sort Key"))), "sort_method": _when(("Sort",), prop("Sort Method")),
        "limit_count": _when(("Limit",), _from_line(r"(?i)limit\s+(\d+)").try_cast("bigint")), "limit_offset": _when(("Limit",), _from_line(r"(?i)offset\s+(\d+)").try_cast("bigint")),
        "cache_key": _when(("Memoize",), prop("Cache Key")), "cache_mode": _when(("Memoize",), F.coalesce(prop("Cache Mode"), _from_line(r"Cache Mode: (\w+)"))),
        "subplan": _when(("SubPlan",), _from_line(r"(?i)subplan\s+(\S+)")),
    })
