"""Expressions over a node's properties and columns: keys, functions, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aggregate functions looked for by name.
_AGGREGATES = ("count", "sum", "avg", "min", "max", "array_agg", "string_agg")


def prop(name: str) -> Column:
    return F.try_element_at("props", F.lit(name))


# Names of properties in JSON plans and what text plans call them.
CANONICAL = {
    "Exact Heap Blocks": "Heap Blocks: exact", "Lossy Heap Blocks": "Heap Blocks: lossy", "Hash Batches": "Batches", "Original Hash Batches": "Original Batches", "Hash Buckets": "Buckets", "Original Hash Buckets": "Original Buckets",
}
# Properties that are whole numbers, that are true or false, and that are texts; others are the user's own.
_WHOLE = ("Workers Planned", "Workers Launched", "Rows Removed by Filter", "Rows Removed by Index Recheck", "Rows Removed by Join Filter", "Heap Blocks: exact", "Heap Blocks: lossy", "Heap Fetches", "Loops", "Batches")
_FLAGS = ("Inner Unique",)
_TEXTS = (
    "Output", "Index Cond", "Filter", "Join Filter", "Recheck Cond", "Hash Cond", "Merge Cond", "Sort Key", "Group Key", "Relation Name", "Index Name", "Alias", "Cache Key", "Cache Mode", "Sort Method", "Sort Space Used", "Function",
    "Subplan Name", "One-Time Filter", "Peak Memory Usage", "Sort Space Type",
)


def canonical(key: Column) -> Column:
    """A property's name, whichever form of plan it comes from."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair]), key), key)


def set_property(props: Column, key: str, value: Column) -> Column:
    """Properties with one set, under its canonical name, in place of any of that name; a null value leaves them as they are."""
    name = CANONICAL.get(key, key)
    others = F.map_filter(props, lambda k, _: canonical(k) != name)
    return F.when(value.isNull(), props).otherwise(F.map_concat(others, F.create_map(F.lit(name), value)))


def typed_properties(nodes, *keys: str):
    """(keys, key, kind, number, flag, text): each property of the nodes under its canonical name and with its type.

    `kind` is whole, flag, text or custom; a number or flag that can't be read as one is custom, as are unknown names. `text` is
    the value as written.
    """
    rows = nodes.select(*keys, F.explode(F.map_entries("props")).alias("p")).select(*keys, canonical(F.col("p.key")).alias("key"), F.col("p.value").alias("text"))
    number = F.when(F.col("key").isin(*_WHOLE) & F.col("text").rlike(r"^\+?\d+$"), F.col("text").try_cast("bigint"))
    word = F.lower("text")
    flag = F.when(F.col("key").isin(*_FLAGS), F.when(word.isin("true", "t", "yes", "1"), True).when(word.isin("false", "f", "no", "0"), False))
    kind = F.when(number.isNotNull(), "whole").when(flag.isNotNull(), "flag").when(F.col("key").isin(*_TEXTS), "text").otherwise("custom")
    return rows.select(*keys, "key", kind.alias("kind"), number.alias("number"), flag.alias("flag"), "text")


def sort_keys(text: Column) -> Column:
    """array<struct<expression, direction>> of a Sort Key; the direction is null where none is written."""
    def one(key: Column) -> Column:
        direction = F.nullif(F.regexp_extract(key, r" (ASC|DESC)$", 1), F.lit(""))
        return F.struct(F.regexp_replace(key, r" (ASC|DESC)$", "").alias("expression"), direction.alias("direction"))

    return F.transform(F.split(text, ","), lambda k: one(F.trim(k)))


def group_keys(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda k: F.trim(k))


def aggregate_functions(output: Column) -> Column:
    """Known aggregates in an Output line, or else all functions called there."""
    low = F.lower(output)
    known = F.filter(F.array(*map(F.lit, _AGGREGATES)), lambda f: F.contains(low, F.concat(f, F.lit("("))))
    return F.when(F.size(known) > 0, known).otherwise(F.array_distinct(F.transform(F.regexp_extract_all(output, F.lit(r"(\w+)\("), 1), lambda f: F.lower(f))))


def table_or_fallback() -> Column:
    return F.when(F.col("kind") == "BitmapIndexScan", "bitmap_index_table").otherwise(F.coalesce("table_name", prop("Relation Name"), prop("Alias"), F.lit("unknown_table")))


def index_or_fallback() -> Column:
    return F.when(F.col("kind") == "SeqScan", "no_index").otherwise(F.coalesce("index_name", prop("Index Name"), F.lit("unknown_index")))


def description() -> Column:
    """A label of a node: its kind in words, with index and table."""
    words = F.regexp_replace(F.col("kind"), r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.when(F.col("kind") == "SeqScan", "Sequential Scan").otherwise(words)
    using = F.when(F.col("index_name").isNotNull(), F.concat(F.lit("using "), F.col("index_name")))
    on = F.when(F.col("table_name").isNotNull(), F.concat(F.lit("on "), F.col("table_name")))
    return F.concat_ws(" ", words, using, on)


def shortened(value: Column, most: int = 120) -> Column:
    """A property value for display: longer ones end in three dots."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def average_cost() -> Column:
    return (F.col("startup_cost") + F.col("total_cost")) / 2


def cost_span() -> Column:
    return F.col("total_cost") - F.col("startup_cost")


def rendered() -> Column:
    """One line of a plan tree."""
    actual = F.when(F.col("actual_rows").isNotNull(), F.concat(F.lit(" (actual rows="), F.col("actual_rows").cast("string"), F.lit(" loops="), F.coalesce("actual_loops", F.lit(1)).cast("string"), F.lit(")")))
    return F.concat(
        F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") > 0, "-> ").otherwise(""), description(), F.lit("  (cost="), F.format_string("%.2f..%.2f", "startup_cost", "total_cost"), F.lit(" rows="),
        F.col("est_rows").cast("string"), F.lit(" width="), F.col("width").cast("string"), F.lit(")"), F.coalesce(actual, F.lit("")),
    )


def render_plans(nodes, *keys: str):
    """(keys, plan): each plan's tree as text. A plan's nodes are bounded by what its statement says."""
    lines = F.sort_array(F.collect_list(F.struct("path", rendered().alias("line"))))
    return nodes.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("plan"))


def render_compact(nodes, *keys: str):
    """(keys, plan): each plan's tree as descriptions alone."""
    lines = F.sort_array(F.collect_list(F.struct("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), description()).alias("line"))))
    return nodes.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("plan"))
