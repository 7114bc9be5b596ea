"""Server logs as tables: ordered lines, and the entries (statement, plan, duration) assembled from them.

Lines are ordered by file, block and place in the block, all of which a split scan knows. An entry's number is the count
of timestamped lines up to it: within a block by a window, over blocks by a sum of the few counts a file has.
So a large file is read and assembled by many tasks, and no window spans a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.prefix import DEFAULT, parse_prefix
from ..functions.sqltext import format_column, normalize_column
from ..operators.groups import group_stats
from ..session import ship_package
from .compressed import CompressedLogs
from .growing import listed

LINE_SCHEMA = "file string, block long, place long, value string"


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(file, block, place, value) of plain, .gz and .bz2 logs; splittable ones are read in blocks."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def read_lines_by_content(spark: SparkSession, path: str | list[str], max_bytes: int = 16 << 30, errors: bool = False, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Like read_lines for files whose compression shows in their first bytes, not in their names (sources.compressed).

    Files are shared out by gzip members, bzip2 blocks or lines, each task inflating its own in parts and stopping where they
    exceed max_bytes. With `errors`, a range that can't be read gives one row with its `error` and no value, besides the lines
    before the damage, and the others are read; else it is an error.
    """
    ship_package(spark)
    spark.dataSource.register(CompressedLogs)
    found = None
    for p in [path] if isinstance(path, str) else path:
        rows = spark.read.format("compressed_logs").options(path=p, maxBytes=max_bytes, keepGoing=errors, chunkBytes=chunk_bytes).load()
        found = rows if found is None else found.unionByName(rows)
    return found if errors else found.drop("error")


def read_log_patterns(spark: SparkSession, patterns: list[str], **options) -> DataFrame:
    """Lines of the files of several globs or folders, each with the `pattern` that it came from.

    The pattern, not the file's name, is what metrics are labelled with: names are many. A pattern that no file matches is left
    out, and a file that two patterns match counts for the first.
    """
    taken: set[str] = set()
    found = None
    for pattern in patterns:
        own = [f.path for f in listed(pattern) if f.path not in taken]
        taken.update(own)
        if own:
            rows = read_lines(spark, own, **options).withColumn("pattern", F.lit(pattern))
            found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], LINE_SCHEMA + ", pattern string") if found is None else found


def lines_of_text(spark: SparkSession, text: str, name: str = "text") -> DataFrame:
    """The lines of a string."""
    rows = text.split("\n")
    return spark.createDataFrame([(name, 0, i, v) for i, v in enumerate(rows)], LINE_SCHEMA)


def limit_line_bytes(lines: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Cuts lines at a number of bytes (0: none)."""
    if not max_bytes:
        return lines
    return lines.withColumn("value", F.when(F.octet_length("value") > max_bytes, F.decode(F.substring(F.encode("value", "UTF-8"), 1, max_bytes), "UTF-8")).otherwise(F.col("value")))


def limit_lines(texts: DataFrame, max_line_bytes: int = 0, max_entry_bytes: int = 0) -> DataFrame:
    """Entries (file, entry, l) with lines cut at a number of bytes, and without the lines beyond a number of bytes of all (0: none)."""
    if max_line_bytes:
        short = lambda x: F.when(F.octet_length(x) > max_line_bytes, F.decode(F.substring(F.encode(x, "UTF-8"), 1, max_line_bytes), "UTF-8")).otherwise(x)
        texts = texts.withColumn("l", F.transform("l", short))
    if max_entry_bytes:
        upto = F.aggregate("l", F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("n")), lambda a, x: F.struct((a.b + F.octet_length(x) + 1).alias("b"), (a.n + F.when(a.b + F.octet_length(x) + 1 <= max_entry_bytes, 1).otherwise(0)).alias("n")), lambda a: a.n)
        texts = texts.withColumn("l", F.slice("l", 1, upto))
    return texts


def number_entries(lines: DataFrame) -> DataFrame:
    """lines with `entry`: how many timestamped lines their file has up to them (0: before the first)."""
    rows = lines.withColumn("_s", ln.is_line_start("value").cast("int"))
    inner = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("file", "block").agg(F.sum("_s").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    rows = rows.withColumn("_i", F.sum("_s").over(inner))
    return rows.join(blocks, ["file", "block"]).withColumn("entry", F.col("_i") + F.col("_b")).drop("_s", "_i", "_b")


def _untab(line: Column) -> Column:
    return F.regexp_replace(line, r"^\t", "")


def plan_place(rest: Column) -> Column:
    """struct<kind, first, last> of the plan among an entry's lines (numbered from 1); kind is null if there is none.

    One pass over the lines. A line with a cost begins a text plan, which goes on to the end. A line that opens a JSON value is
    followed, by bracket depth outside of strings, to the line that closes it: if what lies between is valid JSON with a
    "Plan", that is the plan, else it is a literal in the statement, and the search goes on after it. Each value is parsed once,
    where it closes, so the work is in proportion to the entry's length.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("opened"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("first"), F.lit(0).alias("last")
    )

    def state(at, opened=0, depth=0, quoted=False, kind=None, first=0, last=0) -> Column:
        given = {"at": at, "opened": opened, "depth": depth, "quoted": quoted, "kind": kind, "first": first, "last": last}
        kinds = {"quoted": "boolean", "kind": "string"}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(k, "int")).alias(k) for k, v in given.items()])

    def step(a: Column, line: Column) -> Column:
        at = a.at + 1
        opened = F.when(a.opened > 0, a.opened).otherwise(at)
        whole = F.regexp_replace(F.concat(F.when(a.quoted, '"').otherwise(""), F.regexp_replace(line, r"\\.", "")), r'"[^"]*"', "")
        quoted = F.contains(whole, F.lit('"'))
        outside = F.substring_index(whole, '"', 1)
        depth = a.depth + F.length(outside) - F.length(F.translate(outside, "[{", "")) - (F.length(outside) - F.length(F.translate(outside, "]}", "")))
        parsed = F.try_parse_json(F.array_join(F.slice(rest, opened, at - opened + 1), "\n"))
        is_plan = F.try_variant_get(parsed, "$.Plan", "variant").isNotNull() | F.try_variant_get(parsed, "$[0].Plan", "variant").isNotNull()
        closed = F.when(F.coalesce(is_plan, F.lit(False)), state(at, kind="json", first=opened, last=at)).otherwise(state(at))
        in_json = F.when(depth > 0, state(at, opened, depth, quoted)).otherwise(closed)
        in_statement = F.when(line.rlike(ln.COST), state(at, kind="text", first=at, last=F.size(rest))).otherwise(state(at))
        return F.when(a.kind.isNotNull(), a).when((a.opened > 0) | ln.looks_like_json(line), in_json).otherwise(in_statement)

    at_cost = F.array_position(F.transform(rest, lambda x: x.rlike(ln.COST)), True)
    at_open = F.array_position(F.transform(rest, ln.looks_like_json), True)
    plain = F.when(at_cost > 0, state(0, kind="text", first=at_cost, last=F.size(rest))).otherwise(state(0))
    found = F.when((at_open > 0) & ((at_cost == 0) | (at_open < at_cost)), F.aggregate(rest, start, step)).otherwise(plain)
    return F.struct(found["kind"].alias("kind"), found["first"].alias("first"), found["last"].alias("last"))


def assembled(lines: DataFrame, max_entry_bytes: int = 0) -> DataFrame:
    """(file, entry, l): the lines of each entry in order. Lines of an entry beyond max_entry_bytes (0: none) are cut off."""
    rows = number_entries(lines).filter("entry > 0")
    if max_entry_bytes:
        upto = Window.partitionBy("file", "entry").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
        large = rows.groupBy("file", "entry").agg(F.sum(F.octet_length("value") + 1).alias("_b")).filter(F.col("_b") > max_entry_bytes).select("file", "entry")
        cut = rows.join(large, ["file", "entry"], "left_semi").withColumn("_b", F.sum(F.octet_length("value") + 1).over(upto)).filter(F.col("_b") <= max_entry_bytes).drop("_b")
        rows = rows.join(large, ["file", "entry"], "left_anti").unionByName(cut)
    return rows.groupBy("file", "entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "value"))), lambda x: x.value).alias("l"))


def parsed_entries(texts: DataFrame, log_line_prefix: str = DEFAULT, zone_overrides: dict[str, int] | None = None, fixed_zone: int | None = None, without_plan: bool = False) -> DataFrame:
    """Plan entries from their lines (file, entry, l), row by row: see `entries`."""
    prefix = parse_prefix(log_line_prefix)
    head = F.col("l")[0]
    texts = texts.withColumn("duration_ms", ln.duration_ms(head)).filter(F.col("duration_ms").isNotNull())
    texts = texts.withColumn("rest", F.filter(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), _untab), lambda x: F.trim(x) != ""))
    texts = texts.withColumn("_p", plan_place(F.col("rest")))
    found = F.col("_p.kind").isNotNull()
    if not without_plan:
        # a filter here would be moved below the lines' own column, and both be worked out again at each use; a generator's result isn't
        texts = texts.withColumn("_p", F.explode_outer(F.array("_p"))).filter(found)
    plan = F.when(found, F.array_join(F.slice("rest", F.greatest(F.col("_p.first"), F.lit(1)), F.greatest(F.col("_p.last") - F.col("_p.first") + 1, F.lit(0))), "\n"))
    said = F.regexp_replace(F.array_join(F.slice("rest", F.lit(1), F.when(found, F.col("_p.first") - 1).otherwise(F.size("rest"))), "\n"), r"^\s*Query Text: ", "")
    inside = F.try_variant_get(F.try_parse_json(plan), "$['Query Text']", "string")
    query = F.when(F.col("_p.kind") == "json", F.coalesce(inside, said)).otherwise(said)
    return texts.select(
        "file", "entry", ln.utc_timestamp(ln.timestamp_text(head), zone_overrides, fixed_zone).alias("ts"), "duration_ms", prefix.database(ln.message(head)).alias("database"),
        query.alias("query_text"), F.col("_p.kind").alias("plan_format"), plan.alias("plan_text"),
    )


def entries(
    lines: DataFrame, log_line_prefix: str = DEFAULT, zone_overrides: dict[str, int] | None = None, fixed_zone: int | None = None, max_entry_bytes: int = 0, without_plan: bool = False
) -> DataFrame:
    """Plan entries: file, entry, ts (UTC), duration_ms, database, query_text, plan_format, plan_text.

    An entry is a line `duration: <n> ms  plan:` with the lines up to the next timestamped one. The plan begins at the
    first line with a cost, or at a line that opens JSON which holds a plan; other JSON inside a statement stays part of it.
    Entries without plan are dropped, or, with without_plan, kept with null plan columns and the rest as their statement.
    """
    return parsed_entries(assembled(lines, max_entry_bytes), log_line_prefix, zone_overrides, fixed_zone, without_plan)


def with_normal_forms(found: DataFrame, formatted: bool = False) -> DataFrame:
    """Entries with normalized_query and fingerprint of their statement (and its layout), each distinct shape worked out once."""
    out = found.withColumn("_n", normalize_column("query_text"))
    out = out.withColumns({"normalized_query": F.col("_n.normalized_query"), "fingerprint": F.col("_n.fingerprint"), "normalized": F.col("_n.successful")}).drop("_n")
    return out.withColumn("formatted_query", format_column("normalized_query")) if formatted else out


def executions_of(found: DataFrame) -> DataFrame:
    """Entries as executions: one row each with fingerprint, database, time, duration and an order that parsing gives."""
    rows = found if "fingerprint" in found.columns else with_normal_forms(found)
    return rows.withColumn("seq", F.struct("file", "entry"))


def log_groups(lines: DataFrame, log_line_prefix: str = DEFAULT, **options) -> DataFrame:
    """From log lines to statement groups: entries, normal forms, fingerprints, statistics, each worked out once.

    A fingerprint is a digest of the normal form, so the form is part of the group's key and needs no join.
    """
    rows = executions_of(entries(lines, log_line_prefix, **options))
    return group_stats(rows, ("fingerprint", "normalized_query", "database"))
