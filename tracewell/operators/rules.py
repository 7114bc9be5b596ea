"""Plan analyzers: row-local predicates over plan nodes, and plan-level ones over their aggregates.

A rule is a name, the kind of its finding, a severity expression that is null where the rule doesn't fire, a sentence, and
the numbers that it rests on. All node-local rules are evaluated in one pass over the node table, with their evidence if it is
asked for; what they need of children is joined once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import nodes as n
from .config import Thresholds

SEVERITIES = ("Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Rule:
    analyzer: str
    name: str
    severity: Column
    says: str = ""
    evidence: dict[str, Column] = field(default_factory=dict)


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i + 1).otherwise(out)
    return out


def classify(value: Column, medium: float, high: float, critical: float) -> Column:
    """Low, or the class of the largest threshold reached."""
    return F.when(value >= critical, "Critical").when(value >= high, "High").when(value >= medium, "Medium").otherwise("Low")


def _class(value: Column, medium: float, high: float, critical: float) -> Column:
    """The rank of `classify`."""
    return F.when(value >= critical, 4).when(value >= high, 3).when(value >= medium, 2).otherwise(1)


def _tiers(value: Column, *tiers: tuple[float, str]) -> Column:
    """Severity of the first tier (largest first) that the value exceeds."""
    out = None
    for limit, name in tiers:
        out = F.when(value > limit, name) if out is None else out.when(value > limit, name)
    return out


def _prop(name: str, kind: str = "string") -> Column:
    value = F.try_element_at("props", F.lit(name))
    return value if kind == "string" else value.try_cast(kind)


def _kb(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*([\d.]+)", 1).try_cast("double")


def hash_memory_kb(left_rows: Column, right_rows: Column, left_width: Column, right_width: Column) -> Column:
    """Estimated memory of a hash join in KB, in doubles."""
    size, width = F.least(left_rows, right_rows).cast("double"), F.least(left_width, right_width).cast("double")
    t = size * width + 24 * size + 8 * F.greatest(1.5 * size, F.lit(1024.0))
    return ((t * 1.12) + 1024 * F.greatest(size / 10000, F.lit(1.0))) / 1024 * 1.1


def node_facts(t: Thresholds, work_mem_kb: int = 4096) -> dict[str, Column]:
    """What the rules share, as columns: worked out once a node, so that each rule stays a short expression."""
    c = F.col
    left, right = F.coalesce("left_est_rows", F.lit(1)).cast("double"), F.coalesce("right_est_rows", F.lit(1)).cast("double")
    mem = hash_memory_kb(F.coalesce("left_est_rows", F.lit(1)), F.coalesce("right_est_rows", F.lit(1)), F.coalesce("left_width", F.lit(0)), F.coalesce("right_width", F.lit(0))) / work_mem_kb
    flt = _prop("Filter")
    return {
        "_rows": classify(c("est_rows"), *t.rows), "_cost": classify(c("total_cost"), *t.cost), "_seen": classify(F.coalesce("actual_rows", "est_rows"), *t.rows),
        "_rows_rank": _class(c("est_rows"), *t.rows), "_cost_rank": _class(c("total_cost"), *t.cost), "_seen_rank": _class(F.coalesce("actual_rows", "est_rows"), *t.rows),
        "_left": left, "_right": right, "_ratio": c("est_rows") / F.greatest(left * right, F.lit(1.0)), "_mem": mem, "_filter": flt, "_low_filter": F.lower(flt), "_index_cond": _prop("Index Cond"),
        "_removed": _prop("Rows Removed by Filter", "double"), "_recheck": _prop("Rows Removed by Index Recheck", "double"), "_join_removed": _prop("Rows Removed by Join Filter", "double"),
        "_fetches": _prop("Heap Fetches", "double"), "_exact": F.coalesce(_prop("Exact Heap Blocks", "double"), F.lit(0.0)), "_lossy": _prop("Lossy Heap Blocks", "double"),
        "_space": _kb(_prop("Sort Space Used")), "_method": F.lower(_prop("Sort Method")), "_batches": F.coalesce(_prop("Batches", "double"), _prop("Hash Batches", "double")),
        "_planned": _prop("Workers Planned", "double"), "_launched": _prop("Workers Launched", "double"), "_join_filter": _prop("Join Filter"), "_operation": F.lower(_prop("Operation")), "_space_type": _prop("Sort Space Type"),
    }


def node_rules(t: Thresholds, work_mem_kb: int = 4096) -> list[Rule]:
    """Rules over a node with its facts (`node_facts`), which rest on the estimates of its children too."""
    c = F.col
    rows, cost = c("_rows"), c("_cost")
    worst = F.when(c("_rows_rank") >= c("_cost_rank"), rows).otherwise(cost)
    high = lambda s, r: F.when(r >= 3, s)
    worst_rank = F.greatest("_rows_rank", "_cost_rank")
    seen = F.coalesce("actual_rows", "est_rows")
    flt, index_cond = c("_filter"), c("_index_cond")
    low_flt = c("_low_filter")
    seq, nested = c("kind") == "SeqScan", c("kind") == "NestedLoop"
    left, right, ratio, mem = c("_left"), c("_right"), c("_ratio"), c("_mem")
    startup = F.col("startup_cost")
    removed, recheck, join_removed = c("_removed"), c("_recheck"), c("_join_removed")
    by_removed = lambda v: F.when(v >= 1_000_000, "Critical").when(v >= 100_000, "High").when(v >= 10_000, "Medium")
    kept = c("actual_rows").cast("double")
    fetches, loops = c("_fetches"), F.coalesce("actual_loops", F.lit(1))
    exact, lossy = c("_exact"), c("_lossy")
    space, method, batches = c("_space"), c("_method"), c("_batches")
    planned, launched = c("_planned"), c("_launched")
    reached = lambda s, limits: F.when(s == "Critical", limits[2]).when(s == "High", limits[1]).when(s == "Medium", limits[0]).otherwise(0.0)
    functions = r"lower\(|upper\(|date\(|substring\("
    # The limits of each rule, the severities they stand for, and the names of their evidence.
    return [
        Rule("RowEstimation", "excessive_rows", F.when(c("_rows_rank") >= 2, rows),
            "The planner expects very many rows here.", dict(estimated_rows=c("est_rows"), cost=c("total_cost"))),
        Rule("RowEstimation", "cartesian", F.when(nested & c("_join_filter").isNull() & (c("est_rows") > 10000) & (ratio > 0.8), "Critical"),
            "Nearly every pair of input rows comes out: a join condition may be missing.", dict(result_rows=c("est_rows"), left_input_rows=left, right_input_rows=right, cartesian_ratio=ratio)),
        Rule("Scan", "seq_scan", F.when(seq, F.when(c("_seen_rank") >= 2, c("_seen"))),
            "A whole table is read.", dict(row_count=seen, estimated_rows=c("est_rows"), cost=c("total_cost"), severity_threshold=reached(c("_seen"), t.rows))),
        Rule("Scan", "index_scan", F.when(c("kind").isin("IndexScan", "IndexOnlyScan"), high(worst, worst_rank)),
            "An index scan returns many rows or costs much.", dict(row_count=c("est_rows"), cost=c("total_cost"), cost_threshold=reached(worst, t.cost))),
        Rule("Scan", "bitmap_scan", F.when(c("kind").isin("BitmapHeapScan", "BitmapIndexScan", "ParallelBitmapHeapScan"), high(rows, c("_rows_rank"))),
            "A bitmap scan returns many rows.", dict(row_count=c("est_rows"), cost=c("total_cost"), severity_threshold=reached(rows, t.rows))),
        Rule("Join", "nested_loop", F.when(c("kind").isin("NestedLoop", "NestedLoopLeftJoin"), high(worst, worst_rank)),
            "A nested loop handles many rows or costs much.", dict(result_rows=c("est_rows"), cost=c("total_cost"), left_input_rows=F.coalesce("left_est_rows", F.lit(0)), right_input_rows=F.coalesce("right_est_rows", F.lit(0)))),
        Rule("Join", "hash_memory", F.when((c("kind") == "HashJoin") & ((rows == "Critical") | ((c("_cost_rank") >= 3) & (c("est_rows") > 1_000_000))), _tiers(mem, (20, "Critical"), (5, "High"), (2, "Medium"), (1.2, "Low"))),
            "The hash table may not fit into memory.", dict(result_rows=c("est_rows"), cost=c("total_cost"), left_input_rows=F.coalesce("left_est_rows", F.lit(0)), right_input_rows=F.coalesce("right_est_rows", F.lit(0)), left_width_bytes=F.coalesce("left_width", F.lit(100)), right_width_bytes=F.coalesce("right_width", F.lit(100)), estimated_memory_kb=mem * work_mem_kb, work_mem_kb=F.lit(work_mem_kb), memory_pressure_ratio=mem)),
        Rule("Join", "merge_join", F.when(c("kind") == "MergeJoin", high(cost, c("_cost_rank"))),
            "A merge join costs much.", dict(cost=c("total_cost"), estimated_rows=c("est_rows"))),
        Rule("QueryPattern", "distinct", F.when(c("_operation").contains("unique") & index_cond.contains("=") & ~index_cond.contains("AND"), "Low"),
            "Rows that an equality on an index makes unique are made unique again."),
        Rule("QueryPattern", "function_in_filter", F.when(low_flt.rlike(functions), "Medium"),
            "A filter calls a function on a column, which keeps an index from being used."),
        Rule("QueryPattern", "wide_row", F.when(c("width") > 500, "Low"),
            "Rows are wide: more columns may be read than are needed.", dict(row_width_bytes=c("width"))),
        Rule("StartupCost", "high", _tiers(startup, (100_000, "Critical"), (50_000, "High"), (10_000, "Medium")),
            "Much is spent before the first row.", dict(startup_cost=startup, total_cost=c("total_cost"), startup_ratio=F.when(c("total_cost") > 0, startup / c("total_cost")).otherwise(0.0))),
        Rule("StartupCost", "dominant", F.when((startup > 1000) & (startup / c("total_cost") > 0.9), "Medium"),
            "Nearly all is spent before the first row.", dict(startup_cost=startup, total_cost=c("total_cost"), startup_percentage=startup / c("total_cost") * 100)),
        Rule("StartupCost", "external_sort", F.when((c("kind") == "Sort") & method.contains("external") & (startup > 5000), "High"),
            "A sort on disk comes before the first row.", dict(startup_cost=startup)),
        Rule("StartupCost", "materialize", F.when((c("kind") == "Materialize") & (startup > 5000), "Medium"),
            "An expensive result is kept before the first row.", dict(startup_cost=startup)),
        Rule("IndexUsage", "missing_index", F.when(seq & flt.contains("=") & ~low_flt.contains(" or ") & (c("est_rows") > 1000) & (c("est_rows") < 1_000_000), F.when(c("est_rows") > 100_000, "High").when(c("est_rows") > 10_000, "Medium").otherwise("Low")),
            "An equality filter reads a whole table: an index may be missing.", dict(estimated_rows=c("est_rows"))),
        Rule("IndexUsage", "function_in_filter", F.when(seq & low_flt.rlike(functions + r"|cast\("), "Medium"),
            "A function in the filter of a whole-table scan keeps an index from being used."),
        Rule("IndexUsage", "leading_wildcard", F.when(seq & (flt.contains("LIKE '%") | flt.contains("ILIKE '%")), "Medium"),
            "A pattern that begins with a wildcard can't use an ordinary index."),
        Rule("IndexUsage", "large_index_scan", F.when(c("kind").isin("IndexScan", "IndexOnlyScan") & (c("est_rows") > 50_000), "Medium"),
            "An index is read for very many rows.", dict(estimated_rows=c("est_rows"))),
        Rule("IndexUsage", "large_bitmap", F.when((c("kind") == "BitmapHeapScan") & (c("est_rows") > 100_000), "Medium"),
            "A bitmap covers very many rows.", dict(estimated_rows=c("est_rows"))),
        Rule("SortMemory", "disk_sort", F.when((c("_space_type") == "Disk") | method.contains("external"), F.when(space > 100_000, "High").otherwise("Medium")),
            "A sort went to disk.", dict(sort_space_used_kb=F.coalesce(space, F.lit(0.0)), work_mem_kb=F.lit(work_mem_kb))),
        Rule("SortMemory", "hash_batches", F.when(batches > 1, F.when(batches > 8, "High").otherwise("Medium")),
            "A hash table was split into batches.", dict(batches=batches, work_mem_kb=F.lit(work_mem_kb))),
        Rule("FilterEfficiency", "wasteful_filter", F.when((removed >= 10_000) & (kept.isNull() | (kept / (kept + removed) < 0.10)), by_removed(removed)),
            "A filter throws most rows away.", dict(rows_removed=removed, rows_kept=kept, selectivity=kept / (kept + removed))),
        Rule("FilterEfficiency", "recheck", F.when(recheck >= 10_000, by_removed(recheck)),
            "Many rows fail the recheck of an index.", dict(rows_removed_by_index_recheck=recheck)),
        Rule("FilterEfficiency", "join_filter", F.when(join_removed >= 10_000, by_removed(join_removed)),
            "A join's filter throws many rows away.", dict(rows_removed_by_join_filter=join_removed)),
        Rule("IndexEfficiency", "heap_fetches", F.when((fetches >= 1000) & (kept.isNull() | (kept * loops == 0) | (fetches / (kept * loops) > 0.10)), F.when(fetches >= 100_000, "High").otherwise("Medium")),
            "An index-only scan often goes to the table.", dict(heap_fetches=fetches, actual_rows=kept * loops, heap_fetch_ratio=F.when(kept * loops > 0, fetches / (kept * loops)))),
        Rule("IndexEfficiency", "lossy_bitmap", F.when((lossy >= 64) & (lossy / (lossy + exact) > 0.05), "Medium"),
            "A bitmap was too large to hold each row.", dict(heap_blocks_lossy=lossy, heap_blocks_exact=exact, lossy_fraction=lossy / (lossy + exact))),
        Rule("Parallelization", "inefficient", F.when((planned > 0) & (launched > 0) & (launched / planned < 0.5), "Medium"),
            "Few of the planned workers started.", dict(workers_planned=planned, workers_launched=launched, efficiency_ratio=launched / planned)),
    ]




def node_findings(nodes: DataFrame, thresholds: Thresholds, work_mem_kb: int = 4096, analyzers: tuple[str, ...] | None = None, evidence: bool = False) -> DataFrame:
    """(plan_id, node_id, analyzer, rule, severity) of all node-local rules; with `evidence` also a sentence, `text`, and `evidence`, a
    map of the numbers that the finding rests on (those that are known)."""
    rules = [r for r in node_rules(thresholds, work_mem_kb) if analyzers is None or r.analyzer in analyzers]
    rows = n.children_estimates(nodes)
    rows = rows.withColumns(node_facts(thresholds, work_mem_kb))
    return _fired(rows, [_finding(r, True) for r in rules], "node_id") if evidence else _named(rows, rules, "node_id")


def _named(rows: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """As `_fired`, of rules without evidence: a rule that fires leaves its number before its severity, all others are taken out in
    compiled code before the array is exploded, as most rules don't fire at a node."""
    marks = [F.coalesce(F.concat(F.lit(f"{i:03d}"), r.severity), F.lit("")) for i, r in enumerate(rules)]
    rows = rows.select(n.PLAN, *keys, F.array_remove(F.array(*marks), "").alias("_found"))
    rows = rows.select(n.PLAN, *keys, F.explode_outer("_found").alias("_m")).filter("_m is not null")
    of = lambda names: F.get(F.array(*map(F.lit, names)), F.substring("_m", 1, 3).cast("int"))
    return rows.select(n.PLAN, *keys, of([r.analyzer for r in rules]).alias("analyzer"), of([r.name for r in rules]).alias("rule"), F.substr("_m", F.lit(4)).alias("severity"))


def _fired(rows: DataFrame, found: list[Column], *keys: str) -> DataFrame:
    """One row for each finding with a severity, in compiled code: under a lambda all rules would be evaluated as expression trees.

    explode_outer, as explode would have the size of its array tested first, below, where all rules are worked out once more.
    """
    rows = rows.select(n.PLAN, *keys, F.array(*found).alias("_found"))
    return rows.select(n.PLAN, *keys, F.explode_outer("_found").alias("f")).filter("f.severity is not null").select(n.PLAN, *keys, "f.*")


def _finding(rule: Rule, evidence: bool) -> Column:
    own = [F.lit(rule.analyzer).alias("analyzer"), F.lit(rule.name).alias("rule"), rule.severity.alias("severity")]
    if evidence:
        numbers = [x for name, value in rule.evidence.items() for x in (F.lit(name), value.cast("double"))]
        known = F.map_filter(F.create_map(*numbers), lambda _, v: v.isNotNull()) if numbers else F.expr("cast(map() as map<string,double>)")
        own += [F.lit(rule.says).alias("text"), F.when(rule.severity.isNotNull(), known).alias("evidence")]
    return F.struct(*own)


def _counter(text: Column, group: str, key: str) -> Column:
    """A count such as read of `shared hit=8 read=2, temp written=1`; 0 if absent."""
    return F.coalesce(F.regexp_extract(text, rf"{group}(?: \w+=\d+)*? {key}=(\d+)", 1).try_cast("bigint"), F.lit(0))


def buffer_findings(nodes: DataFrame) -> DataFrame:
    """(plan_id, node_id, analyzer, rule, severity) of spills, disk reads and WAL. A node's own count is its total minus its children's, at least 0."""
    buffers, wal = _prop("Buffers"), _prop("WAL")
    counts = {"temp_read": _counter(buffers, "temp", "read"), "temp_written": _counter(buffers, "temp", "written"), "shared_read": _counter(buffers, "shared", "read"), "local_read": _counter(buffers, "local", "read"), "wal": _counter(F.concat(F.lit("wal "), wal), "wal", "bytes")}
    counts = {k: F.coalesce(v, F.lit(0)) for k, v in counts.items()}
    rows = n.with_children(nodes.withColumns(counts), *counts)
    own = lambda k: F.greatest(F.col(k) - F.col(f"child_{k}"), F.lit(0))
    temp, read, written = own("temp_read") + own("temp_written"), own("shared_read") + own("local_read"), own("wal")
    mb = lambda blocks: blocks * 8192 / 1e6
    rules = [
        ("temp_spill", F.when(temp >= 1, F.when(mb(temp) >= 100, "Critical").when(mb(temp) >= 10, "High").when(mb(temp) >= 1, "Medium").otherwise("Low"))),
        ("disk_reads", F.when(read >= 1024, F.when(mb(read) >= 512, "High").when(mb(read) >= 64, "Medium").otherwise("Low"))),
        ("wal", F.when(written >= 1_048_576, F.when(written >= 64e6, "High").when(written >= 8e6, "Medium").otherwise("Low"))),
    ]
    return _fired(rows, [F.struct(F.lit("BufferWal").alias("analyzer"), F.lit(r).alias("rule"), s.alias("severity")) for r, s in rules], "node_id")


def missed_parallelism(nodes: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Large scans, joins and aggregates that run without workers; not part of the default set."""
    rows, cost = classify(F.col("est_rows"), *thresholds.rows), classify(F.col("total_cost"), *thresholds.cost)
    worst = F.when(rank(rows) >= rank(cost), rows).otherwise(cost)
    parallel = _prop("Workers Planned").isNotNull() | _prop("Workers Launched").isNotNull() | F.col("kind").rlike("Parallel|Gather")
    able = (F.col("category").isin("scan", "aggregate")) | F.col("kind").isin("HashJoin", "MergeJoin")
    out = nodes.filter(~parallel & able & (rank(worst) >= 3))
    return out.select(n.PLAN, "node_id", F.lit("Parallelization").alias("analyzer"), F.lit("missed").alias("rule"), worst.alias("severity"))


def plan_findings(nodes: DataFrame) -> DataFrame:
    """(plan_id, node_id null or the node meant, analyzer, rule, severity) of the plan-level rules."""
    c = F.col
    costed = n.self_cost(nodes)
    error = F.when(c("actual_rows").isNotNull(), F.greatest(F.greatest(c("est_rows"), F.lit(1)) / F.greatest(c("actual_rows"), F.lit(1)), F.greatest(c("actual_rows"), F.lit(1)) / F.greatest(c("est_rows"), F.lit(1))))
    over = c("est_rows") > c("actual_rows")
    p = costed.withColumn("_e", error).groupBy(n.PLAN).agg(
        F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.count_if(c("category") == "join").alias("joins"), F.count_if(c("kind") == "SubPlan").alias("subplans"),
        F.count_if(c("category") == "aggregate").alias("aggs"), F.max(F.when(c("depth") == 0, c("total_cost"))).alias("root_cost"), F.max(F.struct("self_cost", (-c("node_id")).alias("k"))).alias("top"),
        F.count("_e").alias("measured"), F.count_if(c("_e") >= 2).alias("significant"), F.count_if((c("_e") >= 2) & over).alias("overs"), F.max("_e").alias("worst"),
        (F.sum(F.when(c("_e") >= 2, c("_e"))) / F.count_if(c("_e") >= 2)).alias("avg_ratio"),
    )
    complexity = 10 * c("joins") + 15 * c("subplans") + 5 * c("aggs") + 3 * c("depth") * c("depth")
    dominant = F.greatest(c("overs"), c("significant") - c("overs")) / c("significant")
    rules = [
        ("QueryPattern", "complexity", F.when(complexity > 200, "High").when(complexity > 100, "Medium"), F.lit(None)),
        ("QueryPattern", "depth", F.when(c("depth") > 5, "Medium"), F.lit(None)),
        ("PlanShape", "complex", F.when((c("depth") + 1 >= 12) | (c("nodes") >= 40), "Medium"), F.lit(None)),
        ("PlanShape", "dominant_node", F.when((c("nodes") >= 2) & (c("root_cost") > 1000) & (c("top.self_cost") / c("root_cost") >= 0.7), "Medium"), -c("top.k")),
        ("EstimationHealth", "systematic", F.when((c("measured") >= 4) & (c("significant") >= 2) & (dominant >= 0.8) & (c("avg_ratio") >= 3), F.when(c("avg_ratio") >= 10, "High").otherwise("Medium")), F.lit(None)),
        ("EstimationHealth", "outlier", F.when((c("measured") >= 2) & (c("significant") == 1) & (c("worst") >= 50), "Medium"), F.lit(None)),
    ]
    found = [F.struct(k.cast("int").alias("node_id"), F.lit(a).alias("analyzer"), F.lit(r).alias("rule"), s.alias("severity")) for a, r, s, k in rules]
    return _fired(p, found)


def all_findings(nodes: DataFrame, thresholds: Thresholds, work_mem_kb: int = 4096) -> DataFrame:
    return node_findings(nodes, thresholds, work_mem_kb).unionByName(buffer_findings(nodes)).unionByName(plan_findings(nodes))


def assessment(critical: Column, high: Column, medium: Column) -> Column:
    """Excellent, Good, Fair, Poor or Critical by the counts of severities."""
    return (
        F.when(critical >= 3, "Critical")
        .when((critical >= 1) | (high >= 5), "Poor")
        .when((high >= 2) | (medium >= 5), "Fair")
        .when((high >= 1) | (medium >= 2), "Good")
        .otherwise("Excellent")
    )


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and the assessment of each plan."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = findings.groupBy(n.PLAN).agg(F.count("*").alias("findings"), *[count(s).alias(s.lower()) for s in SEVERITIES], F.max(rank(F.col("severity"))).alias("_m"))
    out = out.withColumn("max_severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_m"))).drop("_m")
    return out.withColumn("assessment", assessment(F.col("critical"), F.col("high"), F.col("medium")))


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k gravest findings of each plan; equals by node, analyzer and rule."""
    w = Window.partitionBy(n.PLAN).orderBy(F.desc(rank(F.col("severity"))), F.asc_nulls_first("node_id"), "analyzer", "rule")
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def insights(findings: DataFrame, k: int = 3) -> DataFrame:
    """(plan, insights): the sentences or names of the k gravest findings of each plan, in order."""
    says = F.col("text") if "text" in findings.columns else F.concat_ws(" ", "analyzer", "rule")
    top = top_findings(findings, k).withColumn("_says", says)
    return top.groupBy(n.PLAN).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_says"))), lambda x: x._says).alias("insights"))
