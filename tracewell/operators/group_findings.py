"""Statement groups with what the plan analyzers find in each group's representative, its slowest execution.

Work follows the dictionary of plans (plans.dictionary): a plan text is parsed once, and a plan tree analysed once, however many
groups and executions share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import DEFAULT as DEFAULT_PREFIX
from ..plans import dictionary
from ..plans.nodes import PLAN
from ..plans.parse import node_table
from ..session import stored
from ..sources import logs
from . import rules
from .config import DEFAULT, Thresholds
from .groups import group_stats

FINDING = ("analyzer", "rule", "severity", "node_id")


def plan_key(plan_text) -> F.Column:
    return F.sha2(plan_text, 256)


def findings_of_texts(plans: DataFrame, thresholds: Thresholds = DEFAULT, work_mem_kb: int = 4096, text: str = "plan_text") -> DataFrame:
    """(plan_key, findings): the findings of each distinct plan text, gravest first; texts that can't be read have none."""
    texts = plans.filter(F.col(text).isNotNull()).select(plan_key(F.col(text)).alias(PLAN), text).dropDuplicates([PLAN])
    nodes = stored(node_table(texts, text, PLAN))  # read by several rules
    found = dictionary.once_each(nodes, lambda n: rules.all_findings(n, thresholds, work_mem_kb))
    order = F.struct((-rules.rank(F.col("severity"))).alias("o"), *FINDING)
    listed = found.groupBy(PLAN).agg(F.array_sort(F.collect_list(order)).alias("f"))
    return listed.select(F.col(PLAN).alias("plan_key"), F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in FINDING])).alias("findings"))


def log_group_findings(lines: DataFrame, log_line_prefix: str = DEFAULT_PREFIX, thresholds: Thresholds = DEFAULT, work_mem_kb: int = 4096, **options) -> DataFrame:
    """logs.log_groups with `findings`, an array of (analyzer, rule, severity, node_id); empty where the representative has no plan or no fault.

    Of equally slow executions the last in parse order represents. Only representatives' plans are parsed.
    """
    found = logs.entries(lines, log_line_prefix, **options)
    stats = group_stats(logs.executions_of(found), ("fingerprint", "normalized_query", "database"), representative=True)
    plans = found.filter("plan_text is not null").select(F.struct("file", "entry").alias("seq"), "plan_text")
    groups = stored(stats.join(plans, "seq", "left").withColumn("plan_key", plan_key(F.col("plan_text"))))
    out = groups.join(findings_of_texts(groups, thresholds, work_mem_kb), "plan_key", "left")
    nothing = F.expr("cast(array() as array<struct<analyzer:string,rule:string,severity:string,node_id:int>>)")
    return out.withColumn("findings", F.coalesce("findings", nothing)).drop("plan_key", "plan_text", "seq")
