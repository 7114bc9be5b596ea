"""Analyzers by name: the default set, user analyzers, runs with failures kept apart.

The default analyzers are rules over one scan of the nodes (and one of the plans), so those that are selected run as one
pass each, whatever their number.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .config import DEFAULT, Thresholds

Analyzer = Callable[[DataFrame], DataFrame]
COLUMNS = ("plan_id", "node_id", "analyzer", "rule", "severity")
NODE_ANALYZERS = ("RowEstimation", "Scan", "Join", "QueryPattern", "StartupCost", "IndexUsage", "SortMemory", "FilterEfficiency", "IndexEfficiency")
PLAN_ANALYZERS = ("QueryPattern", "PlanShape", "EstimationHealth")


@dataclass
class Report:
    """Findings of the analyzers that ran, and what became of each."""

    findings: DataFrame | None
    outcomes: dict[str, str] = field(default_factory=dict)
    seconds: float = 0.0

    def summary(self) -> dict[str, float]:
        count = lambda s: sum(o.startswith(s) for o in self.outcomes.values())
        ran = count("ok") + count("failed")
        return {"succeeded": count("ok"), "failed": count("failed"), "skipped": count("skipped"), "seconds": self.seconds, "efficiency": count("ok") / ran if ran else 0.0}


class Engine:
    """An ordered registry. An analyzer takes the node table and returns findings with COLUMNS."""

    def __init__(self) -> None:
        self.analyzers: dict[str, Analyzer | None] = {}  # None: of the default set
        self.thresholds, self.work_mem_kb = DEFAULT, 4096
        self.own: dict[str, Thresholds] = {}  # of analyzers that have some of their own

    @classmethod
    def default(cls, thresholds: Thresholds = DEFAULT, work_mem_kb: int = 4096) -> Engine:
        out = cls()
        out.thresholds, out.work_mem_kb = thresholds, work_mem_kb
        for name in dict.fromkeys((*NODE_ANALYZERS, *PLAN_ANALYZERS)):
            out.analyzers[name] = None
        out.add("BufferWal", rules.buffer_findings)
        return out

    def add(self, name: str, analyzer: Analyzer) -> None:
        """Adds an analyzer, or replaces the one of this name."""
        self.analyzers[name] = analyzer

    def configure(self, name: str, thresholds: Thresholds | None) -> Thresholds:
        """Gives a default analyzer thresholds of its own (None: the engine's again); returns those it has now."""
        if self.analyzers.get(name, name) is not None or name not in NODE_ANALYZERS:
            raise ValueError(f"no analyzer with thresholds: {name!r}")
        if thresholds is None:
            self.own.pop(name, None)
        else:
            self.own[name] = thresholds
        return self.own.get(name, self.thresholds)

    def _defaults(self, nodes: DataFrame, names: list[str]) -> list[DataFrame]:
        """Findings of default analyzers: one pass over the nodes and one over the plans."""
        of_nodes, of_plans = [n for n in names if n in NODE_ANALYZERS], [n for n in names if n in PLAN_ANALYZERS]
        shared = [x for x in of_nodes if x not in self.own]
        out = [rules.node_findings(nodes, self.thresholds, self.work_mem_kb, tuple(shared))] if shared else []
        out += [rules.node_findings(nodes, self.own[x], self.work_mem_kb, (x,)) for x in of_nodes if x in self.own]
        if of_plans:
            out.append(rules.plan_findings(nodes).filter(F.col("analyzer").isin(of_plans)))
        return [x.select(*COLUMNS) for x in out]

    def run(self, nodes: DataFrame, only: Callable[[str], bool] = lambda _: True) -> Report:
        """Union of the findings of the analyzers that `only` selects; one whose plan can't be built is reported, the others run."""
        began, found = time.time(), []
        report = Report(None)
        chosen = []
        for name in self.analyzers:
            if only(name):
                chosen.append(name)
            else:
                report.outcomes[name] = "skipped"
        defaults = [n for n in chosen if self.analyzers[n] is None]
        for names, run in [(defaults, lambda: self._defaults(nodes, defaults)), *[([n], lambda n=n: [self.analyzers[n](nodes).select(*COLUMNS)]) for n in chosen if self.analyzers[n]]]:
            try:
                found += run()
            except Exception as e:  # a user's analyzer must not stop the others
                report.outcomes |= dict.fromkeys(names, f"failed: {e}")
            else:
                report.outcomes |= dict.fromkeys(names, "ok")
        if found:
            report.findings = reduce(DataFrame.unionByName, found)
        report.seconds = time.time() - began
        return report
