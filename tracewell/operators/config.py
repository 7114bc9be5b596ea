"""Thresholds of the analyzers, from a workload's kind, size and target."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from ..functions.lines import parse_interval
from ..functions.prefix import parse_prefix

# Medium thresholds of rows, cost and duration (ms) by workload, and the factors of size and target.
_BASES = {"oltp": (10_000.0, 1_000.0, 100.0), "olap": (1_000_000.0, 100_000.0, 10_000.0), "analytics": (500_000.0, 50_000.0, 5_000.0), "mixed": (100_000.0, 10_000.0, 1_000.0)}
_SIZES = {"small": 0.1, "medium": 1.0, "large": 10.0, "very_large": 100.0}
_TARGETS = {"latency": 0.1, "throughput": 2.0, "balanced": 1.0, "efficiency": 5.0}


@dataclass(frozen=True)
class Thresholds:
    """(medium, high, critical) of estimated rows, total cost and duration in ms."""

    rows: tuple[float, float, float] = (100_000, 1_000_000, 10_000_000)
    cost: tuple[float, float, float] = (10_000, 100_000, 1_000_000)
    duration_ms: tuple[float, float, float] = (1_000, 10_000, 100_000)


def for_workload(workload: str = "mixed", size: str = "medium", target: str = "balanced") -> Thresholds:
    """Thresholds of a workload; high and critical are 10 and 100 times medium."""
    rows, cost, duration = _BASES[workload]
    steps = lambda base: (base, base * 10, base * 100)
    return Thresholds(steps(rows * _SIZES[size]), steps(cost * _SIZES[size] * _TARGETS[target]), steps(duration * _TARGETS[target]))


DEFAULT = Thresholds()
PRESETS = {"oltp": for_workload("oltp", "large", "latency"), "warehouse": for_workload("olap", "very_large", "throughput"), "development": for_workload("mixed", "small", "balanced")}


def regression_thresholds(workload: str = "mixed") -> tuple[float, float, float, float, int]:
    """Minor, significant and critical change in percent, significance level, and points the statistical engine needs."""
    # Fixed values.
    return {"oltp": (5.0, 15.0, 30.0, 0.05, 20), "olap": (15.0, 35.0, 70.0, 0.01, 50), "analytics": (20.0, 40.0, 80.0, 0.01, 50), "mixed": (10.0, 25.0, 50.0, 0.05, 30)}[workload]


def parse_threshold(text: str) -> float:
    """Milliseconds of 500ms or 1s; finite and not negative."""
    m = re.fullmatch(r"\s*(.*?)\s*(ms|s)\s*", text)
    try:
        value = float(m[1]) * (1 if m[2] == "ms" else 1000)
    except (TypeError, ValueError):
        raise ValueError(f"no threshold: {text!r}") from None
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"no threshold: {text!r}")
    return value


@dataclass(frozen=True)
class Settings:
    """What a run is set up with; `validate` raises on what can't work, streaming.service acts on it. The defaults are fixed values."""

    poll_interval: str = "30s"
    log_line_prefix: str = "%m [%p] "
    slow_query_thresholds: tuple[str, ...] = ("1s", "5s", "10s", "30s")
    histogram_buckets: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)
    include_databases: tuple[str, ...] = ()
    exclude_databases: tuple[str, ...] = ()
    exclude_query_patterns: tuple[str, ...] = ()
    min_duration_ms: float | None = None
    backends: tuple[str, ...] = ("text",)
    retain_days: int = 7
    max_query_cardinality: int = 10_000
    max_read_bytes_per_cycle: int = 64 << 20
    max_entry_bytes: int = 256 << 20
    max_line_bytes: int = 64 << 20
    sample_rate: float = 0.8
    slo_threshold_ms: float = 0.0

    def validate(self) -> Settings:
        parse_interval(self.poll_interval)
        for text in self.slow_query_thresholds:
            parse_threshold(text)
        prefix = parse_prefix(self.log_line_prefix)
        for pattern in self.exclude_query_patterns:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"no pattern: {pattern!r}: {e}") from e
        if (self.include_databases or self.exclude_databases) and not prefix.has_database:
            raise ValueError("a filter by database needs %d in the prefix")
        if not self.backends:
            raise ValueError("no backend: nothing would be exported")
        if list(self.histogram_buckets) != sorted(set(self.histogram_buckets)):
            raise ValueError("histogram buckets must rise")
        return self
