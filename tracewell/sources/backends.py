"""Places that metric families go to. A backend takes (family, labels, value) rows; any class with `write` is one."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .export import exposition


class MetricsBackend(Protocol):
    def write(self, families: DataFrame) -> None: ...


@dataclass
class TextBackend:
    """Lines of the text exposition format, in a folder."""

    path: str

    def write(self, families: DataFrame) -> None:
        exposition(families).write.mode("overwrite").text(self.path)


@dataclass
class TableBackend:
    """A Parquet table by family."""

    path: str

    def write(self, families: DataFrame) -> None:
        families.write.mode("overwrite").partitionBy("family").parquet(self.path)


def otlp_points(families: DataFrame) -> DataFrame:
    """Each row as a metric of the OpenTelemetry JSON encoding, with its labels as attributes: one `json` a row."""
    pairs = F.regexp_extract_all("labels", F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), 1)
    attributes = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.struct(F.regexp_extract(p, r'="(.*)"$', 1).alias("stringValue")).alias("value")))
    point = F.struct(attributes.alias("attributes"), F.col("value").alias("asDouble"))
    counter = F.col("family").rlike("_(total|count|sum|bucket)$")
    monotonic = F.when(counter, F.struct(F.array(point).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")))
    return families.select(F.to_json(F.struct(F.col("family").alias("name"), monotonic.alias("sum"), F.when(~counter, F.struct(F.array(point).alias("dataPoints"))).alias("gauge"))).alias("json"))


@dataclass
class OtlpBackend:
    """OpenTelemetry metrics as JSON lines, for a collector's file receiver."""

    path: str

    def write(self, families: DataFrame) -> None:
        otlp_points(families).write.mode("overwrite").text(self.path)


@dataclass
class CompositeBackend:
    """Several backends; one that fails doesn't keep the others from theirs, and is reported in `outcomes`."""

    backends: dict[str, MetricsBackend]
    outcomes: dict[str, str] = field(default_factory=dict)

    def write(self, families: DataFrame) -> None:
        for name, backend in self.backends.items():
            try:
                backend.write(families)
                self.outcomes[name] = "ok"
            except Exception as e:  # the others go on
                self.outcomes[name] = f"failed: {e}"
