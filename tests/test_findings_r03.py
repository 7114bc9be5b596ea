"""Findings of round 3: each test failed before."""

import duckdb
from pyspark.sql import functions as F

from tracewell.operators import rules
from tracewell.operators.config import DEFAULT
from tracewell.registry import registered
from tracewell.registry.plans import plan_nodes

from .test_queries import SF, rows


def test_settings_that_leave_no_group(spark, tmp_path):
    """All groups have an execution below min_duration_ms: nothing is exported, which is no error."""
    spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.lit(0.001)).write.parquet(f"{tmp_path}/events.parquet")
    query = registered()["q2_24_settings"]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(query.run(spark, str(tmp_path)).toPandas()) == rows(con.sql(query.sql).df())


def test_rules_are_compiled(spark):
    """No lambda goes over the rules, and no filter works them out once more below the generator."""
    plan = rules.node_findings(plan_nodes(spark, SF), DEFAULT)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    assert plan.count("excessive_rows") == 1


def test_ranges_are_as_many_as_the_bytes_need(spark, monkeypatch):
    """Blocks and files of the log grow with it, not in steps of a fixed few bytes."""
    from tracewell.registry import lines

    taken = []
    found = lines.logs.log_groups
    monkeypatch.setattr(lines.logs, "log_groups", lambda both, *a, **k: (taken.append((both.rdd.getNumPartitions(), both.select("file").distinct().count())), found(both, *a, **k))[1])
    monkeypatch.setattr(lines, "FILE_EVENTS", 300, raising=False)
    lines._ranges(spark, "/root/testdata/sf0.01")
    assert taken[0][0] <= 64 + 2 * taken[0][1]
    assert taken[0][1] > 1


def test_exchanges_begin_with_partitions_by_size(spark, monkeypatch):
    """A table's files decide how many partitions its exchanges begin with; the session's number is the least."""
    from tracewell import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(key)
    plan_nodes(spark, SF)
    assert spark.conf.get(key, None) is None
    monkeypatch.setattr(session, "DEALT_BYTES", 1000)
    plan_nodes(spark, SF)
    assert int(spark.conf.get(key)) > 4
    spark.conf.unset(key)


def test_written_logs_have_parts_by_their_events(spark, monkeypatch):
    """A log's lines are dealt to as many parts as its events need, with whole entries in each."""
    from tracewell.registry import lines, sinks

    monkeypatch.setattr(sinks, "FILE_EVENTS", 200)
    dealt = sinks._dealt(lines.log_lines(spark, SF), spark, SF, "file").withColumn("part", F.spark_partition_id())
    assert dealt.select("part").distinct().count() > 4
    assert dealt.groupBy(F.floor(F.col("place") / 10)).agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0
