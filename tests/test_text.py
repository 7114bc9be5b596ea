"""Log lines, prefixes, plans and SQL texts: known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import prefix, sqltext
from tracewell.functions.lines import parse_interval, parse_since
from tracewell.plans.parse import parse_json, parse_text
from tracewell.sources import logs
from tracewell.sources.compressed import CompressedReader, Range
from tracewell.streaming import tail

LOG = """2025-06-12 00:00:16.915 UTC [1] u@shop LOG:  duration: 1242.373 ms  plan:
\tQuery Text: SELECT a
\tFROM t
\tLimit  (cost=0.43..10.00 rows=10 width=8) (actual time=0.1..5.5 rows=1000 loops=1)
\t  ->  Seq Scan on t  (cost=0.00..99.00 rows=500 width=8)
2025-06-12 00:00:18.200 UTC [1] u@shop LOG:  duration: 150.5 ms  plan:
\t{
\t  "Query Text": "SELECT * FROM users WHERE id = 42",
\t  "Plan": {"Node Type": "Seq Scan", "Relation Name": "users", "Startup Cost": 0.0, "Total Cost": 9.0, "Plan Rows": 1, "Plan Width": 4}
\t}
2025-06-12 02:10:00.123 CEST [1] u@[unknown] LOG:  duration: 88.1 ms  plan:
\tQuery Text: UPDATE t SET j = '
\t{"status": "active"}'
\tSeq Scan on t  (cost=0.00..1.00 rows=1 width=8)
2025-06-12 02:10:01 CEST [1] u@shop LOG:  duration: 3.0 ms  plan:
\tQuery Text: SELECT no plan here
"""


def test_entries(spark):
    got = logs.entries(logs.lines_of_text(spark, LOG), "%m [%p] %u@%d ").orderBy("entry").collect()
    assert [(r.ts, r.duration_ms, r.database, r.plan_format) for r in got] == [
        (datetime(2025, 6, 12, 0, 0, 16, 915000), 1242.373, "shop", "text"),
        (datetime(2025, 6, 12, 0, 0, 18, 200000), 150.5, "shop", "json"),
        (datetime(2025, 6, 12, 0, 10, 0, 123000), 88.1, None, "text"),
    ]
    assert got[0].query_text == "SELECT a\nFROM t"
    assert got[1].query_text == "SELECT * FROM users WHERE id = 42"
    assert '{"status": "active"}' in got[2].query_text


def test_files_by_content(spark, tmp_path):
    import bz2
    import gzip

    (tmp_path / "a.log").write_bytes(gzip.compress(LOG.encode()))
    (tmp_path / "b.log").write_bytes(bz2.compress(LOG.encode()))
    (tmp_path / "c.log").write_bytes(LOG.encode())
    assert logs.entries(logs.read_lines_by_content(spark, str(tmp_path)), "%m [%p] %u@%d ").count() == 9
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "d.log").write_bytes(LOG.encode())
    assert logs.entries(logs.read_lines(spark, str(tmp_path / "plain")), "%m [%p] %u@%d ").count() == 3


def test_prefixes():
    assert prefix.parse_prefix("%m [%p] %q%u@%d ").has_database
    assert [f[0] for f in prefix.check_prefix("%u %m")] == ["error"]
    assert [f[1] for f in prefix.check_prefix("%m [%p] ")] == ["prefix_no_database"]
    assert prefix.highest(prefix.check_auto_explain({})) == "warning"
    with pytest.raises(ValueError):
        prefix.parse_prefix("%m %y")


def test_times():
    now = datetime(2025, 1, 8)
    assert parse_since("1w", now) == datetime(2025, 1, 1)
    assert parse_since("2025-01-02") == datetime(2025, 1, 2)
    assert parse_interval("500ms") == 0.5
    for bad in ("1y", "99999999999999w"):
        with pytest.raises(ValueError):
            parse_since(bad, now)


def test_plan_trees():
    nodes = parse_text("Limit  (cost=0.1..1.0 rows=1 width=4)\n  ->  Hash Join  (cost=0.1..1.0 rows=1 width=4)\n        Hash Cond: (a = b)\n        ->  Seq Scan on a  (cost=0..1 rows=1 width=4)\n        ->  Hash  (cost=0..1 rows=1 width=4)\n              Buckets: 1024  Batches: 4  Memory Usage: 9kB\nPlanning Time: 1 ms")
    assert [(n["kind"], n["parent_id"], n["path"]) for n in nodes] == [("Limit", None, []), ("HashJoin", 1, [0]), ("SeqScan", 2, [0, 0]), ("Hash", 2, [0, 1])]
    assert nodes[3]["props"]["Batches"] == "4" and nodes[1]["props"]["Hash Cond"] == "(a = b)"
    assert parse_json('{"Plan": {"Node Type": "Hash Join", "Plans": [{"Node Type": "Bitmap Heap Scan", "Relation Name": "t"}]}}')[1]["kind"] == "BitmapHeapScan"
    for bad in ("", "no node", "Filter: x"):
        with pytest.raises(ValueError):
            parse_text(bad)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("SELECT a FROM t WHERE x IN (1,2,3)", "SELECT a FROM t WHERE x IN (4,5,6,7,8)"),
        ("SELECT a FROM t JOIN u ON t.x = 1", "select a from t join u on t.x = 22"),
        ("SELECT a FROM t ORDER BY a LIMIT 1", "SELECT a FROM t ORDER BY a LIMIT 99"),
        ("INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'b''c')"),
        ("SELECT CASE WHEN a = 1 THEN 'x' END", "SELECT CASE WHEN a = 2 THEN 'y' END"),
        ("DELETE FROM t -- note\n WHERE a = 1", "DELETE FROM t WHERE a = 5"),
    ],
)
def test_same_fingerprint(a, b):
    assert sqltext.normalize(a).fingerprint == sqltext.normalize(b).fingerprint


def test_normal_forms():
    assert sqltext.normalize("SELECT * FROM users WHERE id = 1").fingerprint == "1c00ca4a990103b5"
    x = sqltext.normalize("SELECT 1, 2, 3, 4, 5", max_parameters=3)
    assert x.truncated and not x.successful and len(x.parameters) == 3
    assert [k for k, _ in sqltext.normalize("SELECT * FROM u WHERE id = 123 AND name = 'John' AND active = true").parameters] == ["Number", "String", "Boolean"]
    assert not sqltext.normalize("NOT VALID SQL ;;; @@").successful


def test_boundaries(tmp_path):
    data = LOG.encode()
    cut = tail.boundary(data)
    assert data[cut:].startswith(b"2025-06-12 02:10:01")
    path = tmp_path / "x.log"
    path.write_bytes(data)
    part, at = tail.complete_part(str(path), tail.Offset())
    assert part == data[:cut] and at.position == cut
    rest, end = tail.complete_part(str(path), at, flush=True)
    assert part + rest == data and end.position == len(data)
    path.write_bytes(data[:200])
    assert tail.complete_part(str(path), end, flush=True)[0] == data[:200]
    assert tail.read_budget(3) == 8 * tail.BUDGET


def test_byte_ranges(spark, tmp_path):
    from tracewell.sources import ranges

    ranges.register(spark)
    path = tmp_path / "x.log"
    path.write_bytes(LOG.encode())
    read = lambda **o: spark.read.format("logrange").options(path=str(path), **o).load()
    whole = [r.value for r in read(blockBytes=100).orderBy("place").collect()]
    assert whole == LOG.rstrip("\n").split("\n")
    assert logs.entries(read(blockBytes=64), "%m [%p] %u@%d ").count() == 3
    at = LOG.encode().index(b"2025-06-12 00:00:18")
    assert read(start=at).orderBy("place").first().value.startswith("2025-06-12 00:00:18")


def test_presets():
    from tracewell.operators.config import DEFAULT, for_workload

    assert for_workload() == DEFAULT
    assert for_workload("oltp", "large", "latency").cost[0] == 1000


def test_engine_keeps_failures_apart(spark):
    from tracewell.operators.engine import Engine
    from tracewell.plans.parse import node_table

    engine = Engine.default()
    engine.add("Broken", lambda nodes: 1 / 0)
    plans = spark.createDataFrame([(1, "Seq Scan on t  (cost=0.00..2000000.00 rows=20000000 width=8)")], "plan_id long, plan_text string")
    report = engine.run(node_table(plans, "plan_text", "plan_id"))
    assert report.outcomes["Broken"].startswith("failed") and report.summary()["failed"] == 1
    assert ("Scan", "seq_scan", "Critical") in {(r.analyzer, r.rule, r.severity) for r in report.findings.collect()}


def test_settings():
    from tracewell.operators.config import Settings, parse_threshold

    assert [parse_threshold(x) for x in ("500ms", " 1.5 s ", "0ms")] == [500, 1500, 0]
    for bad in ("5", "x s", "-1s", "inf s", ""):
        with pytest.raises(ValueError):
            parse_threshold(bad)
    assert Settings().validate().retain_days == 7
    for wrong in ({"log_line_prefix": "x"}, {"exclude_query_patterns": ("(",)}, {"include_databases": ("a",)}, {"backends": ()}, {"slow_query_thresholds": ("x",)}, {"histogram_buckets": (2.0, 1.0)}, {"poll_interval": "soon"}):
        with pytest.raises(ValueError):
            Settings(**wrong).validate()


def test_compressed_contents(tmp_path, spark):
    """Any content is inflated in parts; a limit stops it early; damaged files don't keep others from being read."""
    import bz2
    import gzip

    text = ("line of a log " * 5 + "\r\n") * 40_000
    for name, data in (("a", text.encode()), ("b", gzip.compress(text.encode()) + gzip.compress(b"more\n")), ("c", bz2.compress(text.encode())), ("d", gzip.compress(text.encode())[:-400]), ("e", b"")):
        (tmp_path / name).write_bytes(data)
    found = logs.read_lines_by_content(spark, str(tmp_path), errors=True)
    counts = {(r.file.rsplit("/", 1)[1], r.bad): r.n for r in found.groupBy("file", F.col("error").isNotNull().alias("bad")).agg(F.count("*").alias("n")).collect()}
    assert counts[("a", False)] == counts[("c", False)] == 40_000 and counts[("b", False)] == 40_001 and counts[("d", True)] == 1 and ("e", False) not in counts
    assert found.filter("error is null and value is not null").select("value").distinct().count() == 2
    with pytest.raises(ValueError, match="more than 1000000"):
        (tmp_path / "b").write_bytes(gzip.compress(b"x" * 5_000_000))
        list(CompressedReader({"path": str(tmp_path / "b"), "maxBytes": 1_000_000}).read(Range(str(tmp_path / "b"), (tmp_path / "b").stat().st_size, 0, 1 << 20)))


def test_long_entries_are_cut(spark):
    text = "2025-06-12 00:00:18.041 UTC [1] u@d LOG:  duration: 5 ms  plan:\n\tQuery Text: select 1\n\tSeq Scan on t  (cost=0.00..1.00 rows=10 width=8)\n" + "\t  Filter: (x = 1)\n" * 100
    whole, cut = (logs.entries(logs.lines_of_text(spark, text), "%m [%p] %u@%d ", max_entry_bytes=n).first() for n in (0, 400))
    assert len(whole.plan_text) > 1000 > len(cut.plan_text) > 100


def test_backends_keep_failures_apart(spark, tmp_path):
    from tracewell.sources.backends import CompositeBackend, OtlpBackend, TableBackend, TextBackend

    class Broken:
        def write(self, families):
            raise OSError("full")

    families = spark.createDataFrame([("f_total", '{a="x"}', 1.0), ("g", "", 2.0)], "family string, labels string, value double")
    every = CompositeBackend({"text": TextBackend(f"{tmp_path}/t"), "broken": Broken(), "table": TableBackend(f"{tmp_path}/p"), "otlp": OtlpBackend(f"{tmp_path}/o")})
    every.write(families)
    assert every.outcomes == {"text": "ok", "broken": "failed: full", "table": "ok", "otlp": "ok"}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["f_total{a=\"x\"} 1.0", "g 2.0"] and spark.read.parquet(f"{tmp_path}/p").count() == 2
