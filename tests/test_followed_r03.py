"""Findings F5, F8 and F11 of round 3: followed logs are written in pieces and read in chunks that grow with the batch."""

import duckdb

from tracewell.registry import registered, sinks
from tracewell.sources.growing import GrowingReader

from .test_queries import SF, rows


def test_logs_are_written_in_pieces(spark, monkeypatch):
    """No task writes all of a file's part, and the log that the pieces make is the same."""
    monkeypatch.setattr(sinks, "FILE_EVENTS", 200)
    taken, written = [], sinks._written
    monkeypatch.setattr(sinks, "_written", lambda *a: taken.append(written(*a)) or taken[-1])
    query = registered()["q2_17_5_growing_logs"]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert rows(query.run(spark, SF).toPandas()) == rows(con.sql(query.sql).df())
    assert sum(map(len, taken[0].values())) > 14


def test_a_batch_has_not_ever_more_chunks():
    state = {"path": "/x", "size": 8 << 30, "position": 8 << 30}
    found = GrowingReader({"path": "/x", "chunkBytes": "200000"}).partitions({}, {"a": state, "b": {**state, "position": 100_000}})
    assert len(found) <= 260
    assert [c.last for c in found[:-2]] == [c.first for c in found[1:-1]]
    assert (found[0].first, found[-2].last, found[-1].last) == (0, 8 << 30, 100_000)
