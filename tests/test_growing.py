"""Logs that grow between batches: cut anywhere, renamed, replaced, truncated; resumed and replayed."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import state as st
from tracewell.sources import growing
from tracewell.streaming import assembly, commits, tail


def entry(k, ms=None, name="a"):
    return f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}.000 UTC [1] u@{name} LOG:  duration: {ms or k + 1}.5 ms  plan:\n\tQuery Text: select {k}\n\tfrom t\n\tSeq Scan on t  (cost=0.00..1.00 rows=10 width=8)\n"


PREFIX = "%m [%p] %u@%d "


def append(path, data):
    with open(path, "ab") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def follow(spark, base, flush=False, checkpoint="c", **options):
    tail.follow_logs(spark, f"{base}/log", f"{base}/store", f"{base}/{checkpoint}", PREFIX, flush=flush, **options).awaitTermination()
    states = commits.states_of(spark, f"{base}/store")
    return {} if states is None else sums(states)


def sums(states):
    return {r[0]: (r[1], float(r[2])) for r in states.groupBy("database").agg(F.sum("calls"), F.sum("total_ms")).collect()}


def want(entries):
    out = {}
    for k, name in entries:
        n, t = out.get(name, (0, 0.0))
        out[name] = (n + 1, t + k + 1.5)
    return out


def test_entries_cut_anywhere_come_once_and_whole(spark, tmp_path):
    (tmp_path / "log").mkdir()
    text = "no entry\n\tnothing\n" + "".join(entry(k) for k in range(12))
    data, rnd = text.encode(), random.Random(1)
    cuts = sorted(rnd.sample(range(1, len(data)), 4))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        append(tmp_path / "log/a.log", data[a:b])
        got = follow(spark, tmp_path, flush=k == len(cuts), chunk_bytes=150)
    assert got == want([(k, "a") for k in range(12)])


def test_rename_replace_truncate(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    append(log / "a.log", entry(0) + entry(1)[:60])
    assert follow(spark, tmp_path) == {}  # the first entry may still go on
    append(log / "a.log", entry(1)[60:] + entry(2))
    (log / "a.log").rename(log / "a.log.1")
    append(log / "a.log", entry(3) + entry(4))  # another file of the same name
    append(log / "b.log", entry(5, name="b") + entry(6, name="b"))
    assert follow(spark, tmp_path) == want([(0, "a"), (1, "a"), (3, "a"), (5, "b")])
    (log / "b.log").write_text(entry(7, name="b"))  # truncated and written anew
    got = follow(spark, tmp_path, flush=True)
    assert got == want([(k, "a") for k in range(5)] + [(5, "b"), (6, "b"), (7, "b")])  # what the truncated file left open is complete
    assert follow(spark, tmp_path, flush=True) == got  # nothing new


def test_a_new_checkpoint_goes_on_where_the_store_is(spark, tmp_path):
    (tmp_path / "log").mkdir()
    append(tmp_path / "log/a.log", entry(0) + entry(1) + entry(2))
    assert follow(spark, tmp_path) == want([(0, "a"), (1, "a")])
    files = commits.files_of(spark, f"{tmp_path}/store").collect()
    assert [f.position for f in files] == [len(entry(0) + entry(1))]  # the open entry's begin
    append(tmp_path / "log/a.log", entry(3))
    assert follow(spark, tmp_path, checkpoint="other", flush=True) == want([(k, "a") for k in range(4)])


def test_commits(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = lambda *ms: st.state_rows(spark.createDataFrame([("f", "d", m, None, k) for k, m in enumerate(ms)], "fingerprint string, database string, duration_ms double, ts timestamp_ntz, seq long"))
    at = lambda name, position: spark.createDataFrame([(name, f"/{name}", position, 1, 2, 9, None)], commits.FILES)
    calls = lambda: (s := commits.states_of(spark, store)) and [r.calls for r in s.collect()]
    places = lambda: {r.id: r.position for r in commits.files_of(spark, store).collect()}
    assert commits.states_of(spark, store) is None and places() == {} and not commits.compact(spark, store)
    assert commits.fold(spark, store, "q/0", rows(1.0, 2.0), at("a", 5))
    assert not commits.fold(spark, store, "q/0", rows(9.0), at("a", 7))  # replayed
    assert calls() == [2] and places() == {"a": 5}
    # a failure between the data and the commit leaves nothing visible; the replay counts once
    rows(3.0).write.parquet(f"{store}/data/00ff/states")
    at("a", 8).write.parquet(f"{store}/data/00ff/files")
    assert calls() == [2] and places() == {"a": 5}
    assert commits.fold(spark, store, "q/1", rows(3.0), at("a", 8)) and commits.fold(spark, store, "q/2", rows(4.0), at("b", 1))
    assert calls() == [4] and places() == {"a": 8, "b": 1}
    assert commits.compact(spark, store) and calls() == [4] and places() == {"a": 8, "b": 1}
    assert commits.vacuum(spark, store) == 4 and calls() == [4] and places() == {"a": 8, "b": 1}
    commits.reset(spark, store)
    assert commits.states_of(spark, store) is None and places() == {"a": 8, "b": 1}
    assert commits.fold(spark, store, "q/3", rows(5.0), at("b", 2)) and calls() == [1] and places() == {"a": 8, "b": 2}
    commits.reset(spark, store, files=True)
    assert commits.states_of(spark, store) is None and places() == {}


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_chunks_share_out_the_lines(tmp_path, size):
    data = b"x\n\n" + "ünï\n".encode() * 9 + b"2024-01-01 00:00:00 UTC LOG: y\n" * 5 + b"last without end"
    path = str(tmp_path / "f")
    append(path, data)
    lines = []
    for a in range(0, len(data), size):
        chunk = growing.Chunk("i", path, 0, len(data), a, min(a + size, len(data)), None, False)
        lines += growing.lines_between(chunk)
    places = [0]
    for line in data.split(b"\n")[:-1]:
        places.append(places[-1] + len(line) + 1)
    assert lines == list(zip(places, data.split(b"\n"), strict=True))


def test_listing(tmp_path):
    for name in ("a.log", "b.txt", ".hidden.log", "sub"):
        (tmp_path / name).mkdir() if name == "sub" else append(tmp_path / name, "x")
    append(tmp_path / "sub/c.log", "x")
    (tmp_path / "link.log").symlink_to(tmp_path / "a.log")
    names = lambda p: [f.path.removeprefix(str(tmp_path)) for f in growing.listed(p)]
    assert names(f"{tmp_path}/*.log") == ["/a.log", "/sub/c.log"]
    assert names(str(tmp_path)) == ["/a.log", "/b.txt", "/sub/c.log"]
    assert names(f"{tmp_path}/missing*") == [] and names(f"{tmp_path}/missing") == []


def test_pieces_are_a_streaming_table(spark, tmp_path):
    append(tmp_path / "a.log", entry(0))
    df = assembly.assembled_stream(assembly.growing_pieces(spark, str(tmp_path)))
    assert df.isStreaming and {"file", "entry", "l", "id", "position"} <= set(df.columns)
