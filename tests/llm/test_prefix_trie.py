"""The trie against one built by walking every rebuilt conversation."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tracewell.llm import common, entry, prefix_trie

SF = "/root/testdata/sf0.001"
TYPES = {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words(p)
    for p in members:
        if not children[p]:
            for d in range(len(p) + 1):
                leaves[p[:d]] += 1
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def hard_conversations(seed=1, n=90):
    rnd = random.Random(seed)
    say = ["hi there", "hi there", "yes", "no \t\n\x1c x", "", None, "ünï cödé z", "  "]
    rows = []
    for c in [*range(n), -7, -20, -25, 1003]:
        if c % 20 == 0 and rnd.random() < 0.4:
            continue
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([turn, turn, None]), rnd.choice(["user", None, "user"]), rnd.choice(say)))
        if rnd.random() < 0.2:
            rows.append(rows[-1])
    rows += [(None, 1, "user", "x"), (300, 2, "user", "long " * 50_000), (301, 2, "user", "long " * 50_000)]
    rows += [(401, t, "user", "same") for t in range(70)] + [(402, t, "user", "same") for t in range(70)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "'x' as name", "2 as depth", "3 as n").repartition(5)
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **kw).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 5)
        monkeypatch.setattr(common, "HOT_KEYS", 30)
        monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = hard_conversations(2 if hot else 1, 40 if hot else 90)
    assert run(spark, rows) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_many_ends_at_one_node(spark, monkeypatch):
    rows = [(c, 0, "user", "a") for c in range(9, 9 + 400)]
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    assert run(spark, rows) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_pieces_that_meet(spark):
    """Batches and ranges may cut a node's ids anywhere; the digest is that of the whole list."""
    ids = list(range(3, 5000, 3))
    ends = spark.createDataFrame([(1, c) for c in ids] + [(2, 10)], "node long, conv long").repartition(6)
    got = dict(prefix_trie.end_digests(ends).collect())
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"10").hexdigest()}


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_query(spark):
    df = entry.queries()["op13_prefix_trie"](spark, SF)
    assert dict(df.dtypes) == TYPES
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == sorted(brute_trie(rows), key=lambda r: r[:2])
