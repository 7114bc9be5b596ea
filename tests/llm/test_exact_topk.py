"""Exact search against brute force: repeated ids, mixed lengths, large components, pruning of blocks and ranges."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_topk


def brute(rows, scale, k=5, every=50):
    """(query row, rank, vec_id, score) by comparing every query row with every other row."""
    good = [(i, [int(x) for x in np.floor(scale * np.array(v, float))]) for i, v in rows if i is not None and v and None not in v and (np.abs(np.floor(scale * np.array(v, float))) < 2.0**63).all()]
    out = []
    for a, (i, x) in enumerate(good):
        if i % every == 0:
            scores = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(x, y, strict=True)))), j) for b, (j, y) in enumerate(good) if a != b and len(x) == len(y))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return Counter(out)


def found(spark, rows, scale, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(parts)
    return Counter(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, scale=scale).collect())


def test_hard_rows(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 3)]) for i in range(120)] + [(120 + i, [1.0, 1.0, 1.0]) for i in range(300)]
    rows += [(500, None), (501, [1.0, None, 2.0]), (502, [float("nan"), 1.0, 1.0]), (503, []), (None, [1.0, 1.0, 1.0]), (550, [float("inf"), 0.0, 0.0])]
    rows += [(50, [2.0, 2.0, 2.0])] * 3 + [(600, [1.0]), (601, [2.0]), (650, [3.0, 4.0])]
    assert found(spark, rows, 2.0) == brute(rows, 2.0)


def test_repeated_id_is_a_candidate(spark):
    rows = [(50, [1.0, 0.0]), (50, [3.0, 0.0]), (7, [2.0, 0.0])]
    assert found(spark, rows, 1.0, 1) == Counter({(50, 1, 50, 3): 1, (50, 2, 7, 2): 1, (50, 1, 7, 6): 1, (50, 2, 50, 3): 1})


@pytest.mark.parametrize("size", [1e8, 1e12, 3e16])
def test_large_components(spark, size):
    """Products beyond doubles, beyond longs, and components near the end of a long."""
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 4) * size]) for i in range(150)] + [(200, [1e300, 0.0, 0.0, 0.0])]
    assert found(spark, rows, 256.0) == brute(rows, 256.0)


def test_ranges_are_pruned(spark, monkeypatch):
    """Vectors in clusters along the table: queries reach few ranges, and results stay exact; with bounds left out too."""
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(exact_topk, "RANGE_BLOCKS", 4)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(16)[i * 16 // 2000] * 5 + rnd.normal(0, 0.05, 16)]) for i in range(2000)]
    sent = []
    real = exact_topk._packets
    monkeypatch.setattr(exact_topk, "_packets", lambda ranges, s: sent.append((s is not None, ranges)) or real(ranges, s))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    want = brute(rows, 256.0)
    assert Counter(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == want
    monkeypatch.setattr(exact_topk, "SUMMARY_BYTES", 0)
    monkeypatch.setattr(exact_topk, "PARTITIONS", 0)
    assert Counter(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == want
    assert [s[0] for s in sent] == [True, False] and sent[0][1] > 20


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score aren't scored."""
    rows = [np.full((4, 2), v, np.int64) for v in range(20)]
    blocks = [(4 * i, np.arange(4) + 4 * i, r, r.max(0), r.min(0)) for i, r in enumerate(rows)]
    best, scored = exact_topk.search_range(np.array([1000]), np.array([[1, 1]]), np.array([-(1 << 62)]), blocks, 3)
    assert best[0][1].tolist() == [38, 38, 38] and best[0][0].tolist() == [76, 77, 78] and scored == 1


def test_empty(spark):
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
