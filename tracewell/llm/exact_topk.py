"""Exact top-k inner-product search with block-at-a-time pruning.

Rows are cut into blocks of a few hundred in the order they are stored, and consecutive blocks make a range. A block keeps,
for every component (term), its largest and least value, and a forward index: the rows' components as one matrix. For a
query, the sum over components of the larger of (weight x largest, weight x least) bounds every score in the block. A query
takes the blocks of a range in decreasing order of their bounds, scores whole blocks through the forward index, and
stops when the bound falls below its k-th score so far. It starts from a floor: the k-th score within the query's own block.

What is exchanged: each range once, and each query once for every range whose bound reaches the query's floor; the ranges'
bounds are known before anything moves. A task reads a range and then the queries, as they stream past it, so its memory is
that of one range and one packet of queries, whatever the table holds. The results of the ranges, k a query, are merged.

Components x become floor(scale * x), x as double. Scores are exact: in doubles where these hold all sums, else in 64-bit
integers, else in integers of any size; a score that a long can't hold becomes the nearest long.

Defined results: rows whose vector or id is null, or whose vector is empty or holds a component that is null, non-finite or
beyond a long after scaling, take no part, nor do pairs of different lengths. Rows that repeat an id are candidates each, and
queries each, with ranks of their own; a query row excludes only itself. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

BLOCK_ROWS, RANGE_BLOCKS, PACKET_QUERIES = 256, 256, 512
#: Bounds of ranges are sent to the tasks up to so many bytes; beyond that, queries go to all ranges.
SUMMARY_BYTES = 32 << 20
#: Offsets of partitions are broadcast up to so many, and joined by exchange beyond.
PARTITIONS = 1 << 18
_NONE = -(1 << 63)  # below every score
_MOST = (1 << 63) - 1


def _matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, is query, integer components) of the usable rows, for each vector length."""
    vectors = batch.column(1)
    lens = np.fromiter((len(v.values) if v.is_valid else 0 for v in vectors), np.int64, len(vectors))
    ok = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    for n in np.unique(lens[ok & (lens > 0)]):
        rows = np.flatnonzero(ok & (lens == n))
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), n)
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(scale * flat)
        good = (np.abs(values) < 2.0**63).all(1)  # nulls read as NaN
        rows, values = rows[good], values[good]
        yield np.array([ids[i] for i in rows], np.int64), np.array([bool(wanted[i]) for i in rows], bool), values.astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Integers as 4 bytes each where all fit, else as 8."""
    return values.astype(np.int32 if len(values) == 0 or np.abs(values).max() < 1 << 31 and values.min() > -(1 << 31) else np.int64).tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * width else np.int64).reshape(rows, width).astype(np.int64)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products; of long integers where they surely hold them, else of Python's."""
    most = _largest(queries) * _largest(rows) * queries.shape[1]
    if most < 1 << 53:
        return np.rint(queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T if most < 1 << 61 else queries.astype(object) @ rows.T.astype(object)


def _as_long(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == np.int64 else np.clip(scores, _NONE + 1, _MOST).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x blocks) of the scores within each block, from the blocks' component maxima and minima."""
    return _as_long(_products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low))


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; less than any score where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _NONE)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _blocks(scale: float, k: int):
    """Blocks with their maxima and minima; query rows come with the floor that their own block gives. `part` and `place` number the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                for ids, wanted, values in _matrices(batch.slice(lo, BLOCK_ROWS), scale):
                    if not len(ids):
                        continue
                    own = _as_long(_products(values[wanted], values))
                    at = np.flatnonzero(wanted)
                    own[np.arange(len(at)), at] = _NONE
                    row = {
                        "part": part, "place": place, "width": values.shape[1], "ids": ids.tobytes(), "rows": _packed(values), "high": values.max(0).tobytes(), "low": values.min(0).tobytes(),
                        "q_at": at.tobytes(), "q_ids": ids[wanted].tobytes(), "q_rows": _packed(values[wanted]), "q_floor": _kth(own, k).tobytes(),
                    }
                    place += 1
                    yield pa.RecordBatch.from_pylist([row], _BLOCK_TYPE)

    return run


_BLOCK_TYPE = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "high", "low", "q_at", "q_ids", "q_rows", "q_floor")]])
_BLOCK_SCHEMA = "part long, place long, width int, ids binary, rows binary, high binary, low binary, q_at binary, q_ids binary, q_rows binary, q_floor binary"


def search_range(
    own: np.ndarray, queries: np.ndarray, floor: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query its best (ids, scores) within the blocks (number of the first row, ids, rows, high, low), and how many query-blocks were scored.

    `own` is the number of the query's own row, which is no candidate.
    """
    n = len(queries)
    bound = bounds(queries, np.stack([b[3] for b in blocks]), np.stack([b[4] for b in blocks]))
    order = np.argsort(bound, axis=1, kind="stable")[:, ::-1]
    floor = floor.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
    scored = 0
    for step in range(len(blocks)):
        at = order[:, step]
        # bounds only fall from here on, so a query that stops has finished; a block that can tie still counts
        go = np.flatnonzero(bound[np.arange(n), at] >= floor)
        if not len(go):
            break
        for b in np.unique(at[go]):
            who = go[at[go] == b]
            first, ids, rows = blocks[b][:3]
            scores = _as_long(_products(queries[who], rows))
            scored += len(who)
            mine = np.flatnonzero((own[who] >= first) & (own[who] < first + len(ids)))
            scores[mine, own[who[mine]] - first] = _NONE
            reach = np.maximum(floor[who], _NONE + 1)
            for j in np.flatnonzero(scores.max(1) >= reach):
                i, s = who[j], scores[j]
                keep = np.flatnonzero(s >= reach[j])
                a, c = np.concatenate((best[i][0], ids[keep])), np.concatenate((best[i][1], s[keep]))
                top = np.lexsort((a, ~c))[:k]
                best[i] = (a[top], c[top])
                if len(top) == k:
                    floor[i] = max(floor[i], c[top[-1]])
    return best, scored


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a batch of them can be large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _packets(ranges: int, summary: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None):
    """Packets of queries for each range that may hold a result of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int) -> Iterator[pa.RecordBatch]:
            own, ids, rows, floor = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            if summary is None:
                numbers, reach = np.arange(ranges), np.ones((len(ids), ranges), bool)
            else:
                numbers, high, low = summary[width]
                reach = bounds(rows, high, low) >= floor[:, None]
            for r in np.flatnonzero(reach.any(0)):
                x = reach[:, r]
                row = {"r": int(numbers[r]), "first": -1, "width": width, "ids": ids[x].tobytes(), "rows": _packed(rows[x]), "high": own[x].tobytes(), "low": floor[x].tobytes()}
                yield pa.RecordBatch.from_pylist([row], _SEARCH_TYPE)

        for b in _rows(batches):
            ids = np.frombuffer(b["q_ids"], np.int64)
            own = b["number"] * BLOCK_ROWS + np.frombuffer(b["q_at"], np.int64)
            w = b["width"]
            held.setdefault(w, []).append((own, ids, _unpacked(b["q_rows"], len(ids), w), np.frombuffer(b["q_floor"], np.int64)))
            if sum(len(x[0]) for x in held[w]) >= PACKET_QUERIES:
                yield from out(w)
        for w in list(held):
            yield from out(w)

    return run


#: Rows of the search: blocks (first >= 0, the number of their first row) and packets, whose own rows and floors are in high and low.
_SEARCH_SCHEMA = "r long, first long, width int, ids binary, rows binary, high binary, low binary"
_SEARCH_TYPE = pa.schema([("r", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "high", "low")]])


def _search(k: int):
    """Each range's blocks, then the packets of queries that come to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, {}
        for row in _rows(batches):
            if row["r"] != now:
                now, blocks = row["r"], {}
            w, ids = row["width"], np.frombuffer(row["ids"], np.int64)
            rows = _unpacked(row["rows"], len(ids), w)
            high, low = np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64)
            if row["first"] >= 0:
                blocks.setdefault(w, []).append((row["first"], ids, rows, high, low))
            elif w in blocks:
                best, _ = search_range(high, rows, low, blocks[w], k)
                n = [len(b[0]) for b in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(high, n)), pa.array(np.repeat(ids, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))],
                    names=["own", "query_id", "vec_id", "score"],
                )

    return run


def _extremes(_key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    high, low = (np.stack([np.frombuffer(x, np.int64) for x in blocks[c]]) for c in ("high", "low"))
    return pd.DataFrame({"r": [blocks["r"].iloc[0]], "width": [blocks["width"].iloc[0]], "high": [high.max(0).tobytes()], "low": [low.min(0).tobytes()]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row, the row itself excepted."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    blocks = materialize(rows.mapInArrow(trimmed(_blocks(scale, k)), _BLOCK_SCHEMA), "blocks")
    # blocks are numbered through by the counts of the partitions before theirs: one row a partition comes to the driver
    counts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.max("place") + 1).collect())
    offsets, total = {}, 0
    for part, n in counts:
        offsets[part] = total
        total += n
    tasks = spark.sparkContext.defaultParallelism
    per = max(1, min(RANGE_BLOCKS, -(-total // (4 * tasks))))
    ranges = -(-total // per)
    table = spark.createDataFrame(list(offsets.items()) or [(-1, 0)], "part long, offset long")
    table = F.broadcast(table) if len(offsets) <= PARTITIONS else table.hint("merge")
    numbered = blocks.join(table, "part").withColumn("number", F.col("offset") + F.col("place"))
    numbered = numbered.withColumn("r", F.floor(F.col("number") / per).cast("long"))
    widths = [r[0] for r in blocks.select("width").distinct().limit(2).collect()]
    summary = None
    if len(widths) == 1 and ranges * widths[0] * 16 <= SUMMARY_BYTES:
        found = numbered.select("r", "width", "high", "low").groupBy("r", "width").applyInPandas(_extremes, "r long, width int, high binary, low binary").orderBy("r").collect()
        matrix = lambda c: np.stack([np.frombuffer(x[c], np.int64) for x in found])
        summary = {widths[0]: (np.array([x["r"] for x in found]), matrix("high"), matrix("low"))}
    queries = numbered.filter(F.octet_length("q_ids") > 0).select("number", "width", "q_at", "q_ids", "q_rows", "q_floor")
    packets = queries.mapInArrow(_packets(ranges, summary), _SEARCH_SCHEMA)
    index = numbered.select("r", (F.col("number") * BLOCK_ROWS).alias("first"), "width", "ids", "rows", "high", "low")
    dealt = index.unionByName(packets).repartition(max(1, min(ranges, 100_000)), "r").sortWithinPartitions("r", F.desc("first"))
    found = dealt.mapInArrow(trimmed(_search(k)), "own long, query_id long, vec_id long, score long")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
