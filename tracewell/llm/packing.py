"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest. Pieces are packed longest first.
A piece goes to the open bin with the least room that still holds it; if none does, a new bin is opened, of the size
with the least cost for each token it can still come to hold (the piece and the shorter pieces left). In the end each
bin shrinks to the smallest permitted length that holds its contents. Packings are made under several policies (every
choice of up to POLICY sizes that may be opened, if they hold the longest piece), and the one of least total cost is kept: the
lengths are optimised jointly. A further permitted length adds policies and takes none away, so it never makes a packing dearer.

At scale pieces are dealt evenly over shards by a round-robin exchange of (id, length) rows, a shard being packed in one task
whose size is fixed by `shard_pieces`; with tens of thousands of pieces a shard wastes next to nothing.

The length of a text is its number of UTF-8 bytes (the tokens of a byte-level model) plus one separator, unless a
length column is named. Defined results: null lengths and texts count as empty, and an empty text still takes its separator;
a length below 1 counts as 1; rows that repeat an id or have none are packed each; documents of any length are cut into pieces;
of equal lengths the smaller id goes first, of bins with equal room the last opened, of equal costs the larger size, and of
packings of equal cost the one with more sizes; an empty table gives none; other columns are ignored. Which rows share a
shard follows the input's partitions, so bins may differ between layouts of one table, their costs hardly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
SHARD_PIECES = 50_000
POLICY = 5
_SCHEMA = "id long, piece int, begin long, length int, bin long, bin_capacity int, bin_offset int"


def attention_cost(capacity: int) -> float:
    """Cost of a sequence: linear layers, and attention that grows with the square of the length."""
    return capacity * (1 + capacity / 131072)


def _pack(lengths: list[int], sizes: list[int], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Bin of each piece (given longest first), and each bin's capacity when opened."""
    remaining = sum(lengths)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    bins, opened, room = [], [], []
    costs = [(c, cost(c)) for c in sizes]
    for n in lengths:
        remaining -= n
        fitting = rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                rooms ^= 1 << r
        else:
            c = min((x for x in costs if x[0] >= n), key=lambda x: (x[1] / min(x[0], n + remaining), -x[0]))[0]
            b, r = len(opened), c
            opened.append(c)
            room.append(c)
        r -= n
        room[b] = r
        if r:
            if not rooms >> r & 1:
                rooms |= 1 << r
                by_room[r] = []
            by_room[r].append(b)
        bins.append(b)
    return bins, opened


def _policies(sizes: list[int], longest: int) -> list[tuple[int, ...]]:
    """Which sizes may be opened: every choice of up to POLICY sizes that holds the longest piece, choices of more sizes first."""
    return [x for k in range(min(POLICY, len(sizes)), 0, -1) for x in combinations(sizes, k) if x[-1] >= longest]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost) -> tuple[list[int], list[int], float]:
    """(bin of each length, final capacity of each bin, total cost); no length may exceed the largest capacity, and a larger one may not cost less."""
    sizes = sorted(set(capacities))
    if not lengths:
        return [], [], 0.0
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ordered = [lengths[i] for i in order]
    if ordered[0] > sizes[-1]:
        raise ValueError("a piece is longer than the largest capacity")
    best = None
    for opened_sizes in _policies(sizes, ordered[0]):
        bins, opened = _pack(ordered, list(opened_sizes), cost)
        load = np.bincount(bins, weights=ordered, minlength=len(opened)).astype(np.int64)
        final = np.array(sizes)[np.searchsorted(sizes, load)]
        total = float(sum(cost(int(c)) * int(k) for c, k in zip(*np.unique(final, return_counts=True), strict=True)))
        if best is None or total < best[2]:
            best = (bins, final.tolist(), total)
    out = [0] * len(lengths)
    for i, b in zip(order, best[0], strict=True):
        out[i] = b
    return out, best[1], best[2]


def _shard(capacities: tuple[int, ...], cost: Callable[[int], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shard = got[0].column("shard")[0].as_py()
        table = pa.Table.from_batches(got)
        ids, total = table.column("id").to_pylist(), table.column("n").to_numpy()
        order = np.lexsort((total, [-1 if i is None else i for i in ids]))
        most = max(capacities)
        who, piece, begin, length = [], [], [], []
        for i in order:
            for k, at in enumerate(range(0, int(total[i]), most)):
                who.append(ids[i])
                piece.append(k)
                begin.append(at)
                length.append(min(most, int(total[i]) - at))
        bins, final, _ = pack(length, capacities, cost)
        used = np.zeros(len(final), np.int64)
        offset = []
        for b, n in zip(bins, length, strict=True):
            offset.append(int(used[b]))
            used[b] += n
        columns = [pa.array(who, pa.int64()), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int32()), pa.array([shard << 32 | b for b in bins], pa.int64()), pa.array([final[b] for b in bins], pa.int32()), pa.array(offset, pa.int32())]
        whole = pa.RecordBatch.from_arrays(columns, names=["id", "piece", "begin", "length", "bin", "bin_capacity", "bin_offset"])
        for lo in range(0, whole.num_rows, 50_000):
            yield whole.slice(lo, 50_000)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: (id, piece, begin, length, bin, bin_capacity, bin_offset); begin is the piece's place in its document."""
    n = F.coalesce(F.col(length_col).cast("long"), F.lit(0)) if length_col else F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(n, F.lit(1)).alias("n"))
    most = max(capacities)
    count = rows.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_pieces))
    # round-robin over rows sorted by their hash: repeated rows spread, and a retried task deals alike
    dealt = rows.repartition(shards).withColumn("shard", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(trimmed(_shard(tuple(capacities), cost)), _SCHEMA).withColumnRenamed("id", id_col)
