"""Exact Jaccard join of documents on word shingles by the size-aware heavy-light method.

Sets of up to `boundary` shingles are light: they enumerate their subsets of each size that a link can leave in
common, and sets that meet in a subset are linked without further comparison. Larger sets are heavy: inverted lists
over the rarest fifth of each set (the prefix that any link must hit) are scanned, pairs pass size and parity-bitmap
bounds, and the rest are verified on the whole sets. The boundary is the one of least estimated cost on the sizes at hand.

Which shingles are rare: every set's lowest hashes are counted over the whole corpus first (COUNTED of the set, more than
a prefix), and shingles in many sets go last in the order that prefixes are cut by.

A parity bitmap has one bit for each residue of the shingles' hashes, the parity of how many fall there. Two bitmaps
differ in no more bits than their sets differ in shingles, so too many different bits rule a link out exactly.

What holds the work down when a large share of the rows are copies:
* equal sets are one class, represented by the smallest id;
* a map task forwards one entry of each list and class it holds;
* lists of more than `full_list` members first link neighbours only; pairs within a linked component are never made.
  What remains between components of such a list is compared in blocks of bounded size (a long list is cut into chunks,
  and each pair of chunks is a block): bitmaps first, then the whole sets of the members that the bitmaps leave. A block
  gives links that span its components, fewer than it has members; candidate pairs never become rows.

Links are never dropped: the result has the components of the complete link graph.

Shingles are 54-bit hashes, so two different ones of a pair of sets are taken for one with a chance of about their number
squared in 2^54; a light subset is known by two 63-bit sums.

Defined results: a null or word-less text has 0 shingles and is its own component; a row without id has a null
component; rows that repeat an id are versions of one document and share its component, and each version's links count;
texts of any length are taken whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, text_slices, trimmed, trimmed_group
from .components import connected_components
from .shingles import SLICE_DOCS, mix, shingle_sets

#: Shingles in at least OFTEN different sets count as frequent. The order holds at most FREQUENT of them, the most
#: frequent ones: that bounds what is broadcast, and only affects speed, never links.
OFTEN, FREQUENT = 24, 1 << 19
COUNTED = 0.3
#: Of a block of two list chunks, and of a bucket of lists.
CHUNK, CHUNK_SHINGLES, BUCKET_SHINGLES = 1000, 1_000_000, 4_000_000
MAX_BOUNDARY = 12
_SIGNED = np.int64
_SECOND, _LOW63 = np.uint64(0x5851F42D4C957F2D), (1 << 63) - 1
#: Packed sets keep the low 7 bytes of a shingle, which hold all its bits.
_PACKED = 7


def _needed(size: int, percent: int) -> int:
    """The least number of shingles that a set of this size shares with any set it links to."""
    return -(-size * percent // 100)


def _set_hash(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)))))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(_SIGNED))
    return out[0], out[1]


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    for first, texts in text_slices(batch.column(1), max_rows=min(1000, SLICE_DOCS)):
        values, bounds = shingle_sets(texts, width)
        yield values, bounds, np.diff(bounds), batch.column(0).slice(first, len(texts))


def _bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bitmaps, of at least two bits a shingle."""
    sizes = np.diff(bounds)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(bits)))
    at = np.repeat(first[:-1], sizes) + (values & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[i >> 3 : j >> 3] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _folded(bitmap: bytes, size: int) -> int:
    """A bitmap cut down to `size` bytes: the upper half is added to the lower one, again and again."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = (int.from_bytes(bitmap[:half], "big") ^ int.from_bytes(bitmap[half:], "big")).to_bytes(half, "big")
    return int.from_bytes(bitmap, "big")


def _may_link(x: bytes, y: bytes, sizes: int, percent: int) -> bool:
    """Whether bitmaps leave a link possible; sizes is the sum of both sets' sizes."""
    n = min(len(x), len(y))
    return (_folded(x, n) ^ _folded(y, n)).bit_count() * (100 + percent) <= (100 - percent) * sizes


def _scan(width: int):
    """Per document its set's size, digests and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, bounds, sizes, ids in _sets_of(batch, width):
                h1, h2 = _set_hash(values, bounds)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(h1), pa.array(h2), pa.array(_bitmaps(values, bounds), pa.binary())], names=["id", "n", "h1", "h2", "bitmap"])

    return run


_SCAN_SCHEMA = "id long, n long, h1 long, h2 long, bitmap binary"


def _low_shingles(width: int, percent: int, least: int, share: float, buckets: int, flush: int = 4_000_000):
    """The lowest shingles of the different sets of each task with their counts, as one block for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def blocks() -> Iterator[pa.RecordBatch]:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            b = (mix(found) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            found, count, b = found[order], count[order].astype(np.uint32), b[order]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b[i]) for i, _ in spans], pa.int32()), pa.array([found[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([count[i:j].tobytes() for i, j in spans], pa.binary())],
                names=["bucket", "found", "times"],
            )

        for batch in batches:
            for values, bounds, sizes, _ in _sets_of(batch, width):
                h1, h2 = _set_hash(values, bounds)
                chosen = sizes >= least
                for i in np.flatnonzero(chosen):
                    key = (int(h1[i]), int(h2[i]))
                    if key in seen:
                        chosen[i] = False
                    elif len(seen) < 1_000_000:
                        seen.add(key)
                take = np.where(chosen, np.ceil(sizes * share).astype(np.int64) + 1, 0)
                place = np.arange(len(values)) - np.repeat(bounds[:-1], sizes)
                low = values[place < np.repeat(np.minimum(take, sizes), sizes)]
                held.append(low)
                n += len(low)
                if n >= flush:
                    yield from blocks()
                    held, n = [], 0
        if n:
            yield from blocks()

    return run


def _frequent(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    found = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["found"]])
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["times"]]).astype(np.int64)
    order = np.argsort(found, kind="stable")
    found, times = found[order], times[order]
    cut = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.empty(0, np.int64)
    total = np.add.reduceat(times, cut) if len(cut) else np.empty(0, np.int64)
    often = total >= OFTEN
    return pd.DataFrame({"token": found[cut][often].astype(np.int64), "w": total[often]})


def _subsets(width: int, percent: int, boundary: int):
    """(two subset digests, its size, set size, id) of the light sets of each slice; equal sets of a slice count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, bounds, sizes, ids in _sets_of(batch, width):
                keys, checks, common, own, who, seen = [], [], [], [], [], set()
                ids = ids.to_pylist()
                for i in np.flatnonzero((sizes > 0) & (sizes <= boundary)):
                    part = values[bounds[i] : bounds[i + 1]]
                    if (ids[i], part.tobytes()) in seen or ids[i] is None:
                        continue
                    seen.add((ids[i], part.tobytes()))
                    # one sum of both digests of each shingle, 96 bits apart, so that sums of the lower ones don't reach the upper
                    mixed = [int(x) | int(y) << 96 for x, y in zip(mix(part), mix(part ^ _SECOND), strict=True)]
                    for c in range(_needed(len(mixed), percent), len(mixed) + 1):
                        for chosen in combinations(mixed, c):
                            both = sum(chosen)
                            keys.append(both & _LOW63)
                            checks.append(both >> 96 & _LOW63)
                            common.append(c)
                            own.append(len(mixed))
                            who.append(ids[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(common, pa.int32()), pa.array(own, pa.int32()), pa.array(who, pa.int64())],
                    names=["key", "check", "c", "size", "id"],
                )

    return run


_ENTRY = np.dtype([("token", "<u8"), ("at", "<u4")])
_OWNER = np.dtype([("id", "<i8"), ("set", "<i8"), ("size", "<u4")])


def _prefixes(width: int, percent: int, least: int, frequent: np.ndarray, weight: np.ndarray, buckets: int, flush: int = 2_000_000):
    """Prefix entries of the sets of at least `least` shingles, as one block for each bucket of shingles, and the links of
    neighbours in lists that a task alone holds several members of are left to the bucket: a task forwards all its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, docs, held = [], [], [], 0
        seen: set[tuple[int, int, int]] = set()

        def blocks() -> Iterator[pa.RecordBatch]:
            t, o = np.concatenate(tokens), np.concatenate(owners)
            d = np.concatenate(docs)
            b = (mix(t) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            t, o, b = t[order], o[order], b[order]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            names, entries, tables = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                mine, at = np.unique(o[lo:hi], return_inverse=True)
                e = np.empty(hi - lo, _ENTRY)
                e["token"], e["at"] = t[lo:hi], at
                names.append(int(b[lo]))
                entries.append(e.tobytes())
                tables.append(d[mine].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(entries, pa.binary()), pa.array(tables, pa.binary())], names=["bucket", "entries", "owners"])

        for batch in batches:
            for values, bounds, sizes, ids in _sets_of(batch, width):
                h1, h2 = _set_hash(values, bounds)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                chosen = known & (sizes >= least)
                for i in np.flatnonzero(chosen):
                    key = (int(h1[i]), int(h2[i]), int(sizes[i]))
                    if key in seen:
                        chosen[i] = False
                    elif len(seen) < 1_000_000:
                        seen.add(key)
                if not chosen.any():
                    continue
                mask = np.repeat(chosen, sizes)
                v, own = values[mask], np.repeat(np.arange(len(sizes)), sizes)[mask]
                rank = np.zeros(len(v), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)
                    rank = np.where(frequent[at] == v, weight[at], 0)
                # rare ones keep the order of their hashes, as they come; the frequent go behind them by weight
                order = np.arange(len(v))
                late = np.flatnonzero(rank)
                if len(late):
                    moved = late[np.lexsort((v[late], rank[late], own[late]))]
                    early = np.flatnonzero(rank == 0)
                    merged = np.concatenate((early, moved))
                    order = merged[np.argsort(own[merged], kind="stable")]
                start = np.concatenate(([0], np.cumsum(np.where(chosen, sizes, 0))))
                length = np.where(chosen, sizes - -(-sizes * percent // 100) + 1, 0)
                place = np.arange(len(v)) - np.repeat(start[:-1], np.where(chosen, sizes, 0))
                take = order[place < np.repeat(length, np.where(chosen, sizes, 0))]
                picked = np.flatnonzero(chosen)
                local = np.zeros(len(sizes), np.int64)
                base = sum(map(len, docs))
                local[picked] = base + np.arange(len(picked))
                table = np.empty(len(picked), _OWNER)
                table["id"], table["set"], table["size"] = number[picked], h1[picked], sizes[picked]
                docs.append(table)
                tokens.append(v[take])
                owners.append(local[own[take]])
                held += len(take)
                if held >= flush:
                    yield from blocks()
                    tokens, owners, docs, held = [], [], [], 0
        if held:
            yield from blocks()

    return run


def _pairs(percent: int, full_list: int):
    """Candidate pairs of one bucket. Of longer lists: neighbours in an order of the list's own, and the members themselves."""

    def run(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        entries = [np.frombuffer(x, _ENTRY) for x in frame["entries"]]
        owners = [np.frombuffer(x, _OWNER) for x in frame["owners"]]
        base = np.concatenate(([0], np.cumsum([len(x) for x in owners])))
        token = np.concatenate([x["token"] for x in entries])
        at = np.concatenate([x["at"].astype(np.int64) + b for x, b in zip(entries, base[:-1], strict=True)])
        docs = np.concatenate(owners)
        _, kind = np.unique(docs["set"], return_inverse=True)
        order = np.lexsort((docs["id"][at], kind[at], token))
        token, at = token[order], at[order]
        keep = np.ones(len(token), bool)  # of a class that several tasks forwarded, one entry
        keep[1:] = (token[1:] != token[:-1]) | (kind[at[1:]] != kind[at[:-1]])
        token, at = token[keep], at[keep]
        cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        n = np.diff(cut)
        left, right, long_token, long_at = [], [], [], []
        for k in np.unique(n[n >= 2]):
            begins = cut[:-1][n == k]
            members = at[begins[:, None] + np.arange(k)]
            if k <= full_list:
                i, j = np.triu_indices(int(k), 1)
            else:
                shuffled = np.argsort(mix(docs["id"][members].view(np.uint64) ^ token[begins][:, None]), axis=1)
                members = np.take_along_axis(members, shuffled, axis=1)
                i, j = np.arange(k - 1), np.arange(1, k)
                long_token.append(np.repeat(token[begins], k))
                long_at.append(members.ravel())
            left.append(members[:, i].ravel())
            right.append(members[:, j].ravel())
        out = []
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            small, large = np.minimum(docs["size"][a], docs["size"][b]).astype(np.int64), np.maximum(docs["size"][a], docs["size"][b]).astype(np.int64)
            ok = small * 100 >= large * percent
            a, b = a[ok], b[ok]
            turn = docs["id"][a] > docs["id"][b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            pairs = np.unique(np.stack((docs["id"][a], docs["set"][a], docs["id"][b], docs["set"][b]), 1), axis=0) if len(a) else np.empty((0, 4), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 2]]
            out.append(pd.DataFrame({"a": pairs[:, 0], "sa": pairs[:, 1], "b": pairs[:, 2], "sb": pairs[:, 3], "token": np.int64(-1), "size": np.int64(0)}))
        if long_token:
            t, w = np.concatenate(long_token), np.concatenate(long_at)
            out.append(pd.DataFrame({"a": docs["id"][w], "sa": docs["set"][w], "b": np.int64(-1), "sb": np.int64(0), "token": t.astype(np.int64), "size": docs["size"][w].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "sa", "b", "sb", "token", "size")})

    return run


def _bodies(width: int):
    """The packed set of each text with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, bounds, _, ids in _sets_of(batch, width):
                h1, h2 = _set_hash(values, bounds)
                packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PACKED].tobytes()
                cuts = (bounds * _PACKED).tolist()
                body = pa.array([packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(h1), pa.array(h2), body], names=["id", "h1", "h2", "body"])

    return run


def _unpacked(bodies: list[bytes]) -> np.ndarray:
    """The shingles of packed sets, one set after the other."""
    raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, _PACKED)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_PACKED] = raw
    return out.view("<u8").ravel()


def _in_common(one: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets that follow one another in `others` (none is empty) shares with the sorted set `one`."""
    hit = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def _verify(percent: int):
    """Keeps the pairs whose whole sets link; a pair comes with both packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = _unpacked([x.as_py()]), _unpacked([y.as_py()])
                both = int(_in_common(x, y, np.array([len(y)]))[0])
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _boundary(scan: DataFrame, percent: int, list_cost: float = 8.0) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, over the sizes of these sets."""
    rows = scan.filter(F.col("n").between(1, MAX_BOUNDARY)).groupBy("n").count().collect()
    gain, best, total = 0.0, 0, 0.0
    sizes = {r["n"]: r["count"] for r in rows}
    for s in range(1, MAX_BOUNDARY + 1):
        light = sum(math.comb(s, c) for c in range(_needed(s, percent), s + 1))
        heavy = (s - _needed(s, percent) + 1) * list_cost
        total += sizes.get(s, 0) * (heavy - light)
        if total > gain:
            gain, best = total, s
    return best


def _near(bitmap: list[bytes], size: np.ndarray, part: np.ndarray, own: np.ndarray, apart_only: bool, percent: int) -> np.ndarray:
    """Which members of a block have a partner in another component that neither size nor bitmap excludes; members come by size."""
    near = np.zeros(len(size), bool)
    width = np.fromiter(map(len, bitmap), np.int64, len(bitmap))
    # sets that can link differ by at most a quarter in size, so their bitmaps have the same or neighbouring widths
    for w in np.unique(width):
        x = np.flatnonzero(width == w)
        bits_x = np.frombuffer(b"".join([bitmap[i] for i in x]), np.uint64).reshape(len(x), -1)
        for w2 in (w, 2 * w):
            y = np.flatnonzero(width == w2)
            if not len(y):
                continue
            bits_y = np.frombuffer(b"".join([bitmap[i] for i in y]), np.uint64).reshape(len(y), -1)
            if w2 != w:
                half = bits_y.shape[1] // 2
                bits_y = bits_y[:, :half] ^ bits_y[:, half:]
            for lo in range(0, len(x), 64):
                r = x[lo : lo + 64]
                ok = part[r][:, None] != part[y][None, :]
                small, large = np.minimum(size[r][:, None], size[y][None, :]), np.maximum(size[r][:, None], size[y][None, :])
                ok &= small * 100 >= large * percent
                if w2 == w:
                    ok &= r[:, None] < y[None, :]
                if apart_only:
                    ok &= own[r][:, None] != own[y][None, :]
                p, q = np.nonzero(ok)
                for at in range(0, len(p), 1 << 16):
                    pp, qq = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                    apart = np.bitwise_count(bits_x[lo + pp] ^ bits_y[qq]).sum(1, dtype=np.int64)
                    keep = apart * (100 + percent) <= (100 - percent) * (size[r[pp]] + size[y[qq]])
                    near[r[pp[keep]]] = True
                    near[y[qq[keep]]] = True
    return near


_BLOCK = ["token", "i", "j"]
_MEMBER = [*_BLOCK, "chunk", "id", "h1", "size", "part"]
_MEMBER_SCHEMA = "token long, i long, j long, chunk long, id long, h1 long, size long, part long"


def _cross(percent: int):
    """The members of one bucket of blocks (pairs of list chunks) that may link to another component: at most one row for each member."""

    def run(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), group in frame.groupby(_BLOCK, sort=False):
            group = group.sort_values("size")
            near = _near(list(group["bitmap"]), *(group[c].to_numpy() for c in ("size", "part", "chunk")), i != j, percent)
            if near.any():
                out.append(group.loc[near, _MEMBER])
        return pd.concat(out) if out else frame.iloc[:0][_MEMBER]

    return run


def spanning_links(bodies: list[bytes], part: np.ndarray, own: np.ndarray, apart_only: bool, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components (`part`), verified on whole sets, that join all components which links of the block join.

    Members come by size. A member is compared with the later ones that aren't in its component yet, so a block of n
    members gives at most n - 1 links, and copies of one text cost one comparison each.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // _PACKED
    values, first = _unpacked(bodies), np.cumsum(sizes) - sizes
    part = np.unique(part, return_inverse=True)[1]
    bitmaps = _bitmaps(values, np.append(first, len(values)))
    width = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    place, bits = np.empty(len(width), np.int64), {}
    for w in np.unique(width).tolist():
        own_width = np.flatnonzero(width == w)
        place[own_width] = np.arange(len(own_width))
        bits[w, w] = np.frombuffer(b"".join([bitmaps[i] for i in own_width]), np.uint64).reshape(len(own_width), -1)
        half = bits[w, w].shape[1] // 2
        if half:
            bits[w // 2, w] = bits[w, w][:, :half] ^ bits[w, w][:, half:]

    def possible(r: int, y: np.ndarray) -> np.ndarray:
        """Those of `y` that the bitmaps leave; sets that can link have bitmaps of the same or of neighbouring widths."""
        w, kept = int(width[r]), []
        for w2 in (w, 2 * w):
            z = y[width[y] == w2]
            if len(z):
                apart = np.bitwise_count(bits[w, w][place[r]] ^ bits[w, w2][place[z]]).sum(1, dtype=np.int64)
                kept.append(z[apart * (100 + percent) <= (100 - percent) * (sizes[r] + sizes[z])])
        return np.concatenate(kept) if kept else y[:0]

    out = []
    for r in range(len(sizes) - 1):
        # sizes rise, so those that can link to this one end where they exceed it too far
        end = int(np.searchsorted(sizes, sizes[r] * 100 // percent, side="right"))
        y = np.arange(r + 1, end)
        y = y[part[y] != part[r]]
        if apart_only:
            y = y[own[y] != own[r]]
        y = possible(r, y)
        for lo in range(0, len(y), 256):
            some = y[lo : lo + 256]
            some = some[part[some] != part[r]]
            if not len(some):
                continue
            others = values[np.repeat(first[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())]
            both = _in_common(values[first[r] : first[r] + sizes[r]], others, sizes[some])
            for k in some[100 * both >= percent * (sizes[r] + sizes[some] - both)]:
                if part[k] != part[r]:
                    out.append((r, int(k)))
                    part[part == part[k]] = part[r]
    return out


def _linked(percent: int):
    """The spanning links of one bucket of blocks, whose members come with their packed sets."""

    def run(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = [], []
        for (_, i, j), group in frame.groupby(_BLOCK, sort=False):
            group = group.sort_values("size")
            ids = group["id"].to_numpy()
            for x, y in spanning_links(list(group["body"]), group["part"].to_numpy(), group["chunk"].to_numpy(), i != j, percent):
                left.append(ids[x])
                right.append(ids[y])
        return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    return run


def _possible(percent: int):
    @F.arrow_udf("boolean")
    def possible(x: pa.Array, y: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([_may_link(a, b, n, percent) for a, b, n in zip(x.to_pylist(), y.to_pylist(), sizes.to_pylist(), strict=True)], pa.bool_())

    return possible


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, full_list: int = 16) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): each row's set (id, n, h1, h2), and links between representatives that span every component of the link graph."""
    spark = docs.sparkSession
    pairs_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = materialize(pairs_in.mapInArrow(trimmed(_scan(width)), _SCAN_SCHEMA), "sets")
    boundary = _boundary(sets, percent)
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions_for(spark), -(-int(shingles) // BUCKET_SHINGLES))
    # light sets large enough to link to a heavy one are listed too
    least = max(1, _needed(boundary + 1, percent))
    low = pairs_in.mapInArrow(trimmed(_low_shingles(width, percent, least, COUNTED, buckets)), "bucket int, found binary, times binary")
    top = low.groupBy("bucket").applyInPandas(trimmed_group(_frequent), "token long, w long").orderBy(F.desc("w"), "token").limit(FREQUENT).toPandas()
    top["token"] = top["token"].astype(np.int64).astype(np.uint64)
    top = top.sort_values("token")
    frequent, weight = top["token"].to_numpy(), top["w"].to_numpy(np.int64)

    edges = []
    if boundary:
        subsets = materialize(pairs_in.mapInArrow(trimmed(_subsets(width, percent, boundary)), "key long, check long, c int, size int, id long"), "subsets")
        hubs = subsets.groupBy("key", "check", "c").agg(F.min(F.struct("size", "id")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
        edges.append(
            subsets.hint("merge").join(hubs, ["key", "check", "c"])
            .filter(f"id <> hub.id and 100 * c >= {percent} * (size + hub.size - c)")
            .select(F.col("id").alias("a"), F.col("hub.id").alias("b"))
        )
    blocks = pairs_in.mapInArrow(trimmed(_prefixes(width, percent, least, frequent, weight, buckets)), "bucket int, entries binary, owners binary")
    found = materialize(blocks.groupBy("bucket").applyInPandas(trimmed_group(_pairs(percent, full_list)), "a long, sa long, b long, sb long, token long, size long"), "pairs")
    # several versions of one id are told apart by their sets' digests
    shapes = sets.filter("n > 0").select("id", "h1", "n", "bitmap").dropDuplicates(["id", "h1"])
    first = found.filter("token = -1").select("a", "sa", "b", "sb").distinct()
    # tables that grow with the corpus are never broadcast, however small they are here: hence the hints
    first = first.hint("merge").join(shapes.select(F.col("id").alias("a"), F.col("h1").alias("sa"), F.col("n").alias("na"), F.col("bitmap").alias("xa")), ["a", "sa"])
    first = first.hint("merge").join(shapes.select(F.col("id").alias("b"), F.col("h1").alias("sb"), F.col("n").alias("nb"), F.col("bitmap").alias("xb")), ["b", "sb"])
    first = materialize(first.filter(_possible(percent)("xa", "xb", F.col("na") + F.col("nb"))).select("a", "sa", "b", "sb"), "candidates")
    long_lists = materialize(found.filter("token <> -1").select("token", F.col("a").alias("id"), F.col("sa").alias("h1"), "size").distinct(), "lists")

    def bodies(wanted: DataFrame) -> DataFrame:
        """The packed sets of (id, h1)."""
        ids = wanted.select("id").distinct()
        whole = pairs_in.join(ids.hint("merge"), "id", "left_semi").mapInArrow(trimmed(_bodies(width)), "id long, h1 long, h2 long, body binary")
        return whole.join(wanted.distinct().hint("merge"), ["id", "h1"], "left_semi").dropDuplicates(["id", "h1"]).drop("h2")

    ends = first.select(F.col("a").alias("id"), F.col("sa").alias("h1")).unionByName(first.select(F.col("b").alias("id"), F.col("sb").alias("h1")))
    own = materialize(bodies(ends), "bodies")
    both = first.hint("merge").join(own.select(F.col("id").alias("a"), F.col("h1").alias("sa"), F.col("body").alias("xa")), ["a", "sa"])
    both = both.hint("merge").join(own.select(F.col("id").alias("b"), F.col("h1").alias("sb"), F.col("body").alias("xb")), ["b", "sb"])
    edges.append(materialize(both.select("a", "b", "xa", "xb").mapInArrow(trimmed(_verify(percent)), "a long, b long"), "links"))
    if long_lists.take(1):
        known = edges[0]
        for e in edges[1:]:
            known = known.unionByName(e)
        edges.append(_across(sets, shapes, long_lists, known, bodies, percent, buckets))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return sets.drop("bitmap"), out


def _across(sets: DataFrame, shapes: DataFrame, lists: DataFrame, known: DataFrame, bodies: Callable[[DataFrame], DataFrame], percent: int, buckets: int) -> DataFrame:
    """Links between members of a list that the known links leave in different components.

    A list is cut into chunks of bounded rows and shingles; a pair of chunks is a block. A first pass over the bitmaps keeps
    the members with a possible partner in another component; their sets are then compared within the block, which gives links
    that span what the block's members have in common: fewer than members, never all pairs.
    """
    parts = connected_components(known.unionByName(_same_sets(sets)), "a", "b")
    placed = lists.hint("merge").join(parts, lists.id == parts.node, "left").select("token", "id", "h1", "size", F.coalesce("component", "id").alias("part"))
    member = F.xxhash64("id", "h1")
    mixed = placed.groupBy("token").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m"), F.sum("size").alias("total"),
        F.bit_xor(member).alias("x"), F.sum(member.cast("decimal(38,0)")).alias("y"),
    )
    # of lists with the same members, one is enough
    mixed = mixed.filter("lo < hi").groupBy("m", "x", "y").agg(F.min("token").alias("token"), F.first("total").alias("total"))
    mixed = mixed.select("token", F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES)).alias("chunks"))
    placed = placed.hint("merge").join(mixed, "token").hint("merge").join(shapes.select("id", "h1", "bitmap"), ["id", "h1"])
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id", "h1"), F.col("chunks")))
    dealt = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("token", F.least("k", "chunk").alias("i"), F.greatest("k", "chunk").alias("j"), "chunk", "id", "h1", "size", "part", "bitmap")
    bucket = F.pmod(F.xxhash64(*_BLOCK), F.lit(4 * buckets))
    near = materialize(dealt.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(trimmed_group(_cross(percent)), _MEMBER_SCHEMA), "near")
    whole = materialize(bodies(near.select("id", "h1")), "bodies")
    with_sets = near.hint("merge").join(whole, ["id", "h1"]).withColumn("bucket", bucket)
    return materialize(with_sets.groupBy("bucket").applyInPandas(trimmed_group(_linked(percent)), "a long, b long"), "links")


def _same_sets(sets: DataFrame) -> DataFrame:
    """Each id of a class of equal sets with the smallest id of the class."""
    hubs = sets.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("b"), F.count("*").alias("members")).filter("members > 1").drop("members")
    return sets.hint("merge").join(hubs, ["n", "h1", "h2"]).filter("id <> b").select(F.col("id").alias("a"), "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, full_list: int = 16) -> DataFrame:
    """(id, n_shingles, component_id) of every row; see the module's text for the method and the defined results."""
    sets, edges = links(docs, id_col, text_col, width, percent, full_list)
    parts = connected_components(edges.unionByName(_same_sets(sets)), "a", "b")
    return sets.hint("merge").join(parts, sets.id == parts.node, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
