"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Task: remove every byte covered by a string of `length` bytes that also starts at another position (of the same text or
of any other), judged on the input.

Which suffixes are sorted. A full suffix array of a corpus costs many times its size to exchange, so the sort is made
communication-efficient as in distributed string sorting with distinguishing prefixes (Bingmann, Sanders, Schimek 2020):

1. Every window of `length` bytes owns one anchor: the position of its smallest `gram`-byte hash. The choice depends on
   the window's content alone, so equal windows have anchors at equal offsets. About one byte in 120 is an anchor.
2. Anchors whose gram occurs once can't lie in a repeat; a count over gram hashes drops them.
3. For the rest, a map task sorts the suffixes from the anchors (as far as a window reaches), merges equal ones, and
   sends each bucket of grams a sorted run, front-coded: each suffix as the length it shares with its predecessor and
   the remaining bytes. The bytes before the anchor that its windows reach go along.
4. A bucket merges its runs with a loser tree that keeps, for each head, the length shared with the last winner: heads
   of different such lengths are ordered without looking at bytes, equal ones are compared from there on. The merge
   yields the common prefixes of all neighbours, and with them the groups that agree on the next n bytes for every n.
5. A window that starts m bytes before its anchor repeats if another suffix of its group for length - m bytes has the
   same m bytes before it. The windows of an anchor overlap, so those that repeat cover one stretch of bytes.

Buckets take grams by hash, not by alphabetical range: suffixes that agree on a gram always meet, and common beginnings
don't make a bucket large.

What holds a bucket down when one passage is in a large share of the texts: a task that has a context (the bytes its windows
reach) more than once knows that all its windows repeat, marks its places itself, and forwards the context once, without
places. Contexts of a gram with more than `hot` anchors are cut into bands of distances before the anchor (0, 1, 2-3, 4-7, ...).
Windows of a band see no bytes beyond it, so contexts that agree within the band are one; and those that repeat each other
share the bytes up to the band's begin, so the band is dealt to buckets by these.

Passages of words. With `words`, every passage of so many words that also starts at another position goes as well, however
short its words are. A word is that of shingles.py (ASCII letters folded, any white space between), written as WORD_BYTES
bytes of its hash; a text is then a string of these, with `words` * WORD_BYTES bytes to a window, and takes the same way as
its bytes. Stretches found are cut to whole words and take the white space behind them. Both kinds are judged on the input.

Rows are told apart by id and a 64-bit hash of the text. Equal rows share one list of anchors and of stretches, so copies cost
in proportion to their number. The number of buckets follows the number of anchors, so that a bucket fits a task.

Defined results: null texts count as empty; rows that repeat an id and a text are two texts (so they repeat each other);
rows of one id and different texts are separate, also where the id is null; texts of any length are scanned in slices; other
columns stay unless named like a result, which replaces them; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions_for, release, text_slices, trimmed, trimmed_group
from .shingles import _POWERS, _SPACE, mix, words

LENGTH, GRAM = 400, 100
HOT = 20_000
WORD_BYTES = 3
BUCKET_ANCHORS = 40_000
SCAN_BYTES = 4 << 20  # of a text scanned at once
_PLACE_BITS = 28  # of a position in a slice; the other bits of the order of anchors are the gram's hash
_ANCHOR_SCHEMA = "d long, t long, h long, at long"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, position, least and greatest distance from a window's start) of the anchors of each text; a few MB in one call."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not (lens >= length).any():
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = _gram_hashes(data, gram)
    order = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_min(order, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    windows = np.maximum(lens - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(owner)) + np.repeat(ends - lens - (np.cumsum(windows) - windows), windows)
    at = least[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    at, owner, lo, hi = at[new], owner[new], at[new] - start[last], at[new] - start[new]
    keep = _thinned(data, at, owner, h[at], lo, hi, length, gram)
    at, owner, lo, hi = at[keep], owner[keep], lo[keep], hi[keep]
    return owner, h[at].view(np.int64), at - (ends - lens)[owner], lo, hi


def _thinned(data: np.ndarray, at: np.ndarray, owner: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchors to keep: all but most of those inside a periodic stretch, where every period has one.

    Anchors of one gram at equal distances of at most a gram bound a stretch with that period. Its inner anchors, all of whose
    windows lie within it, have equal windows: one in every half length of them covers the same bytes, and any window that
    equals theirs, here or in another text, still meets one that is kept.
    """
    keep = np.ones(len(at), bool)
    if len(at) * 16 < len(data):  # not dense
        return keep
    step = np.diff(at)
    alike = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1]) & (step <= gram)
    ends = np.flatnonzero(~alike | np.concatenate(([False], step[1:] != step[:-1])))
    first = np.concatenate(([0], ends + 1))
    # a change of distance ends a run at the anchor that the next one begins with
    for a, b in zip(first.tolist(), np.append(ends, len(at) - 1).tolist(), strict=True):
        if b - a < 8 or not alike[a]:
            continue
        p, begin, end = int(step[a]), int(at[a]), int(at[b]) + gram
        if end - begin < 4 * length or not np.array_equal(data[begin : end - p], data[begin + p : end]):
            continue
        inner = a + np.flatnonzero((at[a : b + 1] - hi[a : b + 1] >= begin) & (at[a : b + 1] - lo[a : b + 1] + length <= end))
        every = max(1, length // 2 // p)
        if len(inner) > 4 * every:
            keep[inner[every:-every]] = False
            keep[inner[every:-every:every]] = True
    return keep


def all_anchors_of(texts: list[bytes], length: int, gram: int, scan: int = SCAN_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors_of for texts of any length: long ones are scanned in slices, each with the windows that begin in it.

    The choice of a window's anchor doesn't depend on the slice; an anchor of windows in two slices comes from both.
    """
    if sum(map(len, texts)) <= 2 * scan:
        yield anchors_of(texts, length, gram)
        return
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 1), scan):
            owner, h, pos, lo, hi = anchors_of([text[at : at + scan + length - 1]], length, gram)
            yield owner + i, h, pos + at, lo, hi


def word_codes(texts: list[bytes], scan: int = SCAN_BYTES) -> list[bytes]:
    """Each text as WORD_BYTES bytes for each of its words; long texts are coded in slices that end between words."""
    if sum(map(len, texts)) > 2 * scan:
        return [b"".join(word_codes([part], len(part))[0] for part in _between_words(text, scan)) for text in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1) - 1
    hashes, counts = words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), ends - lens, ends)
    codes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
    cuts = np.concatenate(([0], np.cumsum(counts) * WORD_BYTES)).tolist()
    return [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_WHITE = re.compile(rb"[\t-\r ]")


def _between_words(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut at white space only."""
    at = 0
    while at < len(text):
        m = _WHITE.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def word_stretches(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a text's word codes as stretches of its bytes: the whole words among them and the white space behind each stretch."""
    inside = ~_SPACE[np.frombuffer(text, np.uint8)]
    cuts = np.append(np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))), len(text))
    cuts[0] = 0
    first, last = -(-begins // WORD_BYTES), ends // WORD_BYTES
    return cuts[first[last > first]], cuts[last[last > first]]


def _anchors(sizes: list[tuple[int, int]]):
    """The anchors of texts as bytes and, with a second (length, gram), as word codes; then the hash's last bit says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in text_slices(batch.column(2)):
                for kind, (length, gram) in enumerate(sizes):
                    for owner, h, pos, lo, hi in all_anchors_of(word_codes(texts) if kind else texts, length, gram):
                        if len(sizes) > 1:
                            h = h & ~1 | kind
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(d[first + owner]), pa.array(t[first + owner]), pa.array(h), pa.array(pos << 20 | lo << 10 | hi)], names=["d", "t", "h", "at"]
                        )

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which agree on the first `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


_ZSTD = pa.Codec("zstd", compression_level=6)
_HEAD = np.dtype([("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("many", "<u1")])
_PLACE = np.dtype([("d", "<i8"), ("t", "<i8"), ("pos", "<u4")])
_STRETCH = np.dtype([("d", "<i8"), ("t", "<i8"), ("begin", "<i4"), ("end", "<i4")])


def encode_run(contexts: dict[tuple[bytes, bytes], list[tuple[int, int, int]]]) -> bytes:
    """A front-coded sorted run: keys are (suffix, bytes before it, reversed), values the places. Several places are only marked."""
    keys = sorted(contexts)
    head = np.empty(len(keys), _HEAD)
    before, rests = b"", []
    for i, (right, left) in enumerate(keys):
        k = common_prefix(before, right)
        head[i] = (k, len(right) - k, len(left), len(contexts[right, left]) > 1)
        rests.append(right[k:])
        before = right
    places = np.array([contexts[key][0] for key in keys if len(contexts[key]) == 1], dtype=_PLACE)
    body = head.tobytes() + b"".join(rests) + b"".join(left for _, left in keys) + places.tobytes()
    return len(keys).to_bytes(4, "little") + len(body).to_bytes(4, "little") + _ZSTD.compress(body, asbytes=True)


class Run:
    """A decoded run: suffixes, shared prefix with the one before, bytes before, and the place of those that have a single one."""

    def __init__(self, blob: bytes) -> None:
        n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
        body = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
        head = np.frombuffer(body, _HEAD, n)
        at = head.nbytes
        self.lcps = head["lcp"].tolist()
        self.rights, before = [], b""
        for k, rest in zip(self.lcps, head["rest"].tolist(), strict=True):
            before = before[:k] + body[at : at + rest]
            self.rights.append(before)
            at += rest
        self.lefts = []
        for k in head["left"].tolist():
            self.lefts.append(body[at : at + k])
            at += k
        self.many = head["many"] > 0
        self.places = np.frombuffer(body, _PLACE, offset=at)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs (strings, prefix shared with the one before) with a loser tree.

    Returns run, index in it, and prefix shared with the one before, of each string in sorted order. A loser keeps the
    length of the prefix it shares with the winner that beat it; bytes known to be equal are not compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * k
    shared = [0] * k  # of each run's head, with the last winner that passed its node
    strings: list[list[bytes]] = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps: list[list[int]] = [r[1] for r in runs] + [[]] * (k - len(runs))
    done = [not s for s in strings]

    def beats(x: int, y: int) -> bool:
        """Whether x's head comes before y's; leaves the loser's shared length set."""
        if done[y]:
            return True
        if done[x]:
            return False
        sx, sy = shared[x], shared[y]
        if sx != sy:
            return sx > sy
        a, b = strings[x][heads[x]], strings[y][heads[y]]
        n = common_prefix(a, b, sx)
        x_first = a[n : n + 1] < b[n : n + 1] or (a[n : n + 1] == b[n : n + 1] and x < y)
        if x_first:
            shared[y] = n
        else:
            shared[x] = n
        return x_first

    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        if beats(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    out_run, out_index, out_lcp = [], [], []
    winner = play(1) if runs else 0
    while runs and not done[winner]:
        out_run.append(winner)
        out_index.append(heads[winner])
        out_lcp.append(shared[winner])
        heads[winner] += 1
        if heads[winner] == len(strings[winner]):
            done[winner] = True
        else:
            shared[winner] = lcps[winner][heads[winner]]
        node = (winner + k) // 2
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node //= 2
    return out_run, out_index, out_lcp


def repeats(lcp: np.ndarray, lefts: list[bytes], lo: np.ndarray, hi: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distance before the anchor at which a repeated window starts, for each sorted context; greatest < 0: none."""
    n = len(lcp)
    low, high = np.where(many, lo, length), np.where(many, hi, -1)
    if n < 2:
        return low, high
    # contexts that share their last m bytes before the anchor: neighbours in the order of these bytes, cut where fewer agree
    order = sorted(range(n), key=lefts.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    agree = np.zeros(n, np.int64)
    agree[1:] = [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
    best = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    for m in range(int(hi.max(initial=0)) + 1):
        act = np.flatnonzero((lo <= m) & (hi >= m) & (best >= length - m))
        if len(act) < 2:
            continue
        key = np.cumsum(lcp < length - m)[act] * (n + 1) + np.cumsum(agree < m)[rank[act]]
        by_key = np.argsort(key)
        same = key[by_key][1:] == key[by_key][:-1]
        hit = act[np.unique(np.concatenate((by_key[1:][same], by_key[:-1][same])))]
        low[hit] = np.minimum(low[hit], m)
        high[hit] = np.maximum(high[hit], m)
    return low, high


def _bands(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The bands [begin, end) of distances that [lo, hi] reaches."""
    begin, end = 0, 1
    while begin <= hi:
        if end > lo:
            yield begin, end
        begin, end = end, end * 2


def _runs(text_col: str, lengths: list[int], buckets: int, flush: int = 16 << 20):
    """Sorted front-coded runs for each bucket, of the contexts of the surviving anchors of each task; and, dealt evenly,
    the stretches that the task itself knows to repeat. Word codes have buckets of their own, behind those of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[tuple[bytes, bytes], list[tuple[int, int, int]]]] = {}
        held = 0

        def put(kind: int, bucket: int, right: bytes, left: bytes, place: tuple[int, int, int]) -> int:
            places = parts.setdefault(kind * buckets + bucket % buckets, {}).setdefault((right, left), [])
            places.append(place)
            return 150 if len(places) > 1 else len(right) + len(left) + 500

        def out() -> pa.RecordBatch:
            names, share = sorted(parts), []
            for kind in range(len(lengths)):
                own = [b for b in names if b // buckets == kind]
                done = np.array([(d, t, pos - len(left), pos + len(right)) for b in own for (right, left), places in parts[b].items() if len(places) > 1 for d, t, pos in places], dtype=_STRETCH)
                share += np.array_split(done, len(own)) if own else []
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([encode_run(parts[b]) for b in names], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], names=["bucket", "run", "done"]
            )

        for batch in batches:
            for d, t, text, rows in zip(*(batch.column(k) for k in ("_d", "_t", text_col, "_a")), strict=True):
                d, t, text, code = d.as_py(), t.as_py(), text.as_py().encode(), None
                for h, at, hot in zip(*(rows.values.field(k).to_pylist() for k in ("h", "at", "hot")), strict=True):
                    pos, lo, hi = at >> 20, at >> 10 & 1023, at & 1023
                    bucket = h ^ (h >> 32)
                    kind = h & 1 if len(lengths) > 1 else 0
                    length = lengths[kind]
                    if kind and code is None:
                        code = word_codes([text])[0]
                    data = code if kind else text
                    right, left = data[pos : pos + length - lo], data[pos - hi : pos][::-1]
                    if not hot:
                        held += put(kind, bucket, right, left, (d, t, pos))
                        continue
                    for begin, end in _bands(lo, hi):
                        low, high = max(lo, begin), min(hi, end - 1)
                        seen = zlib.crc32(left[:begin], zlib.crc32(right[: length - end + 1], begin))
                        held += put(kind, bucket + seen, right[: length - low], left[:high], (d, t, pos))
                if held > flush:
                    yield out()
                    parts, held = {}, 0
        if parts:
            yield out()

    return run


def _merge(lengths: list[int], buckets: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kind = int(key[0]) // buckets
        length = lengths[kind]
        runs = [Run(x) for x in frame["run"]]
        done = np.concatenate([np.frombuffer(x, _STRETCH) for x in frame["done"]])
        which, index, lcp = merge_runs([(r.rights, r.lcps) for r in runs])
        base = np.concatenate(([0], np.cumsum([len(r.rights) for r in runs])))[:-1]
        at = base[which] + np.array(index, np.int64)
        many = np.concatenate([r.many for r in runs])
        lefts = [runs[r].lefts[i] for r, i in zip(which, index, strict=True)]
        lo = length - np.array([len(runs[r].rights[i]) for r, i in zip(which, index, strict=True)], np.int64)
        hi = np.fromiter(map(len, lefts), np.int64, len(lefts))
        low, high = repeats(np.array(lcp, np.int64), lefts, lo, hi, many[at], length)
        back_low, back_high = np.empty_like(low), np.empty_like(high)
        back_low[at], back_high[at] = low, high
        places = np.concatenate([r.places for r in runs])
        low, high = back_low[~many], back_high[~many]
        hit = high >= 0
        pos = places["pos"].astype(np.int64)
        return pd.DataFrame({
            "_d": np.concatenate((places["d"][hit], done["d"])), "_t": np.concatenate((places["t"][hit], done["t"])),
            "begin": np.concatenate(((pos - high)[hit], done["begin"])), "end": np.concatenate(((pos - low + length)[hit], done["end"])), "words": kind > 0,
        })

    return run


def union(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches that at least one stretch covers; adjacent ones are one."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], begins[1:] > ends[:-1])))
    return list(zip(begins[new].tolist(), ends[np.concatenate((new[1:] - 1, [len(ends) - 1]))].tolist(), strict=True))


def erase(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the union of the stretches, and the maximal stretches removed."""
    spans = union(begins, ends)
    kept, at = [], 0
    for b, e in spans:
        kept.append(text[at:b])
        at = e
    return b"".join([*kept, text[at:]]), spans


def _erase_column(as_text: bool, mark: bool):
    """What is left, what went and where; with `mark`, passages of words are counted and stay."""
    kind = pa.struct([("kept", pa.string() if as_text else pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("n_passage", pa.int64())])

    @F.arrow_udf(f"struct<kept:{'string' if as_text else 'binary'},n_removed:bigint,spans:array<struct<begin:bigint,end:bigint>>,n_passage:bigint>")
    def erased(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for x, rows in zip(text, found, strict=True):
            data = (x.as_py() or "").encode()
            kept, spans, passage = data, [], 0
            if rows.is_valid and len(rows.values):
                begins, ends, coded = (rows.values.field(k).to_numpy(zero_copy_only=False) for k in ("begin", "end", "words"))
                if coded.any():
                    more = word_stretches(data, begins[coded], ends[coded])
                    begins, ends = begins[~coded], ends[~coded]
                    if len(more[0]):
                        passage = sum(e - b for b, e in union(*more))
                    if not mark:
                        begins, ends = np.concatenate((begins, more[0])), np.concatenate((ends, more[1]))
                if len(begins):
                    kept, spans = erase(data, begins, ends)
            shown = kept.decode("utf-8", "ignore") if as_text else kept
            out.append({"kept": shown, "n_removed": len(data) - len(kept), "spans": [{"begin": b, "end": e} for b, e in spans], "n_passage": passage})
        found = pa.array(out, kind)
        del out
        release()
        return found

    return erased.asNondeterministic()  # so that filters on the result don't run it again


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False, hot: int = HOT, words: int = 0, mark_words: bool = False
) -> DataFrame:
    """docs with `kept`, `n_removed` and `spans` (of the bytes removed, in order), and `n_passage`, the bytes in repeated passages of words.

    `kept` is the bytes that remain (binary), or, with as_text, the whole characters among them (string). With `words`,
    passages of so many words that repeat go too; with mark_words they are only counted.
    """
    sizes = [(length, gram)] + ([(words * WORD_BYTES, -(-words // 3) * WORD_BYTES)] if words else [])
    if not all(0 < g <= n < 1024 for n, g in sizes):
        raise ValueError("gram, length and words must fit")
    lengths = [n for n, _ in sizes]
    docs = docs.drop("kept", "n_removed", "spans", "n_passage")
    keyed = docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_t": F.xxhash64(text_col)})
    plain = keyed.filter(F.octet_length(text_col) >= (min(length, 2 * words - 1) if words else length)).select("_d", "_t", text_col)
    anchors = materialize(plain.mapInArrow(trimmed(_anchors(sizes)), _ANCHOR_SCHEMA), "anchors")
    often = materialize(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    buckets = max(partitions_for(docs.sparkSession), -(-int(often.agg(F.sum("n")).first()[0] or 0) // BUCKET_ANCHORS))
    # sets, as equal rows have the same anchors and the same stretches
    rows = anchors.hint("merge").join(often.select("h", (F.col("n") > hot).alias("hot")), "h")
    rows = materialize(rows.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("h", "at", "hot")).alias("_a")), "places")
    discard(anchors, often)
    # Both joins with the texts use all columns, so that the texts are exchanged once.
    runs = keyed.hint("merge").join(rows, ["_d", "_t"]).mapInArrow(trimmed(_runs(text_col, lengths, buckets)), "bucket int, run binary, done binary")
    found = runs.groupBy("bucket").applyInPandas(trimmed_group(_merge(lengths, buckets)), "_d long, _t long, begin long, end long, words boolean")
    found = found.groupBy("_d", "_t").agg(F.collect_set(F.struct("begin", "end", "words")).alias("_f"))
    out = keyed.hint("merge").join(found, ["_d", "_t"], "left").withColumn("_r", _erase_column(as_text, mark_words)(text_col, "_f"))
    return out.select(*[F.col(c) for c in docs.columns], *[F.col(f"_r.{c}").alias(c) for c in ("kept", "n_removed", "spans", "n_passage")])
