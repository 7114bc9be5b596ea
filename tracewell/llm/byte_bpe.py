"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves.
Tier two: other pre-tokens are merged by rank with a heap over a linked list of their bytes, in n log n.

Pre-tokens repeat, so a worker keeps the ids of those it has met, up to a bound.

Defined results: null texts count as empty; an empty text has no ids; texts of any length are encoded whole; repeated rows
have equal ids; merges of equal rank go from left to right; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_slices
from .shingles import mix, range_hashes

#: Pre-tokens, and space-separated chunks, whose ids a worker keeps.
KEPT = 800_000


def _hashes(tokens: list[bytes]) -> np.ndarray:
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lens)
    return range_hashes(np.frombuffer(b"".join(tokens), np.uint8), ends - lens, ends)


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace: n keys take n slots, a lookup is two array reads.

    Keys fall into buckets; from the fullest on, each bucket gets the first displacement that puts its keys on free
    slots. Buckets of one key are given a free slot directly (a negative displacement).
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        h = _hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys must differ")
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.empty(n, np.int64)
        sizes = np.diff(bounds)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = self._slots(h[own][None, :], (tries + np.uint64(base))[:, None])
                ok = ~taken[slots].any(1)
                for i in np.flatnonzero(ok):
                    if len(np.unique(slots[i])) == len(own):
                        taken[slots[i]], slot_of[own], self.shift[b] = True, slots[i], base + i + 1
                        break
                else:
                    base += 256
                    continue
                break
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            own = order[bounds[b]]
            slot_of[own] = next(free)
            self.shift[b] = -1 - slot_of[own]
        self.key_at = np.argsort(slot_of)  # slot -> index of its key

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, tokens: list[bytes]) -> np.ndarray:
        """For each string the slot of the only key that can equal it."""
        h = _hashes(tokens)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(h, shift.astype(np.uint64)))


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token itself: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
    n = len(token)
    after = list(range(1, n + 2))  # where the part that begins here ends
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        r = ranks.get(token[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapify(heap)
    while heap:
        _, i, mid, end = heappop(heap)
        if after[i] != mid or mid < 0 or after[mid] != end:
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            j = after[end]
            r = ranks.get(token[i:j])
            if r is not None:
                heappush(heap, (r, i, end, j))
        h = before[i]
        if h >= 0:
            r = ranks.get(token[h:end])
            if r is not None:
                heappush(heap, (r, h, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder for one vocabulary; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.hash = PerfectHash(self.tokens)
        self._ready()

    def _ready(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.find = None
        self.words = {r: t for t, r in self.ranks.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "chunks", "find", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _learn(self, new: list[str]) -> None:
        data = [x.encode() for x in new]
        keys, tokens = self.hash.key_at[self.hash.slots(data)].tolist(), self.tokens
        for text, token, key in zip(new, data, keys, strict=True):
            if tokens[key] == token:
                self.pieces[text] = self.ranks[token].to_bytes(4, "little")
            else:
                ids = merge_bytes(token, self.ranks)
                self.pieces[text] = struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, found: list[str]) -> bytes:
        new = set(found).difference(self.pieces)
        if new:
            self._learn(list(new))
        return b"".join(map(self.pieces.__getitem__, found))

    def _learn_chunks(self, new: list[str]) -> None:
        cut = [self.find(" " + x) for x in new]
        missing = {p for c in cut for p in c}.difference(self.pieces)
        if missing:
            self._learn(list(missing))
        for chunk, c in zip(new, cut, strict=True):
            self.chunks[chunk] = b"".join(map(self.pieces.__getitem__, c))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. No pre-token reaches over a space between two non-spaces (it begins there), so a text
        without white space at its ends and next to other white space is looked up by the chunks between its spaces."""
        if self.find is None:
            import regex

            self.find = regex.compile(self.pattern).findall
            self.odd = re.compile(r"\s\s").search
        if len(self.pieces) > KEPT:
            self.pieces = {}
        if len(self.chunks) > KEPT:
            self.chunks = {}
        split = [None if t[:1].isspace() or t[-1:].isspace() or self.odd(t) else t.split(" ") for t in texts]
        new = {c for s in split if s is not None for c in s[1:]}.difference(self.chunks)
        if new:
            self._learn_chunks(list(new))
        known = self.chunks.__getitem__
        return [self._encode(self.find(t)) if s is None else self._encode(self.find(s[0])) + b"".join(map(known, s[1:])) for t, s in zip(texts, split, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SLOT: dict[str, ByteBpe] = {}


def _shared(codec: ByteBpe, name: str) -> ByteBpe:
    """The worker's codec of this name, so that what it has met serves all batches."""
    return _SLOT.setdefault(name, codec)


def encode_column(codec: ByteBpe, text: Column | str, name: str) -> Column:
    """struct<n_tokens bigint, ids binary> of a text column; `name` identifies the vocabulary."""

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary>")
    def encode(texts: pa.Array) -> pa.Array:
        own = _shared(codec, name)
        ids = [x for _, part in text_slices(texts) for x in own.encode_many([t.decode() for t in part])]
        return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["n_tokens", "ids"])

    return encode(text)


def decode_column(codec: ByteBpe, ids: Column | str, name: str) -> Column:
    """The bytes that a column of ids (binary, as encode_column gives) stands for; null for null."""

    @F.arrow_udf("binary")
    def decode(values: pa.Array) -> pa.Array:
        own = _shared(codec, name)
        return pa.array([own.decode(x.as_py()) if x.is_valid else None for x in values], pa.binary())

    return decode(ids)


def round_trip_column(codec: ByteBpe, text: Column | str, name: str) -> Column:
    """Encodes, decodes the ids, and gives both digests, without moving ids and bytes out of the worker."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def both(texts: pa.Array) -> pa.Array:
        own = _shared(codec, name)
        n, a, b = [], [], []
        for _, part in text_slices(texts):
            for ids in own.encode_many([t.decode() for t in part]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)
