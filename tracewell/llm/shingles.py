"""Word shingles as 64-bit hashes, computed for many documents at once.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Everything works on one byte buffer that holds a slice of documents, so the cost
per document is a few numpy calls shared by the whole slice.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


_POWERS = Powers()


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Content hash of data[begin:end] for each pair; data is uint8."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents data[starts:ends], and how many each document has.

    Documents must follow one another in the buffer, each followed by at least one separator byte.
    """
    folded = _FOLD[data]
    inside = ~_SPACE[folded]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    hashes = range_hashes(folded, begin, end)
    counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    return hashes, counts


#: Shingles are kept as hashes of so many bits; the rest of a sort key holds the document's place in its slice.
BITS = 54
SLICE_DOCS = 1 << (64 - BITS)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of `width`-word shingles of each text: all hashes, sorted within a text, and the sets' offsets.

    A text with fewer words than `width` has its whole word sequence as its only shingle; one without words has none.
    At most SLICE_DOCS texts go in one call.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1) - 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, counts = words(data, ends - lens, ends)
    first = np.cumsum(counts) - counts
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(len(texts)), per)
    at = np.repeat(first - offsets[:-1], per) + np.arange(offsets[-1])
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    have = np.repeat(np.minimum(counts, width), per)
    short = have < width
    out = have.astype(np.uint64)
    for k in range(width):
        term = mix(padded + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))[at + k]
        if k:
            term[short & (have <= k)] = 0
        out += term
    keys = (mix(out) >> np.uint64(64 - BITS)) | (owner.astype(np.uint64) << np.uint64(BITS))
    keys.sort()
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    keys = keys[keep]
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS)) if len(texts) < SLICE_DOCS else np.append(
        np.searchsorted(keys, np.arange(len(texts), dtype=np.uint64) << np.uint64(BITS)), len(keys)
    )
    return keys & np.uint64((1 << BITS) - 1), bounds
