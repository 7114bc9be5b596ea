"""Order-preserving packing of tokenised documents: window cuts by dynamic programming.

Documents follow one another in the order of the table's partitions, each with a separator after it, as one stream of
tokens to a partition. The stream is cut into sequences of at most `window` tokens. A cut may fall after a document (free),
after a sentence, or, where a sentence is long, every `SPACING` tokens within it; the last two cost a penalty, counted in
tokens. A sequence of n tokens takes window - n tokens of padding, or none where n is a power of two, besides `OPENING`
for each sequence. The cuts of least total cost are found exactly:

    cost(p) = penalty(p) + OPENING + min( min of cost(s) + window - (p - s) over s in [p - window, p),
                                          min of cost(p - n) over powers of two n )

The first minimum is of cost(s) + s over a window that slides, so a monotone queue gives it in constant time; the second
looks up the few boundaries that lie a power of two before. A partition is read as a stream, one slice of a text at a time:
decided sequences are those that all cheapest ways to the boundaries of the last window share, so what is held is a few
sequences, whatever the length of the partition or of a text (only if `MOST_HELD` tokens stay undecided, the cheapest way
so far is taken). No row leaves its partition: nothing is shuffled, and a task run again gives the same rows.

Token ids are those of the `tokenizers` library for the given file; texts of characters on which two public
implementations agree are encoded by the faster of them, all others by the library itself.

Defined results: null and empty texts are their separator alone; a null id is kept as it is; rows that repeat an id are
packed each, as rows of their own; an empty table gives no rows; other columns are ignored, whatever their names. Of cuts of
equal cost the one that makes the longest last sequence is taken. Which sequences come out follows the table's partitions,
and so do sequence numbers; their padding hardly does.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

WINDOW, SEPARATOR = 1024, 0
#: Costs in tokens: of a sequence, of a cut after a sentence, of a cut within one, which may come every SPACING tokens.
OPENING, SENTENCE, WITHIN, SPACING = 1, 4, 24, 32
SLICE_CHARS, HELD, MOST_HELD = 1 << 19, 1 << 16, 1 << 22
_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENDS = (".", "!", "?", "…", "。", "！", "？")


class Cuts:
    """The cheapest cuts of a stream whose boundaries come in ascending order; boundary 0 is the begin of the stream."""

    def __init__(self, window: int = WINDOW, opening: int = OPENING) -> None:
        self.window, self.opening = window, opening
        self.steps = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
        self.at, self.cost, self.back = [0], [0], [-1]
        self.queue: deque[int] = deque([0])
        self.low = 0  # first boundary that is still within the window

    def extend(self, places: np.ndarray, penalties: np.ndarray) -> None:
        """More boundaries. Consecutive ones may not lie more than the window apart."""
        if not len(places):
            return
        low, first = self.low, len(self.at)
        near = np.concatenate([np.array(self.at[low:], np.int64), places])
        exact: dict[int, list[int]] = {}
        for step in self.steps:
            k = np.searchsorted(near, places - step)
            hit = np.flatnonzero(near[k] == places - step)
            for i, j in zip(hit.tolist(), k[hit].tolist(), strict=True):
                exact.setdefault(i, []).append(low + j)
        at, cost, back, queue, window = self.at, self.cost, self.back, self.queue, self.window
        for i, (p, penalty) in enumerate(zip(places.tolist(), penalties.tolist(), strict=True)):
            while at[queue[0]] < p - window:
                queue.popleft()
            origin = queue[0]
            least = cost[origin] + window - (p - at[origin])
            for j in exact.get(i, ()):
                if cost[j] < least or (cost[j] == least and j < origin):
                    least, origin = cost[j], j
            total = least + penalty + self.opening
            key = total + p
            while queue and cost[queue[-1]] + at[queue[-1]] > key:
                queue.pop()
            queue.append(first + i)
            at.append(p)
            cost.append(total)
            back.append(origin)
        while at[low] < at[-1] - window:
            low += 1
        self.low = low

    def _way(self, last: int) -> list[int]:
        """Ends of the sequences on the way to a boundary."""
        way, k = [], last
        while self.back[k] >= 0:
            way.append(self.at[k])
            k = self.back[k]
        return way[::-1]

    def _forget(self, root: int) -> None:
        """Drops what lies before a settled boundary. Later ones that aren't reached from it lie on no way to a live one."""
        self.at, self.cost = self.at[root:], self.cost[root:]
        self.back = [-1, *(k - root for k in self.back[root + 1 :])]
        self.low -= root
        self.queue = deque(k - root for k in self.queue if k >= root)

    def settled(self) -> list[int]:
        """Ends of the sequences that no boundary to come can change: the part that all ways to live boundaries share."""
        ways = [-k for k in range(self.low, len(self.at))]
        heapq.heapify(ways)
        seen = set(ways)
        while len(ways) > 1:
            j = -self.back[-heapq.heappop(ways)]
            if j not in seen:
                seen.add(j)
                heapq.heappush(ways, j)
        root = -ways[0]
        way = self._way(root)
        if root:
            self._forget(root)
        return way

    def finish(self) -> list[int]:
        """Ends of all sequences up to the last boundary, where a new stream begins."""
        last = len(self.at) - 1
        way = self._way(last)
        self.at, self.cost, self.back = [self.at[last]], [self.cost[last]], [-1]
        self.queue, self.low = deque([0]), 0
        return way


class Encoder:
    """Token ids of a tokenizers file, and which tokens may end a sentence."""

    def __init__(self, content: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(content)
        spec = json.loads(content)
        as_byte = {c: b for b, c in _byte_letters().items()}
        tokens = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in as_byte for c in t)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {t: i for t, i in tokens.items() if i not in special.values()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens=special)
        size = max([*tokens.values(), *special.values()]) + 1
        self.ends, self.line, self.spaced = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        closing = "\"')]”’»"
        for token, i in tokens.items():
            text = token.decode("utf-8", "replace")
            self.ends[i] = text.rstrip(closing).endswith(_ENDS)
            self.line[i] = text.endswith("\n")
            self.spaced[i] = text[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        if _SAME.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places after which a sentence or a line ends; the last token's follower is a white space."""
        follows = np.append(self.spaced[ids[1:]], True) if len(ids) else np.zeros(0, bool)
        return np.flatnonzero(self.ends[ids] & follows | self.line[ids]) + 1


#: Pre-tokens of a byte-level tokenizers file, and characters on which the libraries' tables agree (Latin and punctuation).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAME = re.compile("[\t\n\r\x20-\x7e\xa0-\u017f\u2010-\u2027\u20ac]*")
_ENCODERS: dict[str, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """The worker's encoder of this file, built once."""
    if content not in _ENCODERS:
        _ENCODERS[content] = Encoder(content)
    return _ENCODERS[content]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts of a text that are tokenised alike apart: no token reaches from a non-space over the space after it."""
    at = 0
    while len(text) - at > size:
        cut = _BORDER.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


_BORDER = re.compile(r"\S(?=[ \t\n\r])")


class Packer:
    """Packs one stream of documents; rows come out as soon as a document's sequences are settled."""

    def __init__(self, encoder: Encoder, first: int, window: int = WINDOW, held: int = HELD, most: int = MOST_HELD) -> None:
        self.encoder, self.window, self.held, self.most = encoder, window, held, most
        self.cuts, self.sequence = Cuts(window), first
        self.begin = self.end = 0  # of the first sequence that isn't settled, of the stream
        self.last = 0  # boundary that the search knows
        self.noted: list[tuple[np.ndarray, int]] = []
        self.ids: list[np.ndarray] = []  # from `begin` on
        self.docs: deque[list] = deque()  # [id, begin, end or None, rows]
        self.rows: list[tuple] = []

    def _flush(self) -> None:
        """Hands the boundaries noted to the search; long gaps before them get ones of their own."""
        if not self.noted:
            return
        own = np.concatenate([p for p, _ in self.noted])
        penalties = np.repeat([c for _, c in self.noted], [len(p) for p, _ in self.noted])
        self.noted = []
        if not len(own):
            return
        before = np.concatenate([[self.last], own[:-1]])
        step = min(SPACING, self.window)
        extra = [np.arange(before[i] + step, own[i], step) for i in np.flatnonzero(own - before > step).tolist()]
        if extra:
            more = np.concatenate(extra)
            places = np.concatenate([own, more])
            order = np.argsort(places, kind="stable")
            own, penalties = places[order], np.concatenate([penalties, np.full(len(more), WITHIN)])[order]
        self.cuts.extend(own, penalties)
        self.last = int(own[-1])

    def _take(self, ids: np.ndarray) -> None:
        self.ids.append(np.ascontiguousarray(ids, "<u4"))
        self.end += len(ids)

    def add(self, doc_id: int | None, text: str) -> None:
        self.docs.append([doc_id, self.end, None, []])
        for part in slices(text) if text else ():
            ids = self.encoder.ids(part)
            at = self.end
            self._take(ids)
            self.noted.append((self.encoder.sentence_ends(ids) + at, SENTENCE))
            if self.end - self.begin > self.held:
                self._settle()
        self._take(np.array([SEPARATOR], "<u4"))
        self.noted.append((np.array([self.end], np.int64), 0))
        self.docs[-1][2] = self.end
        if self.end - self.begin > self.held:
            self._settle()

    def _settle(self) -> None:
        self._flush()
        self._close(self.cuts.settled())
        if self.last - self.begin > self.most:
            self._close(self.cuts.finish())

    def _close(self, ends: list[int]) -> None:
        """Rows of sequences with these ends."""
        if not ends:
            return
        ids = np.concatenate(self.ids)
        data, origin = memoryview(ids).cast("B"), self.begin
        at, k = self.begin, 0
        for end in ends:
            while at < end:
                doc = self.docs[k]
                stop = end if doc[2] is None else min(end, doc[2])
                crc = zlib.crc32(data[4 * (at - origin) : 4 * (stop - origin)])
                doc[3].append((at - doc[1], stop - at, crc, self.sequence, at - self.begin))
                at = stop
                if stop == doc[2]:
                    k += 1
            self.begin, self.sequence = end, self.sequence + 1
        self.ids = [ids[self.begin - origin :].copy()]
        for _ in range(k):
            doc_id, begin, end, pieces = self.docs.popleft()
            self.rows.extend((doc_id, start, n, crc, end - begin, seq, offset) for start, n, crc, seq, offset in pieces)

    def finish(self) -> None:
        self._flush()
        self._close(self.cuts.finish())

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def _run(content: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            for doc_id, text, part in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if packer is None:
                    packer = Packer(_encoder(content), part.as_py() << 33, window)
                packer.add(doc_id.as_py(), text.as_py() or "")
                if len(packer.rows) >= 10_000:
                    yield packer.taken()
        if packer is not None:
            packer.finish()
            yield packer.taken()
        release()

    return run


def pack_in_order(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), by the byte-level tokenizers file at `path`.

    `start` is the piece's place in its document's ids, `offset` its place in the sequence.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(_run(content, window), _SCHEMA).withColumnRenamed("id", id_col)
