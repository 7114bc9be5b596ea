"""Greedy longest-match token counts in linear time, without building pieces.

A word is a run of bytes other than ASCII white space, read with one space before it. Its first piece is the longest
vocabulary entry (with its leading space) that begins the word, each further piece the longest entry without a leading
space that begins the rest: word-piece segmentation. The trie of the vocabulary carries failure links and, for each
node, how many pieces are popped on taking the link (Song et al., Fast WordPiece Tokenization, 2021), so a word costs
one step for each byte. Entries of single bytes make every word segmentable.

Defined results: null and empty texts count 0 words and 0 tokens; texts of any length are counted whole, in time linear in
their bytes; repeated rows count each; of pieces that begin alike the longest is taken, so there are no ties; an empty table
gives none; other columns are never read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_slices

#: Words whose counts a worker keeps.
KEPT = 1_500_000


class LongestMatch:
    """The automaton. State 0 begins a word (its space is read), state 1 begins a later piece."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.vocabulary = vocabulary
        self._ready = False

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "_ready": False}

    def _build(self) -> None:
        step: dict[int, int] = {}
        ends, children = [False, False, False], [[], [], []]
        # node 2: the space before a word, from node 0
        step[0 << 8 | 32] = 2
        children[0].append((32, 2))
        for token in self.vocabulary:
            node = 0 if token[:1] == b" " else 1
            for byte in token:
                key = node << 8 | byte
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(ends)
                    children[node].append((byte, nxt))
                    ends.append(False)
                    children.append([])
                node = nxt
            ends[node] = True
        if not all((1 << 8 | b) in step and ends[step[1 << 8 | b]] for b in range(256) if b != 32):
            raise ValueError("the vocabulary lacks single bytes")
        ends[2] = True
        fail, pops = [-1] * len(ends), [0] * len(ends)
        queue = [0, 1]
        for node in queue:
            for byte, child in children[node]:
                if ends[child]:
                    fail[child], pops[child] = 1, 1
                else:
                    z, count = fail[node], pops[node]
                    while z >= 0 and (z << 8 | byte) not in step:
                        count += pops[z]
                        z = fail[z]
                    fail[child], pops[child] = (step[z << 8 | byte], count) if z >= 0 else (-1, 0)
                queue.append(child)
        tail = [0] * len(ends)  # pieces popped if the word ends here
        for node in queue:
            z, count = node, 0
            while z > 1:
                count += pops[z]
                z = fail[z]
            tail[node] = count
        self.step, self.fail, self.pops, self.tail = step, fail, pops, tail
        self.kept: dict[bytes, int] = {}
        self._ready = True

    def count_word(self, word: bytes) -> int:
        if not self._ready:
            self._build()
        get, fail, pops = self.step.get, self.fail, self.pops
        node, total = 2, 0
        for byte in word:
            nxt = get(node << 8 | byte)
            while nxt is None:
                total += pops[node]
                node = fail[node]
                nxt = get(node << 8 | byte)
            node = nxt
        return total + self.tail[node]

    def count_text(self, text: bytes) -> tuple[int, int]:
        """(words, tokens)"""
        if not self._ready:
            self._build()
        if len(self.kept) > KEPT:
            self.kept = {}
        words = text.split()
        for word in set(words).difference(self.kept):
            self.kept[word] = self.count_word(word)
        return len(words), sum(map(self.kept.__getitem__, words))


_SLOT: dict[str, LongestMatch] = {}


def count_column(automaton: LongestMatch, text: Column | str, name: str) -> Column:
    """struct<n_words bigint, n_tokens bigint> of a text column; `name` identifies the vocabulary in a worker."""

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def count(texts: pa.Array) -> pa.Array:
        own = _SLOT.setdefault(name, automaton)
        found = [own.count_text(t) for _, part in text_slices(texts) for t in part]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["n_words", "n_tokens"])

    return count(text)
