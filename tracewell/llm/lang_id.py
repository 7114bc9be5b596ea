"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words, and the posterior
over the languages (with the learned shares as prior) gives the prediction and its score. Pieces are learned by
expectation-maximisation: expected counts over all segmentations of the words of a bounded sample of labelled texts.

Words are runs of letters, lower-cased, with a word-begin mark, of any length. Letters outside the vocabulary are pieces
of their own with a floor probability. Forward and backward values are brought back to range every RESCALED letters.

Defined results: texts that are null or hold no letter get `und` and score 0; so does every text if nothing was labelled.
Of languages with equal posteriors the first by name is predicted. Repeated labelled rows (same id, text and language) count
once in the sample and each in the prior; rows without id are told apart by their texts; other columns are ignored. At most
LANGUAGES languages are learned, the most frequent ones (ties by name), as each takes a column of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, release, sample_cuts, text_slices
from .shingles import mix

UNDETERMINED = "und"
#: The sample: so many texts of each language, those of the smallest hashes of their ids and texts.
TEXTS_PER_LANGUAGE = 250
#: Of each language's sample the most frequent words are learned from, so many at most.
WORDS_PER_LANGUAGE = 100_000
#: So many languages are worked on at once, so memory doesn't grow with their number.
LANGUAGE_BLOCK = 16
RESCALED = 16
_MARK = 0x2581
_FLOOR = 1e-7
_NO_LETTERS, _NO_LETTERS_JVM = r"[^\pL]+", r"[^\p{L}]+"
_CELLS = 1 << 20  # words times letters worked on at once


def public_pieces() -> list[str]:
    """The letter pieces of the public 32k vocabulary, lower-cased; a leading mark stands for a word's begin."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if (p[1:] if p[0] == chr(_MARK) else p).isalpha())


def _poly(codes: np.ndarray, h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0xD1342543DE82EF95) + codes.astype(np.uint64) + np.uint64(1)


class Pieces:
    """Open-addressed table from piece to number (1 for unknown single letters, 0 for no piece)."""

    def __init__(self, pieces: list[str]) -> None:
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            for c in p:
                keys[i : i + 1] = _poly(np.array([ord(c)], np.uint64), keys[i : i + 1])
        self.n = len(pieces) + 2
        self.longest = max(map(len, pieces), default=1)
        self.bits = max(4, int(8 * len(pieces)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        for number, key in enumerate(keys, 2):
            at = int(mix(key.reshape(1))[0] >> np.uint64(64 - self.bits))
            while self.ids[at]:
                at = (at + 1) % len(self.ids)
            self.keys[at], self.ids[at] = key, number

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], 0)
        open_ = np.flatnonzero((out == 0) & (self.ids[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.ids)
            here = at[open_]
            same = self.keys[here] == h[open_]
            out[open_[same]] = self.ids[here[same]]
            open_ = open_[~same & (self.ids[here] != 0)]
        return out


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, matrix of their code points with the mark in front) of words of equal length; words are not empty."""
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(lens) - lens
    for n in np.unique(lens):
        of_length = np.flatnonzero(lens == n)
        for lo in range(0, len(of_length), max(1, _CELLS // int(n))):
            own = of_length[lo : lo + max(1, _CELLS // int(n))]
            yield own, np.concatenate((np.full((len(own), 1), _MARK, np.uint32), codes[begin[own][:, None] + np.arange(n)]), axis=1)


def _numbers(table: Pieces, codes: np.ndarray) -> list[np.ndarray]:
    """For each piece length k, the piece number at each begin of each word: arrays of (n, length - k + 1)."""
    n, length = codes.shape
    h, out = np.zeros((n, length), np.uint64), []
    for k in range(1, min(table.longest, length) + 1):
        width = length - k + 1
        h = _poly(codes[:, k - 1 :], h[:, :width])
        ids = table.find(h.ravel()).reshape(n, width)
        if k == 1:
            ids[ids == 0] = 1
        out.append(ids)
    return out


def _rescale(values: np.ndarray, shift: np.ndarray, newest: int, window: slice) -> None:
    """Divides the values of a window of positions, which have one scale, by the newest; `shift` is the logarithm taken out."""
    top = values[:, newest : newest + 1].copy()
    values[:, window] /= top
    shift[:, window] += np.log(top)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    table: Pieces | None
    probs: np.ndarray  # piece x language

    def blocks(self) -> Iterator[slice]:
        return (slice(k, min(k + LANGUAGE_BLOCK, len(self.languages))) for k in range(0, len(self.languages), LANGUAGE_BLOCK))

    def word_scores(self, words: pa.Array, block: slice | None = None) -> np.ndarray:
        """log P(word | language), summed over segmentations, for a block of languages (all, if none is given)."""
        probs = self.probs[:, block or slice(None)]
        out = np.zeros((len(words), probs.shape[1]))
        for own, codes in _by_length(words):
            alpha, shift = _forward(probs, codes, _numbers(self.table, codes))
            out[own] = np.log(alpha[:, -1]) + shift[:, -1]
        return out

    def score(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Prediction and posterior of each text."""
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _NO_LETTERS)
        words = lists.values if lists.offset == 0 else lists.flatten()
        words = pc.dictionary_encode(words)
        values, codes = words.dictionary, words.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        wide = pc.utf8_length(values).to_numpy(zero_copy_only=False)
        some = np.bincount(owner, weights=wide[codes] > 0, minlength=len(texts)) > 0
        if not self.languages or not some.any():
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        real = np.flatnonzero(wide > 0)
        known, total = values.take(pa.array(real)), np.zeros((len(texts), len(self.languages)))
        for block in self.blocks():
            scores = np.zeros((len(values), block.stop - block.start))
            scores[real] = self.word_scores(known, block)
            for j in range(block.start, block.stop):
                total[:, j] = np.bincount(owner, weights=scores[codes, j - block.start], minlength=len(texts))
        total += np.log(self.prior)
        top = total.max(1, keepdims=True)
        best, sure = total.argmax(1), 1 / np.exp(total - top).sum(1)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, sure, 0.0).tolist()


def _forward(probs: np.ndarray, codes: np.ndarray, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, logarithms taken out of them) of each word, position and language, by the languages' piece probabilities."""
    n, length = codes.shape
    alpha = np.zeros((n, length + 1, probs.shape[1]))
    alpha[:, 0] = 1
    shift = np.zeros_like(alpha) if length > RESCALED else np.zeros((1, length + 1, 1))
    some = [ids.any(0) for ids in numbers]
    for i in range(1, length + 1):
        first = max(0, i - len(numbers))
        shift[:, i] = shift[:, i - 1]
        for k in range(1, i - first + 1):
            if not some[k - 1][i - k]:
                continue
            ids = numbers[k - 1][:, i - k]
            hit = np.flatnonzero(ids)
            if len(hit) * 2 > n:
                alpha[:, i] += alpha[:, i - k] * probs[ids]
            else:
                alpha[hit, i] += alpha[hit, i - k] * probs[ids[hit]]
        if length > RESCALED and i % RESCALED == 0:
            _rescale(alpha, shift, i, slice(max(0, i - len(numbers) + 1), i + 1))
    return alpha, shift


def _expect(probs: np.ndarray, weight: np.ndarray, codes: np.ndarray, numbers: list[np.ndarray], expected: np.ndarray) -> None:
    """Adds the expected counts of pieces over all segmentations of the words, each word as often as `weight` says."""
    alpha, before = _forward(probs, codes, numbers)
    n, length = codes.shape
    beta = np.zeros_like(alpha)
    beta[:, length] = 1
    after = np.zeros_like(before)
    total = np.log(alpha[:, length]) + before[:, length]
    for i in range(length - 1, -1, -1):
        after[:, i] = after[:, i + 1]
        for k in range(1, min(len(numbers), length - i) + 1):
            ids = numbers[k - 1][:, i]
            hit = np.flatnonzero(ids)
            if not len(hit):
                continue
            use = probs[ids[hit]] * beta[hit, i + k]
            beta[hit, i] += use
            if length > RESCALED:
                use = np.exp(np.log(use) + np.log(alpha[hit, i]) + before[hit, i] + after[hit, i + k] - total[hit]) * weight[hit]
            else:
                use = use * alpha[hit, i] / alpha[hit, length] * weight[hit]
            for j in range(probs.shape[1]):
                expected[:, j] += np.bincount(ids[hit], weights=use[:, j], minlength=len(expected))
        if length > RESCALED and i % RESCALED == 0:
            _rescale(beta, after, i, slice(i, min(length, i + len(numbers) - 1) + 1))


def word_counts(texts: list[str]) -> dict[str, int]:
    """How often each word is in the texts."""
    flat = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), _NO_LETTERS).flatten()
    return {pair["values"].as_py(): pair["counts"].as_py() for pair in pc.value_counts(flat) if pair["values"].as_py()}


def learn(counts: dict[str, dict[str, int]], shares: dict[str, float], pieces: list[str], rounds: int = 4) -> LanguageModel:
    """Piece probabilities of each language from the counts of its words, by expectation-maximisation over segmentations."""
    languages = sorted(shares)
    prior = np.array([max(shares[x], 1e-9) for x in languages])
    table = Pieces(pieces)
    model = LanguageModel(languages, prior / prior.sum() if languages else prior, table, np.zeros((table.n, len(languages))))
    if not languages:
        return model
    seen = np.zeros(table.n)
    blocks = [(block, *_weighed(counts, languages[block])) for block in model.blocks()]
    for _, known, weight in blocks:
        for own, codes in _by_length(known):
            for ids in _numbers(table, codes):
                seen += np.bincount(ids.ravel(), weights=np.repeat(weight[own].sum(1), ids.shape[1]), minlength=table.n)
    seen[0] = 0
    model.probs[:] = np.maximum((seen + 0.1) / (seen + 0.1).sum(), _FLOOR)[:, None]
    model.probs[0] = 0
    for block, known, weight in blocks:
        groups = [(own, codes, _numbers(table, codes)) for own, codes in _by_length(known)]
        probs = model.probs[:, block].copy()
        for _ in range(rounds):
            expected = np.full_like(probs, 0.01)
            for own, codes, numbers in groups:
                _expect(probs, weight[own], codes, numbers, expected)
            expected[0] = 0
            probs = np.maximum(expected / expected.sum(0), _FLOOR)
            probs[0] = 0
        model.probs[:, block] = probs
    return model


def _weighed(counts: dict[str, dict[str, int]], languages: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of some languages, and how often each has each."""
    known = sorted({w for x in languages for w in counts.get(x, {})})
    place = {w: i for i, w in enumerate(known)}
    weight = np.zeros((len(known), len(languages)))
    for j, x in enumerate(languages):
        for w, n in counts.get(x, {}).items():
            weight[place[w], j] = n
    return pa.array(known, pa.string()), weight


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE, pieces: list[str] | None = None) -> LanguageModel:
    """A model of the labelled rows that `train` selects.

    The sample is bounded: for each language the `texts_per_language` texts of smallest hash of id and text, and of their words the
    `words_per_language` most frequent. What comes to the driver is these words with counts, and each language's number of rows.
    """
    labelled = docs.filter(train).filter(F.col(lang_col).isNotNull())
    shares = {r[0]: float(r[1]) for r in labelled.groupBy(lang_col).count().collect()}
    if not shares:
        return learn({}, {}, pieces or public_pieces())
    hashed = labelled.select(F.col(lang_col).alias("g"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    limit = sample_cuts(hashed, "g", "h", dict.fromkeys(shares, texts_per_language))
    chosen = F.lit(False)
    for lang, cut in sorted(limit.items()):
        chosen = chosen | ((F.col("g") == lang) & (F.col("h") <= cut))
    sample = hashed.filter(chosen).dropDuplicates(["g", "h"])
    words = sample.select("g", F.explode(F.split(F.lower("t"), _NO_LETTERS_JVM)).alias("w")).filter("w <> ''")
    counts: dict[str, dict[str, int]] = {x: {} for x in shares}
    ranked = words.groupBy("g", "w").count().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("count"), "w")))
    for lang, word, n in ranked.filter(F.col("r") <= words_per_language).select("g", "w", "count").toLocalIterator(prefetchPartitions=True):
        counts[lang][word] = n
    return learn(counts, shares, pieces or public_pieces())


def language_column(model: LanguageModel, text: Column | str) -> Column:
    """struct<lang string, score double> of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        lang, score = [], []
        for _, part in text_slices(texts, SLICE_BYTES, 1000):
            a, b = model.score(pa.array(part, pa.binary()).cast(pa.string()))
            lang += a
            score += b
        release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return identify(text)
