"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding: lower case; letters that look like Latin ones (Cyrillic, Greek, full-width) become those; digits and signs that
stand for letters inside a word become the letters; invisible characters and combining marks vanish; everything else that is
no letter becomes a space. Patterns are whole words (` word `) and word beginnings (` stem`) of any length. Matches inside an
exception phrase don't count. The score is a logistic function of the summed weights and of the weights normalised by length.

The lexicon is a public seed list, extended and weighted on labelled texts: word beginnings and words are added one by
one, each time the one that covers most toxic texts not yet covered while clean texts hardly have it. Beginnings are those of
at least STEM letters that end where two of the toxic texts' words part, so none that tells texts apart is left out.

Defined results: null and empty texts have no match and get the score of a text without matches; rows that repeat an id are
scored each, and learned from by the least of their texts; of several labels of one id the greatest counts; labels other than
0 and 1, and labels without id, are left out; texts of any length are matched in time linear in their length; other columns
are never read.
"""

from __future__ import annotations

import math
import os
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sample_cuts

# A seed of common English insults, and phrases in which they are harmless.
SEED = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "clowns", "pathetic", "disgusting", "worthless",
    "imbecile", "dumb", "dimwit", "halfwit", "jerk", "creep", "filth", "vermin", "bastard", "cretin", "fool", "garbage", "crap", "damn",
)
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "pond scum", "garbage collection", "garbage collector", "fool proof", "april fool", "beaver dam")
# Characters that look like, or stand for, Latin letters.
LOOKALIKES = dict(zip("авеёкмнорстухіјѕԁԛԝαβεικνορτυχ", "abeekmhopctyxijsdqwabeiknoptux", strict=True))
DIGITS = dict(zip("013456789@$!|", "oieasgtbgasii", strict=True))

#: The labelled sample: so many toxic and clean texts, those of the smallest hashes of their ids.
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 3000
STEM = 4  # least letters of a beginning


class _Fold(dict):
    """Code point -> folded text, worked out on first use. Signs that may stand for letters are left for _signs."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn", "Me"):
            self[code] = ""
            return ""
        low = unicodedata.normalize("NFKC", char).lower()
        if len(low) != 1:
            low = char.lower()[:1]
        low = LOOKALIKES.get(low, low)
        self[code] = out = low if low.isalpha() else DIGITS.get(low, " ") if low.isdigit() else " "
        return out


class _Invisible(dict):
    """Code point -> nothing for characters that folding removes, else itself."""

    def __missing__(self, code: int) -> int | None:
        self[code] = out = None if unicodedata.category(chr(code)) in ("Cf", "Mn", "Me") else code
        return out


_FOLD, _INVISIBLE = _Fold(), _Invisible()
_SIGNS = tuple(s for s in DIGITS if not s.isdigit())


def fold(text: str) -> str:
    """The text to match on: folded words, each between spaces. Signs become letters only between two letters or digits."""
    if any(s in text for s in _SIGNS):
        import re

        text = re.sub(r"(?<=[^\W_])[@$!|](?=[^\W_])", lambda m: DIGITS[m[0]], text.translate(_INVISIBLE))
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def outside(found: list[tuple[int, int, float]], spared: list[tuple[int, int, float | None]]) -> list[tuple[int, int, float]]:
    """The matches that lie in no spared stretch, in one sweep by begin: of the stretches begun, the one that reaches furthest decides."""
    if not spared:
        return found
    spared, kept, reach, k = sorted(spared, key=lambda x: x[0]), [], -1, 0
    for m in sorted(found, key=lambda x: x[0]):
        while k < len(spared) and spared[k][0] <= m[0]:
            reach = max(reach, spared[k][1])
            k += 1
        if m[1] > reach:
            kept.append(m)
    return kept


@dataclass
class ToxicityModel:
    """Patterns with weights (with their leading, and for whole words trailing, space), exceptions and logistic weights."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    weights: tuple[float, ...] = (-3.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of lexicon matches outside exception phrases."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for pattern, weight in self.lexicon.items():
                a.add_word(pattern, (len(pattern), weight))
            if len(a):
                a.make_automaton()
            self._automaton = a
        if not len(self._automaton):
            return []
        found, spared = [], []
        for last, (n, weight) in self._automaton.iter(folded):
            (spared if weight is None else found).append((last + 1 - n, last + 1, weight))
        return outside(found, spared)

    def features(self, text: str) -> tuple[float, float]:
        """Summed weight, and summed weight per 100 words, both as log(1 + x)."""
        folded = fold(text)
        by_word: dict[int, float] = {}
        for begin, _, weight in self.matches(folded):
            by_word[begin] = max(weight, by_word.get(begin, 0.0))
        total = sum(by_word.values())
        return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 1))

    def score(self, text: str) -> float:
        x, y = self.features(text)
        z = self.weights[0] + self.weights[1] * x + self.weights[2] * y
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def stems_of(words: Iterable[str], least: int = STEM) -> set[str]:
    """The beginnings of at least `least` letters at which two of the words part; a word that begins another is one too."""
    out, before = set(), ""
    for word in sorted(set(words)):
        n = len(os.path.commonprefix((before, word)))
        if n >= least:
            out.add(word[:n])
        before = word
    return out


def _patterns(words: list[str], stems: set[str], lengths: list[int]) -> set[str]:
    """The patterns that distinct folded words have: themselves, and those of `stems` (of these lengths) that they begin with."""
    out = {f" {w} " for w in words}
    out.update(f" {w[:k]}" for w in words for k in lengths if k <= len(w) and w[:k] in stems)
    return out


def learn_lexicon(texts: list[str], labels: list[int], seed: tuple[str, ...] = SEED, least: int = 3) -> dict[str, float]:
    """Patterns with weights, from the distinct words (distinct_words) of labelled texts; the seed with its default weight without texts of both kinds.

    A pattern is added only if it covers at least `least` toxic texts that no other covers, which bounds the lexicon.
    """
    lexicon = {f" {w} ": 3.0 for w in seed}
    if not texts or len(set(labels)) < 2:
        return lexicon
    stems = stems_of(w for words, y in zip(texts, labels, strict=True) if y for w in words.split())
    lengths = sorted(set(map(len, stems)))
    # patterns are worked out when they are needed: those of all texts at once would be large
    patterns = lambda words: _patterns(words.split(), stems, lengths)
    bad_counts, good = Counter(), Counter()
    for words, y in zip(texts, labels, strict=True):
        if y:
            bad_counts.update(patterns(words))
    counts = Counter({p: n for p, n in bad_counts.items() if n >= least or p in lexicon})
    del bad_counts
    for words, y in zip(texts, labels, strict=True):
        if not y:
            good.update(p for p in patterns(words) if p in counts or p in lexicon)
    n_bad, n_good = sum(labels), len(labels) - sum(labels)

    def weight(p: str, seen: int) -> float:
        return math.log((seen + 0.5) / (n_bad + 1)) - math.log((good[p] + 0.5) / (n_good + 1))

    lexicon = {p: min(max(weight(p, counts[p]), 0.0), 8.0) if counts[p] + good[p] else 3.0 for p in lexicon}
    lexicon = {p: w for p, w in lexicon.items() if w > 1.0}
    eager = {p for p in counts if good[p] <= 0.02 * counts[p] * n_good / n_bad and weight(p, counts[p]) > 2.0}
    left = []
    for words, y in zip(texts, labels, strict=True):
        if y:
            s = patterns(words)
            if not s & lexicon.keys():
                left.append(s & eager)
    gain = Counter(p for s in left for p in s)
    while gain:
        # of equals the shortest beginning generalises best
        p, n = max(gain.items(), key=lambda x: (x[1] - 3 * good[x[0]], -len(x[0]), x[0]))
        if n < least:
            break
        lexicon[p] = min(weight(p, counts[p]), 8.0)
        for s in left:
            if p in s:
                gain.subtract(s)
        left = [s for s in left if p not in s]
        gain = +gain
    return lexicon


def learn_weights(features: list[tuple[float, float]], labels: list[int]) -> tuple[float, ...]:
    """Logistic weights of the features of labelled texts."""
    x = np.array([(1.0, *f) for f in features])
    y = np.array(labels, float)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    share = np.sqrt(share)  # between the sample's balance and an even one
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(texts: list[str], labels: list[int], seed: tuple[str, ...] = SEED) -> ToxicityModel:
    """Lexicon and weights from labelled texts; without labelled texts of both kinds, the seed with its default weights."""
    model = ToxicityModel(learn_lexicon([distinct_words(t) for t in texts], labels, seed))
    if texts and len(set(labels)) > 1:
        model.weights = learn_weights([model.features(t) for t in texts], labels)
    return model


def distinct_words(text: str) -> str:
    """The distinct folded words of a text, in order, between single spaces."""
    return " ".join(sorted(set(fold(text).split())))


def _words_column(text: str) -> Column:
    @F.arrow_udf("string")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([distinct_words(t.as_py() or "") for t in texts], pa.string())

    return distinct(text)


def _features_column(model: ToxicityModel, text: str) -> Column:
    @F.arrow_udf("struct<x:double,y:double>")
    def features(texts: pa.Array) -> pa.Array:
        found = [model.features(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], ["x", "y"])

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> ToxicityModel:
    """A model of the rows of `labels` that `train` (on the id) selects, and their texts.

    The sample is bounded: the labelled ids of smallest hash, `toxic_texts` toxic and `clean_texts` clean ones. Their
    distinct words come to the driver, and two features of each; their texts stay on the executors.
    """
    known = labels.filter(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    known = known.withColumn("_h", F.xxhash64(id_col))
    cuts = sample_cuts(known, "_y", "_h", {1: toxic_texts, 0: clean_texts})
    chosen = F.lit(False)
    for y, cut in cuts.items():
        chosen = chosen | ((F.col("_y") == y) & (F.col("_h") <= cut))
    found = {r[0]: int(r[1]) for r in known.filter(chosen).select(id_col, "_y").collect()}
    model = ToxicityModel({f" {w} ": 3.0 for w in SEED})
    if len(set(found.values())) < 2:
        return model
    # at most toxic_texts + clean_texts ids
    sample = docs.filter(F.col(id_col).isin(list(found))).groupBy(F.col(id_col).alias("_i")).agg(F.min(text_col).alias("_t"))
    sample = materialize(sample, "labelled")
    words = dict(sample.select("_i", _words_column("_t")).collect())
    ids = sorted(words)
    y = [found[i] for i in ids]
    if len(set(y)) < 2:
        return model
    model.lexicon = learn_lexicon([words[i] for i in ids], y)
    features = {r[0]: (r[1], r[2]) for r in sample.select("_i", _features_column(model, "_t").alias("f")).select("_i", "f.x", "f.y").collect()}
    model.weights = learn_weights([features[i] for i in ids], y)
    return model


def score_column(model: ToxicityModel, text: Column | str) -> Column:
    """Score in [0, 1] of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return score(text)
