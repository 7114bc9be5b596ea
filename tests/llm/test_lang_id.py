"""Language identification: long words and long pieces against plain forward sums, expectations against enumeration, rows that repeat."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import lang_id

PIECES = ["▁", "▁a", "a", "b", "ab", "abab", "bababababababababababababa", "▁abababababababababababababababababababab", "c"]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(3)
    say = lambda letters, n: ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(n)]
    texts = {"x": " ".join(say("aab", 60) + ["ab" * 30] * 5), "y": " ".join(say("bbc", 60) + ["a" * 300])}
    return lang_id.learn({k: lang_id.word_counts([t]) for k, t in texts.items()}, {"x": 2.0, "y": 1.0}, PIECES)


def log_sums(model, word):
    """Forward sums in logarithms, one position after the other."""
    number = {p: i for i, p in enumerate(PIECES, 2)}
    text = "▁" + word
    out = []
    for j in range(len(model.languages)):
        at = [0.0] + [-math.inf] * len(text)
        for i in range(1, len(text) + 1):
            parts = []
            for k in range(1, i + 1 if i < 60 else 60):
                piece = text[i - k : i]
                known = number.get(piece, 1 if k == 1 else 0)
                if known:
                    parts.append(at[i - k] + math.log(model.probs[known, j]))
            top = max(parts)
            at[i] = top + math.log(sum(math.exp(p - top) for p in parts))
        out.append(at[-1])
    return out


@pytest.mark.parametrize("word", ["a", "ab" * 20, "b" + "ab" * 500, "z" * 10_000, "ab" * 4000 + "q" * 100 + "c" * 900])
def test_long_words(model, word):
    assert model.word_scores(pa.array([word, word[: len(word) // 2 + 1]]))[0] == pytest.approx(log_sums(model, word), rel=1e-9)


def test_expected_counts(model):
    """Expected counts of each piece are those of all segmentations, weighted by probability; for a long word, their letters add up."""
    number = {p: i for i, p in enumerate(PIECES, 2)}
    for word in ("ababab", "zab", "cabab"):
        text = "▁" + word
        total, each = np.zeros(2), np.zeros((len(PIECES) + 2, 2))
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [0, *[i for i, c in enumerate(cuts, 1) if c], len(text)]
            ids = [number.get(text[a:b], 1 if b - a == 1 else 0) for a, b in itertools.pairwise(ends)]
            if all(ids):
                p = np.prod(model.probs[ids], axis=0)
                total += p
                for i in ids:
                    each[i] += p
        got = np.zeros_like(model.probs)
        ((_, codes),) = lang_id._by_length(pa.array([word]))
        lang_id._expect(model.probs, np.array([[1.0, 2.0]]), codes, lang_id._numbers(model.table, codes), got)
        assert got == pytest.approx(each / total * [1.0, 2.0])
    got = np.zeros_like(model.probs)
    ((_, codes),) = lang_id._by_length(pa.array(["ab" * 1500 + "z" * 400]))
    lang_id._expect(model.probs, np.array([[1.0, 1.0]]), codes, lang_id._numbers(model.table, codes), got)
    letters = np.array([0, 1, *map(len, PIECES)])
    assert (got * letters[:, None]).sum(0) == pytest.approx([3401, 3401])


def test_all_letter_pieces_of_the_vocabulary():
    pieces = lang_id.public_pieces()
    assert max(map(len, pieces)) > 12 and "▁afternoon" in pieces and lang_id.Pieces(pieces).longest == max(map(len, pieces))


def test_repeated_rows_and_null_ids(spark):
    """Rows that repeat an id, or have none, are sampled by their texts; the sample is bounded all the same."""
    rows = [(None, f"ein text nummer {chr(97 + i % 26)} und so weiter", "de") for i in range(200)] + [(1, "the same words of the text", "en")] * 500 + [(2, None, "en"), (3, "x" * 5000, "en"), (4, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.fit(docs, F.lit(True), texts_per_language=10)
    assert model.languages == ["de", "en"] and model.prior == pytest.approx([200 / 702, 502 / 702])
    assert model.score(pa.array(["und so weiter ein text", "the words of the text", "", None]))[0] == ["de", "en", "und", "und"]


def test_all_languages_in_blocks(spark, monkeypatch):
    """Every language is learned; working on them in blocks changes nothing."""
    say = ["ab cd", "the words", "und so weiter", "que la mesa"]
    rows = [(i, f"{say[i % 4]} {chr(97 + i % 23)}x", f"l{i % 37:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = lang_id.fit(docs, F.lit(True))
    assert len(whole.languages) == 37
    texts = pa.array([t for _, t, _ in rows] + ["", None, "x" * 3000])
    monkeypatch.setattr(lang_id, "LANGUAGE_BLOCK", 5)
    parts = lang_id.fit(docs, F.lit(True))
    assert np.allclose(whole.probs, parts.probs)
    (a, b), (c, d) = whole.score(texts), parts.score(texts)
    assert a == c and np.allclose(b, d)


def test_memory_with_a_thousand_languages():
    """The values of words, positions and languages are held for a block of languages at a time."""
    import tracemalloc

    rng = np.random.default_rng(1)
    pieces = lang_id.Pieces([chr(97 + i) for i in range(26)] + ["th", "he", "in", "er"])
    probs = rng.random((pieces.n, 1000))
    model = lang_id.LanguageModel([f"l{i}" for i in range(1000)], np.full(1000, 1e-3), pieces, probs / probs.sum(0))
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(5000)]
    tracemalloc.start()
    model.score(pa.array([" ".join(words[k::50]) for k in range(50)]))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_words_learned_from_are_bounded(spark):
    docs = spark.createDataFrame([(1, "aa aa aa bb bb cc", "x"), (2, "dd dd ee", "y")], "doc_id long, text string, lang string")
    one = lang_id.fit(docs, F.lit(True), words_per_language=1)
    assert np.allclose(one.probs, lang_id.learn({"x": {"aa": 3}, "y": {"dd": 2}}, {"x": 1.0, "y": 1.0}, lang_id.public_pieces()).probs)
