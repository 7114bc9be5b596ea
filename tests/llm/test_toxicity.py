"""Toxicity: matching against a plain scan, features and learning against plain versions, odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.llm import toxicity
from tracewell.llm.toxicity import ToxicityModel, fold, learn_lexicon, outside, stems_of


def plain_matches(model, folded):
    """Every place of every pattern, without those inside an exception phrase."""
    find = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(i, i + len(e) + 2) for e in model.exceptions for i in find(f" {e} ")]
    found = [(i, i + len(p), w) for p, w in model.lexicon.items() for i in find(p)]
    return sorted(m for m in found if not any(b <= m[0] and m[1] <= e for b, e in spared))


def test_matches_against_plain_scan():
    rnd = random.Random(2)
    words = ["idiot", "idi", "clown", "fish", "fool", "proof", "trash", "can", "cann", "x"]
    for _ in range(200):
        lexicon = {f" {w}" + rnd.choice(["", " "]): float(rnd.randint(1, 8)) for w in rnd.sample(words, 5)}
        model = ToxicityModel(lexicon, exceptions=("clown fish", "trash can", "fish clown fish", "fool proof"))
        text = fold(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))))
        assert sorted(model.matches(text)) == plain_matches(model, text)


def test_outside_is_one_sweep():
    assert outside([(0, 5, 1.0), (3, 9, 2.0), (4, 6, 3.0)], [(3, 7, None), (4, 8, None)]) == [(0, 5, 1.0), (3, 9, 2.0)]
    model = ToxicityModel({" clown ": 1.0})
    began = time.perf_counter()
    model.score("clown fish clown " * 100_000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text", ["id​iot", "i­diot", "﻿idiot", "ïdiot", "1d​i0t", "1d⁠!ot", "ＩＤＩＯＴ", "ιdιот"])
def test_invisible_and_lookalike_characters(text):
    assert ToxicityModel({" idiot ": 1.0}).matches(fold(text))


def test_stems():
    assert stems_of(["abcdex", "abcdey", "abcdez", "abcd", "abq", "zzzz", "zzzzz"]) == {"abcd", "abcde", "zzzz"}


def test_patterns_of_any_length():
    """Words and beginnings that tell toxic texts apart are found whatever their length."""
    rnd = random.Random(7)
    say = lambda: [f"w{rnd.randint(0, 300)}" for _ in range(30)]
    long, stem = "q" * 90, "wordthatisverylong"
    texts, labels = [], []
    for i in range(300):
        kind = i % 6
        texts.append(" ".join(set(say() + ([long] if kind == 0 else [stem + f"x{i}"] if kind == 1 else ["z"] if kind == 2 else []))))
        labels.append(int(kind < 3))
    lexicon = learn_lexicon(texts, labels)
    assert f" {long} " in lexicon or any(long.startswith(p[1:]) for p in lexicon)
    assert any((stem + "x").startswith(p[1:]) and len(p) > 4 for p in lexicon) and " z " in lexicon
    # weights are log odds of the shares of texts
    counts = sum("z" in t.split() for t in texts), sum("z" in t.split() for t, y in zip(texts, labels, strict=True) if not y)
    import math

    assert lexicon[" z "] == pytest.approx(min(8.0, math.log((counts[0] + 0.5) / 151) - math.log(0.5 / 151)))


def test_fit_equals_learning_on_the_texts(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("aa bb cc dd ee ff".split()) for _ in range(20)) + (" vilest thing" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(4, "zz"), (None, "a vilest thing"), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, 0), (None, 1), (7, None), (900, 0), (901, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    texts = {**dict(rows), 900: "", 901: ""}
    want = toxicity.learn([texts[i] for i in sorted(texts)], [int(i < 400 and i % 4 == 0) for i in sorted(texts)])
    assert (model.lexicon, model.weights) == (want.lexicon, pytest.approx(want.weights))
    scored = docs.select("doc_id", "text", toxicity.score_column(model, "text").alias("s")).collect()
    assert len(scored) == 404 and all((r.s >= 0.5) == ("vilest" in (r.text or "")) for r in scored)
