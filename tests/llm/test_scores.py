"""Every value of the learned queries against plain versions that use the fitted parameters only."""

import math

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.test_toxicity import plain_matches
from tracewell.llm import entry, lang_id, toxicity
from tracewell.llm.common import digest_bucket

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def plain_toxicity(model, text):
    folded = toxicity.fold(text or "")
    best = {}
    for begin, _, weight in plain_matches(model, folded):
        best[begin] = max(weight, best.get(begin, 0.0))
    total = sum(best.values())
    z = model.weights[0] + model.weights[1] * math.log1p(total) + model.weights[2] * math.log1p(100 * total / max(folded.count(" ") - 1, 1))
    return 1 / (1 + math.exp(-z))


def test_op1_scores(spark, docs, texts):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), digest_bucket(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in entry.op1_toxicity(spark, SF).collect()}
    assert got.keys() == texts.keys()
    short = sorted(texts, key=lambda i: len(texts[i] or ""))[:150]  # the plain scan is quadratic in a text
    for i in short:
        want = plain_toxicity(model, texts[i])
        assert got[i].score == pytest.approx(want, rel=1e-9) and got[i].predicted == int(want >= 0.5)


def test_op1_odd_rows(spark, hard_docs, hard_rows, no_docs):
    model = toxicity.ToxicityModel({" the ": 1.0, " onew": 2.0})
    rows = hard_docs.select("doc_id", "text", toxicity.score_column(model, "text").alias("s")).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.s)
    assert len(rows) == len(hard_rows) and all(len(s) == 1 for s in by_text.values())
    assert by_text[None] == by_text[""]
    for t, s in by_text.items():
        if len(t or "") < 3000:
            assert next(iter(s)) == pytest.approx(plain_toxicity(model, t), rel=1e-9)
    assert no_docs.select(toxicity.score_column(model, "text")).collect() == []


class PlainLanguage:
    """Sums over all segmentations of a word in logarithms, one position after the other."""

    def __init__(self, model, pieces):
        self.model, self.number, self.longest, self.known = model, {p: i for i, p in enumerate(pieces, 2)}, max(map(len, pieces)), {}

    def word(self, word):
        if word not in self.known:
            text, out = "▁" + word, []
            for j in range(len(self.model.languages)):
                at = [0.0] + [-math.inf] * len(text)
                for i in range(1, len(text) + 1):
                    parts = []
                    for k in range(1, min(i, self.longest) + 1):
                        n = self.number.get(text[i - k : i], 1 if k == 1 else 0)
                        if n:
                            parts.append(at[i - k] + math.log(self.model.probs[n, j]))
                    top = max(parts)
                    at[i] = top + math.log(sum(math.exp(p - top) for p in parts))
                out.append(at[-1])
            self.known[word] = out
        return self.known[word]

    def predict(self, text):
        words = [w for w in regex.split(r"[^\p{L}]+", (text or "").lower()) if w]
        if not words:
            return "und", 0.0
        total = [math.log(p) + sum(self.word(w)[j] for w in words) for j, p in enumerate(self.model.prior)]
        best = max(range(len(total)), key=total.__getitem__)
        return self.model.languages[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_op6_predictions(spark, docs, texts):
    model = lang_id.fit(docs, digest_bucket(F.col("doc_id"), 4) != 2)
    plain = PlainLanguage(model, lang_id.public_pieces())
    got = {r.doc_id: r for r in entry.op6_lang_id(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:120]:
        lang, score = plain.predict(texts[i])
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-6)


def test_op6_long_texts_and_slices(spark, hard_docs, docs):
    """Texts of megabytes are slices of their own; a batch of short and long texts gives what each gives alone."""
    import pyarrow as pa

    model = lang_id.fit(docs, digest_bucket(F.col("doc_id"), 4) != 2)
    rows = [(1, "the words " * 300_000), (2, "und so weiter " * 200_000), (3, None), (4, "x"), (5, "1234 " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: tuple(r.p) for r in df.select("doc_id", lang_id.language_column(model, "text").alias("p")).collect()}
    for i, text in rows:
        (lang,), (score,) = model.score(pa.array([text], pa.string()))
        assert got[i] == (lang, pytest.approx(score))
