"""Passages of over 50 words that repeat, against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.conftest import WORDS
from tracewell.llm.suffix_dedup import remove_repeats


def brute_passages(texts, length, words):
    """The texts without strings of `length` bytes and passages of so many words that are at two places."""
    at = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    found = [[(m.start(), m[0].lower()) for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", t)] for t in texts]
    runs = Counter(tuple(w for _, w in f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    out = []
    for t, f in zip(texts, found, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for i in range(len(f) - words + 1):
            if runs[tuple(w for _, w in f[i : i + words])] > 1:
                begin, end = f[i][0] if i else 0, f[i + words][0] if i + words < len(f) else len(t)
                gone[begin:end] = b"\1" * (end - begin)
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.fixture(scope="module")
def rows():
    """Texts of short words that share 49 to 55 of them, at the begin, in the middle and at the end, with other white space and letter case."""
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice(WORDS)[:4] + rnd.choice(["", "s"]) for _ in range(n))
    out = []
    for k in range(49, 56):
        shared = say(k)
        out += [say(40) + " " + shared + " " + say(30), shared.replace(" ", "\n", 3).upper() + "  " + say(60), say(9) + "\t" + shared + " \n"]
    out += ["\n" + out[-1].split("\t")[1], "a " * 52, "b " * 51, None, "", " \n", "ünï " * 60 + say(30)]
    common = say(51)
    out += [say(rnd.randint(0, 70)) + " " + common + " " + say(5) for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [20_000, 5])
def test_passages_of_words_go(spark, rows, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [(t or "").encode() for _, t in rows]
    want = dict(zip((i for i, _ in rows), brute_passages(texts, 400, 51), strict=True))
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, words=51, hot=hot).collect()} == want


def test_passages_are_counted(spark, rows):
    """Marked passages stay and are counted; the strings of 400 bytes go as without them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [(t or "").encode() for _, t in rows]
    strings, both, alone = (dict(zip((i for i, _ in rows), brute_passages(texts, n, w), strict=True)) for n, w in ((400, 10**6), (400, 51), (10**6, 51)))
    got = {r.doc_id: (bytes(r.kept), r.n_passage) for r in remove_repeats(docs, words=51, mark_words=True).collect()}
    assert got == {i: (strings[i], len((t or "").encode()) - len(alone[i])) for i, t in rows} and both != strings


def test_pipeline_takes_short_words(spark, rows):
    """A passage of 51 words under 400 bytes goes from all texts, one of 50 words from none."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in cp.repeats(spark, docs, "").collect()}
    assert left == {i: t.decode() for (i, _), t in zip(rows, brute_passages([(t or "").encode() for _, t in rows], 400, 51), strict=True) if t}
    assert left[3] == rows[3][1] and len(left[6].split()) <= 70


def test_pipeline_on_its_own_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    want = dict(zip(texts, brute_passages(list(texts.values()), 400, cp.PASSAGE_WORDS), strict=True))
    got = {r.doc_id: r.text for r in cp.repeats(spark, docs, "").collect()}
    assert got == {i: s for i, t in want.items() if (s := t.decode("utf-8", "ignore"))}
