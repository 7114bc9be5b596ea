"""Stages of the pipeline on rows whose ids repeat or are missing."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.conftest import WORDS


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_duplicates_by_text_where_ids_fail(spark):
    say = lambda k: " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] for i in range(40))
    a, b, c, d = (say(k) + f" end{k}" for k in range(1, 5))
    rows = [(1, a), (2, a + " more"), (3, b), (3, c), (3, b), (None, d), (None, d), (None, c + " more"), (9, "x"), (10, None), (11, ""), (11, "")]
    got = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs_of(spark, rows), "").collect())
    # one of c and its near copy stays, whichever id it has; equal rows are one
    one = {(3, c), (None, c + " more")} & got.keys()
    assert len(one) == 1
    assert got - Counter(one) == Counter([(1, a), (3, b), (None, d), (9, "x"), (10, None), (11, "")])


def test_unique_ids_keep_the_smallest(spark):
    text = " ".join(WORDS)
    rows = [(7, text), (5, text + " x"), (8, "other words here to stay in the table"), (6, None)]
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs_of(spark, rows), "").collect()) == [5, 6, 8]


def test_language_and_clean_judge_each_row(spark):
    rows = [(1, " ".join(WORDS)), (1, "123"), (None, " ".join(WORDS[5:])), (None, None), (2, "")]
    assert Counter(r.doc_id for r in cp.language(spark, docs_of(spark, rows), "").collect()) == Counter([1, None])
    assert cp.clean(spark, docs_of(spark, rows), "/root/testdata/sf0.001").count() == 5
