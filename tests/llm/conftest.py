import random

import pytest

WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out".split()


@pytest.fixture(scope="session")
def hard_rows():
    """Texts with nulls, empty and very long ones, ties, copies, near copies and shared passages; (id, text)."""
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing"]) for _ in range(n))
    passage, long = say(120), say(6000)
    base = say(150)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, "ONE two three four"), (6, long), (7, long), (None, base)]
    rows += [(10 + i, base if i < 5 else base.replace(" the ", f" x{i} ", 1)) for i in range(20)]
    rows += [(40 + i, say(30) + " " + passage + " " + say(30 + i)) for i in range(15)]
    rows += [(60 + i, say(rnd.randint(1, 12))) for i in range(30)]
    rows += [(100, "a b c d e f g h i"), (101, "a b c d e f g h j"), (102, "b c d e f g h i"), (103, "ünï cödé " * 80), (104, "ünï cödé " * 81)]
    rows += [(105, "same"), (105, "same"), (106, "x" * 900)]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The rows with columns whose names clash with those of results."""
    rows = [(i, t, "en", "s", 1, "extra", 0.5) for i, t in hard_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
