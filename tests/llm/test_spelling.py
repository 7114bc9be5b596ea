"""Spelling variants against comparing all words by deletion sets, and automata against plain lists."""

import random
import re
import zlib

import duckdb
import pytest

from tracewell.llm import entry, spelling

SF = "/root/testdata/sf0.001"
TYPES = {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    n = {}
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if k >= 2}


def brute_variants(n):
    replaced, near = {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            replaced.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in replaced.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def hard_texts():
    rnd = random.Random(8)
    stems = ["aaaaaaa", "aaaaaaaa", "aaabaaa", "organise", "ORGANIZE", "colourful", "éàüößÿþ", "straßenbahn", "zzzzzzz" * 40, "same×mark"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rnd.choice(stems)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abzéß") + w[k:], w[:k] + rnd.choice("abzéß") + w[k + 1 :]])
            words.append(w)
        rows.append((rnd.choice([i, i, None]), rnd.choice([" ", ", ", "\n", "1"]).join(words)))
    return [*rows, (1, None), (2, ""), (3, "1234 !"), (4, rows[0][1]), (4, rows[0][1])]


@pytest.mark.parametrize("group", [spelling.GROUP, 60])
def test_against_brute_force(spark, group):
    rows = hard_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "'y' as form").repartition(4)
    want = brute_variants(brute_words(rows))
    assert got(spelling.spelling_variants(df, group=group)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] is not None and r[1] != r[2] for r in want)


def test_one_ending_in_all_words(spark):
    """A third of the words, and more, with one ending and beginning: groups are cut, and no pair is lost."""
    rnd = random.Random(2)
    words = {"pre" + "".join(rnd.choice("abcd") for _ in range(rnd.choice([3, 4, 4]))) + "ing" for _ in range(900)}
    n = {w: rnd.choice([2, 3, 40, 500]) for w in words if len(w) >= 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {r[0]: (r[1], r[2], r[3]) for r in spelling.near_words(df, group=300).collect()}
    want = {r[0]: r[4] for r in brute_variants(n) if r[4]}
    assert {w: v[0] for w, v in found.items()} == want


def test_automaton_numbers_its_words():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(300)})
    a = spelling.Automaton([tuple(w) for w in words])
    for k, w in enumerate(words):
        state, number = a.follow(a.root, 0, w)
        assert a.final[state] and number == k
    assert a.words[a.root] == len(words) and len(a.edges) < sum(map(len, words)) / 3
    keys = {(f, *sorted(e.items())) for f, e in zip(a.final, a.edges, strict=True)}
    assert len(keys) == len(a.edges)  # minimal: no two states alike


def test_long_words(spark):
    a = "acgt" * 3000
    rows = [(i, f"{a} {a[:6000]}t{a[6000:]} {a[:100]}{a[101:]} {a}q") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_variants(df, group=3000)) == brute_variants(brute_words(rows))


def test_empty(spark, no_docs):
    df = spelling.spelling_variants(no_docs)
    assert dict(df.dtypes) == TYPES and df.collect() == []


def test_query(spark):
    df = entry.queries()["op11_spelling"](spark, SF)
    assert dict(df.dtypes) == TYPES
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert got(df) == brute_variants(brute_words(rows))
