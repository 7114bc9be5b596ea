"""Ordered packing: ids of the library, every id once and in order, and cuts as cheap as those of plain dynamic programming."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from tracewell.llm import entry
from tracewell.llm import ordered_packing as op
from tracewell.llm.vocab import english_path

SF = "/root/testdata/sf0.001"
TYPES = dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(english_path())


@pytest.fixture(scope="module")
def encoder():
    with open(english_path(), encoding="utf-8") as f:
        return op.Encoder(f.read())


def check(rows, texts, library, window=1024):
    """texts: list of (id, text); rows as the operator gives them."""
    ids = {}
    for i, t in texts:
        data = np.array([*library.encode(t or "", add_special_tokens=False).ids, op.SEPARATOR], "<u4")
        ids.setdefault(i, []).append(data)
    loads, own = {}, {}
    for r in rows:
        loads.setdefault(r[5], []).append((r[6], r[2]))
        own.setdefault(r[0], []).append(r)
    for pieces in loads.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= window
    assert own.keys() == ids.keys()
    for i, copies in ids.items():
        want = {}
        for data in copies:
            want[zlib.crc32(data.tobytes()), len(data)] = want.get((zlib.crc32(data.tobytes()), len(data)), 0) + 1
        assert {r[4] for r in own[i]} == {len(d) for d in copies} and sum(r[2] for r in own[i]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(own[i], key=lambda r: r[1]):
                assert r[1] == at and r[2] > 0 and r[3] == zlib.crc32(copies[0][at : at + r[2]].tobytes())
                at += r[2]
            assert at == len(copies[0])
    sizes = [sum(n for _, n in p) for p in loads.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes) / sum(sizes)


def brute_cost(at, penalties, window, opening):
    best = [0]
    for i in range(1, len(at)):
        options = ((at[i] - at[j], best[j]) for j in range(i) if at[i] - at[j] <= window)
        best.append(min(c + (0 if n & (n - 1) == 0 else window - n) for n, c in options) + penalties[i - 1] + opening)
    return best[-1]


def test_cuts_cost_the_least():
    rnd = random.Random(3)
    for _ in range(400):
        window, at, penalties = rnd.choice([1, 4, 8, 11, 16]), [0], []
        for _ in range(rnd.randint(1, 40)):
            at.append(at[-1] + rnd.randint(1, min(window, 5)))
            penalties.append(rnd.choice([0, 1, 4]))
        cuts, way, k = op.Cuts(window, 1), [], 0
        while k < len(penalties):
            m = rnd.randint(1, 6)
            cuts.extend(np.array(at[1 + k : 1 + k + m]), np.array(penalties[k : k + m]))
            k += m
            way += cuts.settled() if rnd.random() < 0.5 else []
        way += cuts.finish()
        spent = sum((0 if n & (n - 1) == 0 else window - n) + 1 + penalties[at.index(b) - 1] for a, b in zip([0, *way], way, strict=False) for n in [b - a])
        assert way[-1] == at[-1] and spent == brute_cost(at, penalties, window, 1)


def test_ids_are_the_librarys(encoder, library):
    rnd = random.Random(4)
    letters = "ab c'sdt\n\t\r .,!?é’“”…0189½ªº\xa0\xad\x85\x1cſĿ€" + "日本нет 　🙂"
    for k in range(6000):
        text = "".join(rnd.choice(letters[: 34 if k % 2 else None]) for _ in range(rnd.randint(0, 24))) + rnd.choice(["", "", "<|endoftext|>x"])
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in ["word " * 3000 + "x" * 5000 + "  \n\n y" * 400, "no\x1cspace" * 900, "", " "]:
        parts = list(op.slices(text, 100))
        assert "".join(parts) == text
        assert np.concatenate([encoder.ids(p) for p in parts]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library):
    df = entry.queries()["op12_ordered_packing"](spark, SF)
    assert dict(df.dtypes) == TYPES
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert check(df.collect(), texts, library) < 0.02


def test_hard_rows(spark, hard_docs, hard_rows, library):
    rows = hard_docs.selectExpr("*", "1 as offset", "'x' as part", "2L as id")
    got = op.pack_in_order(rows, english_path()).collect()
    assert check(got, hard_rows, library) < 0.5


def test_empty(spark, no_docs):
    df = op.pack_in_order(no_docs, english_path())
    assert dict(df.dtypes) == TYPES and df.collect() == []


def test_order_is_kept_and_memory_bounded(encoder, library):
    """Uniform documents, whose cheapest ways never meet, are settled all the same; documents follow one another."""
    text = " ".join(["word"] * 340)  # 341 ids with the separator: two fit, three don't
    packer = op.Packer(encoder, 5 << 33, held=2000, most=20_000)
    held = 0
    for i in range(400):
        packer.add(i, text)
        held = max(held, packer.end - packer.begin)
    packer.finish()
    assert held < 25_000
    assert [r[0] for r in packer.rows] == sorted(r[0] for r in packer.rows) and packer.rows[0][5] == 5 << 33
    check(packer.rows, [(i, text) for i in range(400)], library)


def test_one_long_text(encoder, library):
    text = "word " * 40_000 + "x" * 3000 + ". One more. " * 2000
    packer = op.Packer(encoder, 0, held=4000)
    packer.add(7, text)
    packer.add(8, None or "")
    packer.finish()
    assert check(packer.rows, [(7, text), (8, None)], library) < 0.01
