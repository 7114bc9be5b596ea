"""Each registered query over its whole table at the smallest scale: names, types, and every value against a plain version."""

import hashlib
import itertools
import re
import zlib

import duckdb
import pytest

from tests.llm.test_pairs import brute_components, brute_repeats
from tests.llm.test_passages import brute_passages
from tracewell.llm import entry, packing
from tracewell.llm.vocab import byte_ranks, multi_path, pretoken_pattern

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def run(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    return dict(df.dtypes), {r.doc_id: r for r in rows}, rows


def test_all_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries()] == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "modulus", "held"), [("op1_toxicity", 5, 0), ("op6_lang_id", 4, 2)])
def test_splits(spark, docs, name, modulus, held):
    types, got, rows = run(spark, name)
    wanted = {"op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "op6_lang_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}}
    assert types == wanted[name] and len(rows) == len(docs) and got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r.score <= 1


def test_op2(spark, docs):
    types, got, rows = run(spark, "op2_media_ts")
    assert len(rows) == len(docs) and (types["n_bytes"], types["payload_bytes"], types["tail_crc32"], types["media_bytes"], types["feature"]) == ("bigint", "bigint", "bigint", "bigint", "string")
    for i, t in docs.items():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and len(r.media_sha256) == 64


def plain_best_fit(lengths, sizes, cost, free):
    """Best fit as its definition says, looking through all open bins for each piece."""
    ordered = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left, bins, opened = sum(lengths), [], []
    for i in ordered:
        n = lengths[i]
        left -= n
        fitting = [(room, -b) for b, room in enumerate(bins) if room >= n]
        if fitting:
            room, b = min(fitting)
            bins[-b] = room - n
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: ((cost(c) if c in free else cost(c) * 1e9) / min(c, n + left), -c))
            opened.append(c)
            bins.append(c - n)
    loads = [c - room for c, room in zip(opened, bins, strict=True)]
    return sum(cost(min(c for c in sizes if c >= x)) for x in loads)


def test_op4(spark, docs):
    types, _, rows = run(spark, "op4_packing")
    assert types["bin"] == "bigint" and types["length"] == "int"
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.begin, r.length))
    for i, t in docs.items():
        total, most = len((t or "").encode()) + 1, max(packing.CAPACITIES)
        assert sorted(pieces[i]) == [(k, at, min(most, total - at)) for k, at in enumerate(range(0, total, most))]
    loads: dict = {}
    for r in rows:
        loads.setdefault((r.bin, r.bin_capacity), []).append((r.bin_offset, r.length))
    cost = sum(packing.attention_cost(c) for _, c in loads)
    for (_, c), own in loads.items():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
        assert min(s for s in packing.CAPACITIES if s >= sum(n for _, n in own)) == c
    lengths = [r.length for r in rows]
    plain = min(plain_best_fit(lengths, packing.CAPACITIES, packing.attention_cost, free) for k in range(1, 6) for free in itertools.combinations(packing.CAPACITIES, k))
    lowest = sum(lengths) * min(packing.attention_cost(c) / c for c in packing.CAPACITIES)
    assert cost == pytest.approx(plain, rel=0.01) and lowest <= cost < 1.25 * lowest


def test_packing_against_optimum():
    """Of a few pieces, the packing costs at most a quarter more than the best of all partitions into bins, and 3 percent on average."""
    import random

    def partitions(rest):
        if not rest:
            yield []
            return
        for p in partitions(rest[1:]):
            yield [[rest[0]], *p]
            for k in range(len(p)):
                yield [*p[:k], [rest[0], *p[k]], *p[k + 1 :]]

    rnd, sizes, ratios = random.Random(1), (8, 16, 40), []
    for _ in range(60):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 7))]
        cost = lambda c: c * (1 + c / 100)
        best = min(sum(cost(min(s for s in sizes if s >= sum(b))) for b in p) for p in partitions(lengths) if all(sum(b) <= sizes[-1] for b in p))
        ratios.append(packing.pack(lengths, sizes, cost)[2] / best)
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.25 and sum(ratios) / len(ratios) <= 1.03


def test_a_further_length_never_costs_more():
    import random

    rnd = random.Random(6)
    for trial in range(40):
        sizes = sorted(rnd.sample(range(1, 60), rnd.randint(1, 8)))
        lengths = [rnd.randint(1, sizes[-1]) for _ in range(rnd.randint(1, 60))]
        more = sorted({*sizes, *rnd.sample(range(1, 90), rnd.randint(1, 3))})
        cost = lambda c: c * (1 + c / 100)
        assert packing.pack(lengths, more, cost)[2] <= packing.pack(lengths, sizes, cost)[2] + 1e-9, trial


def test_op5(spark, docs):
    ranks = byte_ranks(multi_path())
    types, got, rows = run(spark, "op5_token_counts")
    assert types == {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"} and len(rows) == len(docs)
    known: dict = {}

    def brute(word):
        rest, n = b" " + word, 0
        while rest:
            k = next(k for k in range(len(rest), 0, -1) if rest[:k] in ranks and (rest[:1] == b" ") == (n == 0))
            rest, n = rest[k:], n + 1
        return n

    for i, t in docs.items():
        words = (t or "").encode().split()
        for w in set(words) - known.keys():
            known[w] = brute(w)
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(known[w] for w in words))


def test_op7(spark, docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pretoken_pattern(), mergeable_ranks=byte_ranks(multi_path()), special_tokens={})
    types, got, rows = run(spark, "op7_byte_bpe")
    assert types == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} and len(rows) == len(docs)
    for i, t in docs.items():
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op8(spark, docs):
    types, got, rows = run(spark, "op8_jaccard_join")
    want, sizes = brute_components(docs.items())
    assert types == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"} and len(rows) == len(docs)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (sizes[i], want[i]) for i in docs}


def test_op10(spark, docs):
    types, got, rows = run(spark, "op10_suffix_dedup")
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "n_passage_bytes": "bigint"} and len(rows) == len(docs)
    texts = [(t or "").encode() for t in docs.values()]
    passages = brute_passages(texts, 10**6, entry.PASSAGE_WORDS)
    for i, t, kept, rest in zip(docs, texts, brute_repeats(texts, 400), passages, strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, r.n_passage_bytes) == (len(t), len(t) - len(kept), hashlib.sha256(kept).hexdigest(), len(t) - len(rest))
        assert (r.n_spans > 0) == (r.n_removed > 0)
