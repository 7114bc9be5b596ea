"""Operators on single documents: exact round trips, brute force and held-out accuracy."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import byte_bpe, entry, lang_id, main_text, packing, token_counts, toxicity, transport_stream
from tracewell.llm.vocab import byte_ranks, multi_path, pretoken_pattern

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_ranks(multi_path())


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.ByteBpe(ranks, pretoken_pattern())


def test_bpe_equals_library(codec, ranks, hard_rows):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pretoken_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for _, t in hard_rows] + ["  a  b\n\n c 's it's", "日本語 🙂 ı x", "\x00 \x1c\x85 y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, " x\n y \t z"]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_columns(codec, hard_docs):
    both = hard_docs.select("text", byte_bpe.encode_column(codec, "text", "t").alias("e")).select("text", "e.*", byte_bpe.decode_column(codec, "e.ids", "t").alias("back"), byte_bpe.round_trip_column(codec, "text", "t").alias("d"))
    for r in both.collect():
        assert r.back == (r.text or "").encode() and r.n_tokens * 4 == len(r.ids)
        assert (r.d.ids_sha256, r.d.decoded_sha256) == (hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.back).hexdigest())


def test_perfect_hash(ranks):
    keys = list(ranks)[:5000]
    h = byte_bpe.PerfectHash(keys)
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [keys[i] for i in h.key_at[slots]] == keys


def test_longest_match(ranks, hard_rows):
    automaton = token_counts.LongestMatch(list(ranks))

    def brute(word):
        rest, n = b" " + word, 0
        while rest:
            k = next(k for k in range(len(rest), 0, -1) if rest[:k] in ranks and (rest[:1] == b" ") == (n == 0))
            rest, n = rest[k:], n + 1
        return n

    for _, text in hard_rows:
        words = (text or "").encode().split()
        assert automaton.count_text((text or "").encode()) == (len(words), sum(map(brute, words)))


def test_transport_stream(hard_rows):
    for n in (0, 1, 64, 182, 183, 184, 365, 366, 367, 368, 31_999, 32_000, 32_001, 1_100_000):
        data = os.urandom(n)
        parsed = transport_stream.parse(transport_stream.mux(data))
        (s,) = parsed.streams
        assert (s.data, s.gaps, s.duplicates, parsed.bad_tables) == (data, 0, 0, 0)
        assert len(s.pts) == len(s.random_access) == s.units == math.ceil(n / transport_stream.UNIT)
    media = transport_stream.mux(os.urandom(5000))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert transport_stream.parse(b"".join(packets[:6] + packets[7:])).streams[0].gaps == 1
    twice = transport_stream.parse(b"".join(packets[:6] + packets[5:])).streams[0]
    assert twice.duplicates == 1 and twice.data == transport_stream.parse(media).streams[0].data
    broken = bytearray(media)
    broken[15] ^= 1
    assert transport_stream.parse(bytes(broken)).bad_tables == 1
    with pytest.raises(ValueError):
        transport_stream.parse(media[:-1])


def test_media_columns(hard_docs):
    rows = hard_docs.select("text", transport_stream.digest_column("text").alias("m"), transport_stream.parse_column(transport_stream.mux_column(F.encode("text", "UTF-8"))).alias("s")).collect()
    for r in rows:
        data = (r.text or "").encode()
        payload = transport_stream.payload_of(data)
        assert len(payload) % 64 == 0 and payload
        assert (r.m.n_bytes, r.m.payload_bytes, r.m.payload_sha256, r.m.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.s is None if r.text is None else bytes(r.s[0].data) == data


def test_top_k_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = {tuple(r) for r in con.sql(entry.oracle_sql()["op3_exact_topk"]).fetchall()}
    got = entry.op3_exact_topk(spark, SF)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == {(q, r, v, s) for q, r, v, s in want}


def test_packing(hard_docs, hard_rows):
    sizes = (64, 128, 512)
    got = packing.pack_documents(hard_docs, capacities=sizes, shard_pieces=40).collect()
    pieces, loads = Counter(), Counter()
    for r in got:
        pieces[r.doc_id] += r.length
        loads[r.bin, r.bin_capacity] += r.length
    want = Counter()
    for i, t in hard_rows:
        want[i] += len((t or "").encode()) + 1
    assert pieces == want
    for (_, capacity), load in loads.items():
        assert load <= capacity and not any(load <= c < capacity for c in sizes)
    for _, group in itertools.groupby(sorted((r.bin, r.bin_offset, r.length) for r in got), key=lambda x: x[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length


def test_packing_cost():
    bins, final, cost = packing.pack([60, 40, 30, 30, 20, 20], (100, 200), float)
    assert (sorted(final), cost) == ([200], 200.0) or (sorted(final), cost) == ([100, 100], 200.0)
    assert packing.pack([], (8,), float) == ([], [], 0.0)
    with pytest.raises(ValueError):
        packing.pack([9], (8,), float)


def test_forward_sums_all_segmentations():
    model = lang_id.learn({"a": lang_id.word_counts(["banana bandana ban"]), "b": lang_id.word_counts(["cab bac abc"])}, {"a": 1, "b": 1}, ["▁b", "▁", "a", "n", "an", "b", "na", "▁ba", "ana", "c", "d"], rounds=2)
    pieces = {"▁b": 2, "▁": 3, "a": 4, "n": 5, "an": 6, "b": 7, "na": 8, "▁ba": 9, "ana": 10, "c": 11, "d": 12}
    for word in ("banana", "cab", "x", "nana"):
        text = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            parts.append(text[last:])
            ids = [pieces.get(p, 1 if len(p) == 1 else 0) for p in parts]
            if all(ids):
                total += np.prod(model.probs[ids], axis=0)
        assert np.allclose(model.word_scores(pa.array([word]))[0], np.log(total))


def test_language_held_out(spark):
    got = entry.op6_lang_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard_rows(hard_docs, no_docs):
    model = lang_id.fit(hard_docs, F.lit(True))
    for r in hard_docs.select("text", lang_id.language_column(model, "text").alias("p")).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert r.p.lang == ("en" if letters else "und")
    assert lang_id.fit(no_docs, F.lit(True)).score(pa.array(["abc", None])) == (["und", "und"], [0.0, 0.0])
    long = lang_id.fit(hard_docs, F.lit(True)).score(pa.array(["x" * 1000]))
    assert long[0] == ["en"]


def test_toxicity_folding_and_exceptions():
    model = toxicity.ToxicityModel({" idiot ": 3.0, " clown ": 3.0})
    assert toxicity.fold("1D10T! сlоwn; ｃｌｏｗｎ") == " idiot clown clown "
    assert [w for *_, w in model.matches(toxicity.fold("an 1d!ot and a clown"))] == [3.0, 3.0]
    assert model.matches(toxicity.fold("a clown fish")) == []
    assert model.score("a clown") > model.score("a clown " + "word " * 500) > model.score("a clown fish") == model.score("")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert not any(r.predicted and not r.toxic for r in held)


def test_toxicity_without_labels(hard_docs, no_docs):
    model = toxicity.fit(hard_docs, no_docs.selectExpr("doc_id", "n_chars as toxic"), F.lit(True))
    assert hard_docs.select(toxicity.score_column(model, "text").alias("x")).filter("x >= 0.5").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>"</script></head><body><header>Site name and a long slogan that is no article at all, really not</header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, and tell you so at great length every time you come here.</div>
<article><header><h1>Head&amp;line</h1></header><p>First   paragraph with <b>bold</b><br>text that runs on for a while, as paragraphs in articles do.<p>Short.
<div class="ad">Buy this very good thing now, it is on sale and will not be for much longer than today.</div><p>Last paragraph, which also has a number of words in it, so that it is text.</p>
<div id="comments"><p>I, a reader, disagree with all of this and say so in many words under the article.</p></div></article><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == (
        "Head&line\nFirst paragraph with bold text that runs on for a while, as paragraphs in articles do.\nShort.\nLast paragraph, which also has a number of words in it, so that it is text."
    )
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>Head&amp;line</h1></header>", "")
    assert main_text.main_text(plain).startswith("First paragraph") and "cookies" not in main_text.main_text(plain) and "disagree" not in main_text.main_text(plain)
    assert [main_text.main_text(x) for x in ("", "<p></p>", "<p>a &lt; b<p>c", "<script>x", "text", "<a href='x")] == ["", "", "a < b\nc", "", "text", ""]


def test_stretches():
    # the line of 3 is apart from the surge, as lines without weight lie between
    assert main_text.stretches([0, 3, 0, 0, 100, 50, 90, 0, 0, 0, 4]) == [(4, 7)]
    assert main_text.stretches([0, 3, 2, 100, 50, 90, 0, 0, 0, 4]) == [(1, 6)]
    assert main_text.stretches([5, 5]) == []


def test_main_text_column(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, PAGE * 50, "u")], "page_id long, html string, text string")
    rows = df.select("page_id", main_text.main_text_column("html").alias("text")).orderBy("page_id").collect()
    assert [r.text == "" for r in rows] == [True, True, False]
