"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_passages import brute_passages
from tracewell.llm import suffix_dedup
from tracewell.llm.components import connected_components
from tracewell.llm.jaccard import _bodies, jaccard_components, spanning_links
from tracewell.llm.shingles import shingle_sets
from tracewell.llm.suffix_dedup import all_anchors_of, anchors_of, common_prefix, merge_runs, remove_repeats, repeats, word_codes


def shingles(text, width=5):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in b"\t\n\x0b\x0c\r":
        low = low.replace(bytes([c]), b" ")
    w = [x for x in low.split(b" ") if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, percent=80):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}, {i: len(s) for i, s in sets}


def test_shingle_sets():
    texts = ["", " ", "a", "a b c d", "a b c d e", "A b C d e f", "a b c d e a b c d e"]
    _, bounds = shingle_sets([t.encode() for t in texts])
    assert [bounds[i + 1] - bounds[i] for i in range(len(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("full_list", [16, 2])
def test_jaccard_components(hard_docs, hard_rows, full_list):
    """With lists cut short, links must come from the second pass as well."""
    got = jaccard_components(hard_docs, full_list=full_list).collect()
    rows = [(i, t) for i, t in hard_rows if i is not None]
    want, sizes = brute_components(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in hard_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])


def test_jaccard_dense_random(spark):
    """Many sets near the threshold, of light and heavy sizes."""
    rnd = random.Random(3)
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 8, 9, 10, 12, 14, 30, 60]))] for _ in range(25)]
    rows = []
    for k in range(400):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 400)}"
        rows.append((k, " ".join(w[rnd.randint(0, 1) : len(w) - rnd.randint(0, 1)])))
    want, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), full_list=3).collect()}
    assert got == want


def near_group(n, seed, length=60, changes=6):
    """Copies of one text with some words changed: neighbours differ by more or less than a link allows."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(length)] = f"x{rnd.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("apart_only", [False, True])
def test_spanning_links(apart_only):
    """A block gives links that span what brute force finds, fewer than it has members."""
    rows = sorted(near_group(150, 4) + [(200 + i, t) for i, t in near_group(80, 5, 40, 3)], key=lambda r: len(shingles(r[1])))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
    bodies = [x.as_py() for b in _bodies(5)(iter([batch])) for x in b.column("body")]
    part = np.array([i % 7 if i < 20 else i for i, _ in rows])
    own = np.arange(len(rows)) % 2
    sets = [shingles(t) for _, t in rows]

    def groups(pairs):
        up = list(range(len(rows)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            up[max(root(x), root(y))] = min(root(x), root(y))
        return [root(x) for x in range(len(rows))]

    given = [(int(np.flatnonzero(part == part[x])[0]), x) for x in range(len(rows))]
    every = [(x, y) for y in range(len(rows)) for x in range(y) if (not apart_only or own[x] != own[y]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    found = spanning_links(bodies, part, own, apart_only, 80)
    assert set(found) <= set(every) and len(found) < len(rows)
    assert groups(found + given) == groups(every + given)


def test_jaccard_large_near_group(spark):
    """2,000 near copies in one list: components are those of brute force on the distinct sets, whatever the blocks."""
    rows = near_group(2000, 8)
    want, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == want


def test_jaccard_versions_of_one_id(spark):
    """Rows of one id and different texts share a component, and each text's links count."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rnd.randint(0, 99)) for _ in range(40)) for _ in range(12)]
    rows = [(7, t) for t in texts] + [(20 + i, t + " more") for i, t in enumerate(texts)] + [(None, texts[0])] * 3
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: None if i is None else 7 for i, _ in rows}


def test_jaccard_empty(no_docs):
    assert jaccard_components(no_docs).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (5, None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def brute_repeats(texts, length):
    at = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 100, 20_000), (60, 12, 5), (30, 30, 1), (400, 100, 1)])
def test_remove_repeats(hard_docs, hard_rows, length, gram, hot):
    """With a low limit, grams go the way of hot ones."""
    got = remove_repeats(hard_docs, length=length, gram=gram, hot=hot).collect()
    texts = [(t or "").encode() for _, t in hard_rows]
    want = Counter((i, hashlib.sha256(k).hexdigest(), len(t) - len(k)) for (i, _), t, k in zip(hard_rows, texts, brute_repeats(texts, length), strict=True))
    assert Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_removed) for r in got) == want
    for r in got:
        spans = [(s.begin, s.end) for s in r.spans]
        assert sum(e - b for b, e in spans) == r.n_removed and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_copies_of_one_row(spark):
    """Many equal rows, with and without id, cost in proportion to their number: all go, and so does what others share with them."""
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    copy, other = say(5000), say(3000)
    rows = [(1, copy)] * 1500 + [(None, other)] * 700 + [(2, say(300) + copy[1000:1700] + say(300)), (3, say(900)), (None, other[:399]), (1, say(800))]
    got = Counter((r.doc_id, r.n_removed, len(r.spans), len(r.kept)) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter({(1, 5000, 1, 0): 1500, (None, 3000, 1, 0): 700, (2, 700, 1, 600): 1, (3, 0, 0, 900): 1, (None, 0, 0, 399): 1, (1, 0, 0, 800): 1})


@pytest.mark.parametrize("scan", [100, 333, 5000])
def test_scan_in_slices(scan, monkeypatch):
    """Slices give every window the anchor that a scan of the whole text gives it, and words the same codes."""
    monkeypatch.setattr(suffix_dedup, "_thinned", lambda data, at, *_: np.ones(len(at), bool))
    rnd = random.Random(13)
    texts = [bytes(rnd.choice(b"ab c") for _ in range(n)) for n in (0, 59, 60, 61, 700, 2400)] + [b"x" * 400, b"a b " * 200]

    def windows(parts):
        return {(int(o), int(p) - d, int(h), int(p)) for owner, hs, pos, lo, hi in parts for o, h, p, a, b in zip(owner, hs, pos, lo, hi, strict=True) for d in range(int(a), int(b) + 1)}

    whole = windows([anchors_of(texts, 60, 12)])
    assert windows(all_anchors_of(texts, 60, 12, scan)) == whole and len(whole) == sum(max(0, len(t) - 59) for t in texts)
    assert word_codes(texts, scan) == word_codes(texts)


def test_periodic_texts(spark):
    """Long runs of one period lose most of their anchors and none of their repeats, nor do texts that share a window with them."""
    rnd = random.Random(15)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    rows = ["x" * 1500, "ab" * 700 + "zz", say(90) + "abc " * 300 + say(90), "x" * 60, "x" * 59, say(40) + "c ab" * 15 + say(40), "ba" * 31, "y" * 239 + "x" * 300 + "y" * 241, "word " * 400, "a" * 61 + say(10), say(200)]
    rows += ["xy" * 20 + "x" * 400 + "xy" * 200, "0123456789abcdef" * 90 + say(5) + "0123456789abcdef" * 90, "q" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    for length, gram in ((60, 12), (400, 100)):
        got = {r.doc_id: r.kept for r in remove_repeats(df, length=length, gram=gram).collect()}
        want = brute_repeats([t.encode() for t in rows], length)
        assert [bytes(got[i]) for i in range(len(rows))] == want
    got = {r.doc_id: r.kept for r in remove_repeats(df, words=51).collect()}
    want = brute_passages([t.encode() for t in rows], 400, 51)
    assert [bytes(got[i]) for i in range(len(rows))] == want


def test_memory_of_one_byte_repeated():
    import tracemalloc

    tracemalloc.start()
    n = 0
    for text in (b"x" * (10 << 20), b"ab" * (1 << 20)):
        for owner, *_ in all_anchors_of([text], 400, 100):
            n += len(owner)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and n < 100_000
    tracemalloc.stop()


def test_remove_repeats_empty(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_repeats_of_sorted_contexts():
    """Distances of repeated windows, against comparing every two contexts byte for byte."""
    rnd = random.Random(14)
    for _ in range(150):
        length = 8
        rows = []
        for _ in range(rnd.randint(1, 14)):
            lo = rnd.randint(0, 3)
            hi = rnd.randint(lo, 5)
            rows.append((bytes(rnd.choice(b"ab") for _ in range(length - lo)), bytes(rnd.choice(b"ab") for _ in range(hi)), lo, hi, rnd.random() < 0.1))
        rows.sort()
        lcp = np.array([0] + [common_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)])
        low, high = repeats(lcp, [r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), length)
        for k, (right, left, lo, hi, many) in enumerate(rows):
            found = [m for m in range(lo, hi + 1) if many or any(k != j and r[2] <= m <= r[3] and r[0][: length - m] == right[: length - m] and r[1][:m] == left[:m] for j, r in enumerate(rows))]
            assert (low[k], high[k]) == ((min(found), max(found)) if found else (length, -1))


def test_loser_tree():
    rnd = random.Random(1)
    for _ in range(100):
        runs = []
        for _ in range(rnd.randint(1, 6)):
            s = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(1, 9)))
            runs.append((s, [0] + [common_prefix(a, b) for a, b in zip(s, s[1:], strict=False)]))
        which, index, lcp = merge_runs(runs)
        out = [runs[r][0][i] for r, i in zip(which, index, strict=True)]
        assert out == sorted(x for s, _ in runs for x in s)
        assert lcp[1:] == [common_prefix(a, b) for a, b in zip(out, out[1:], strict=False)]
