"""Compressed files shared out over ranges: each line once, whatever the ranges, members, blocks and streams."""

import bz2
import gzip
import random

import pytest

from tracewell.sources import compressed as c
from tracewell.sources import logs


def lines_by_ranges(path, size):
    out = []
    reader = c.CompressedReader({"path": str(path), "chunkBytes": size})
    parts = reader.partitions()
    for p in parts:
        out.append([v.as_py() for b in reader.read(p) for v in b.column("value")])
    return out


def text(rnd, n):
    return "".join("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80))) + rnd.choice(["\n", "\n", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("end", ["\n", "", "last"])
@pytest.mark.parametrize("kind", ["plain", "gzip", "bzip2"])
def test_each_line_once(tmp_path, kind, end):
    rnd = random.Random(3)
    body = (text(rnd, 900).rstrip("\r\n") + end).encode()
    pieces = [body[a:b] for a, b in zip([0, 10, 11, 5000, 9000, 30000], [10, 11, 5000, 9000, 30000, len(body)], strict=True)]
    data = {"plain": body, "gzip": b"".join(map(gzip.compress, pieces)), "bzip2": b"".join(bz2.compress(p, 1 + k) for k, p in enumerate(pieces))}[kind]
    path = tmp_path / "f"
    path.write_bytes(data)
    want = [x.removesuffix("\r") for x in body.decode().split("\n")]
    want = want[:-1] if want[-1] == "" else want
    for size in (7, 100, 999, 4096, 1 << 20):
        got = lines_by_ranges(path, size)
        assert [x for part in got for x in part] == want
    assert sum(map(bool, lines_by_ranges(path, 4096))) >= 2  # shared out


def test_blocks_of_one_bzip2_stream(tmp_path):
    """Blocks begin at any bit; a stream of several is entered in the middle."""
    rnd = random.Random(4)
    body = text(rnd, 30_000).encode()
    path = tmp_path / "f"
    path.write_bytes(bz2.compress(body, 1))  # blocks of 100 kB
    got = lines_by_ranges(path, 50_000)
    assert [x for part in got for x in part] == [x.removesuffix("\r") for x in body.decode().split("\n")[:-1]]
    assert sum(map(bool, got)) >= 5


def test_padding_and_damage(tmp_path, spark):
    (tmp_path / "padded").write_bytes(gzip.compress(b"a\nb\n") + bytes(700))
    data = bytearray(bz2.compress(b"x y z\n" * 100_000, 1))
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "broken").write_bytes(data)
    (tmp_path / "text").write_bytes(b"BZ not\n\x1f\n")
    found = logs.read_lines_by_content(spark, str(tmp_path), errors=True, chunk_bytes=300)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r.value if r.error is None else "error")
    assert sorted(rows["padded"]) == ["a", "b"] and sorted(rows["text"]) == ["\x1f", "BZ not"] and "error" in rows["broken"]
    with pytest.raises(Exception, match="broken"):
        logs.read_lines_by_content(spark, str(tmp_path)).count()
