"""Transport streams that are damaged, and the streams that a reader of the standard expects."""

import os
import random

import pytest

from tracewell.llm import transport_stream as ts


def packets(media):
    return [bytearray(media[i : i + ts.PACKET]) for i in range(0, len(media), ts.PACKET)]


def test_any_damage_but_lost_packets_is_read():
    """Flipped bits anywhere after the sync byte never make the parser fail."""
    rnd = random.Random(1)
    media = ts.mux(os.urandom(3000))
    for _ in range(3000):
        broken = packets(media)
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(broken[:2] + broken)
            p[rnd.randint(1, rnd.choice([6, 187]))] = rnd.choice([0, 255, rnd.randrange(256)])
        parsed = ts.parse(b"".join(broken))
        assert parsed.packets == len(broken)


def test_table_packet_filled_by_its_adaptation_field():
    p = packets(ts.mux(b"x" * 64))
    p[0][3], p[0][4] = 0x30, 183
    parsed = ts.parse(b"".join(p))
    assert (parsed.streams, parsed.bad_tables) == ([], 1)


def test_counters_of_tables():
    media = ts.mux(os.urandom(ts.UNIT * ts.TABLES_EVERY * 3))
    p = packets(media)
    tables = [i for i, x in enumerate(p) if x[1] & 31 == 0 and x[2] == 0]
    assert len(tables) == 3 and ts.parse(media).table_gaps == 0
    assert ts.parse(b"".join(p[: tables[1]] + p[tables[1] + 1 :])).table_gaps == 1
    twice = ts.parse(b"".join([p[0], *p]))
    assert (twice.table_gaps, twice.bad_tables, twice.streams[0].gaps) == (0, 0, 0)


@pytest.mark.parametrize("n", [1, 5, 10_000])
def test_several_programs(n):
    """Two programs in one stream, packets interleaved: each is put together by its own PID."""
    one, two = os.urandom(n), os.urandom(n + 7)
    a = packets(ts.mux(one))
    b = packets(ts.mux(two))
    pid, pmt = 0x0200, 0x1001
    for p in b:
        here = (p[1] & 31) << 8 | p[2]
        new = {ts.STREAM_PID: pid, ts.PMT_PID: pmt}.get(here, here)
        p[1], p[2] = p[1] & 0xE0 | new >> 8, new & 0xFF
    both = ts._section(0x00, 1, b"".join(bytes([0, k, 0xE0 | x >> 8, x & 0xFF]) for k, x in ((1, ts.PMT_PID), (2, pmt))))
    table = ts._section(0x02, 2, bytes([0xFF, 0xFF, 0xF0, 0, ts.STREAM_TYPE, 0xE0 | pid >> 8, pid & 0xFF, 0xF0, 0]))
    mixed = [x for i in range(2, max(len(a), len(b))) for x in (*a[i : i + 1], *b[i : i + 1])]
    parsed = ts.parse(b"".join([ts._table_packet(0, both, 0), a[1], ts._table_packet(pmt, table, 0), *mixed]))
    assert [(s.pid, s.program, s.data, s.gaps) for s in parsed.streams] == [(ts.STREAM_PID, 1, one, 0), (pid, 2, two, 0)]
