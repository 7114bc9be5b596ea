"""Media columns as MPEG transport streams (ISO/IEC 13818-1): multiplexing, and parsing back.

A payload is stored as 8-bit samples in one private elementary stream. It is cut into access units of UNIT bytes; each
becomes a PES packet with a presentation timestamp, begins in a transport packet of its own with the random-access
indicator, and is stuffed to whole packets with adaptation fields. Program association and program map tables come
first and again before every TABLES_EVERY-th access unit.

The parser reads the tables (with their CRC-32), follows each elementary stream by PID, checks continuity counters,
reassembles PES packets and lists the timestamps of all packets and of the random-access points. It takes streams with
several programs, duplicates and losses: a repeated counter is a duplicate packet and is dropped, a gap is counted.

Defined results: an empty payload is stored as tables only; damaged, cut or empty table packets are counted and skipped,
and so are PES packets without a whole header; gaps in the tables' own counters are counted; a null text is stored like an
empty one by digest_column and stays null in mux_column; equal texts give equal streams; texts of any length become whole
access units (a batch of streams must stay under Arrow's 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch for texts
of megabytes); an empty table gives none; other columns are ignored. Bytes outside 188-byte packets are an error.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # PES packets of private data, private_stream_1
UNIT, TABLES_EVERY = 32_000, 32  # bytes of an access unit (a PES length has 16 bits); access units between tables
CLOCK, SAMPLES = 90_000, 8_000  # ticks and samples a second


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program-specific information: most significant bit first, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table, 0xB0 | n >> 8, n & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
# no clock reference: PCR_PID 0x1FFF
_PMT = _section(0x02, PROGRAM, bytes([0xFF, 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def _pes(unit: bytes, pts: int) -> bytes:
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [], 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        if k % TABLES_EVERY == 0:
            n = k // TABLES_EVERY
            out += [_table_packet(0, _PAT, n), _table_packet(PMT_PID, _PMT, n)]
        if not payload:
            break
        pes = _pes(payload[at : at + UNIT], at * CLOCK // SAMPLES & (1 << 33) - 1)
        # the first packet has an adaptation field of at least 2 bytes (the indicator); the last one is stuffed
        first = pes[:182]
        full, rest = divmod(len(pes) - len(first), 184)
        head = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15, 183 - len(first), 0x40])
        out.append(head + b"\xff" * (182 - len(first)) + first)
        counter += 1
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, len(first)).reshape(full, 184)
            out.append(block.tobytes())
            counter += full
        if rest:
            fill = 183 - rest  # length of the adaptation field
            field_ = bytes([fill]) + (b"\x00" + b"\xff" * (fill - 1) if fill else b"")
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15]) + field_ + pes[-rest:])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream."""

    pid: int
    program: int
    stream_type: int
    data: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # the timestamps of access units that can be decoded from
    units: int = 0
    gaps: int = 0
    duplicates: int = 0


@dataclass
class Parsed:
    packets: int
    streams: list[Stream]
    bad_tables: int = 0
    table_gaps: int = 0


def _steps(counter: np.ndarray, packets: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of one PID are duplicates of those before, and how many gaps the counters of the others have."""
    twin = np.zeros(len(counter), bool)
    same = np.flatnonzero(counter[1:] == counter[:-1])
    twin[1:][same] = (packets[1:][same, 4:] == packets[:-1][same, 4:]).all(1)
    rest = counter[~twin].astype(np.int64)
    return twin, int((((rest[1:] - rest[:-1]) & 15) != 1).sum())


def _sections(packets: np.ndarray, start: np.ndarray, offset: np.ndarray) -> list[bytes]:
    """Whole sections of the table packets of one PID."""
    found, open_ = [], b""
    for p, s, o in zip(packets, start, offset, strict=True):
        data = p[o:].tobytes()
        if not data:
            continue
        if s:
            pointer = data[0]
            open_ += data[1 : 1 + pointer] if open_ else b""
            if open_:
                found.append(open_)
            open_ = data[1 + pointer :]
        elif open_:
            open_ += data
    if open_:
        found.append(open_)
    out = []
    for data in found:
        while len(data) > 3 and data[0] != 0xFF:
            n = 3 + ((data[1] & 15) << 8 | data[2])
            out.append(data[:n])
            data = data[n:]
    return out


def parse(media: bytes) -> Parsed:
    """Programs, elementary streams and timestamps of a transport stream."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if len(p) and not (p[:, 0] == SYNC).all():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1] & 31).astype(np.int64) << 8 | p[:, 2]
    start = (p[:, 1] & 0x40) > 0
    adaptation = (p[:, 3] & 0x20) > 0
    has_payload = (p[:, 3] & 0x10) > 0
    counter = p[:, 3] & 15
    offset = np.where(adaptation, 5 + p[:, 4].astype(np.int64), 4)
    access = adaptation & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)
    bad = table_gaps = 0

    def tables(of: int, table: int) -> list[bytes]:
        nonlocal bad, table_gaps
        m = np.flatnonzero((pid == of) & has_payload)
        twin, gaps = _steps(counter[m], p[m])
        table_gaps += gaps
        bad += int((start[m] & (offset[m] >= PACKET)).sum())
        m = m[~twin]
        out = {}
        for s in _sections(p[m], start[m], offset[m]):
            if section_crc(s):
                bad += 1
            elif s[0] == table:
                out[s] = None
        return list(out)

    streams: dict[int, Stream] = {}
    for pat in tables(0, 0x00):
        for at in range(8, len(pat) - 4, 4):
            program, where = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
            if not program:
                continue
            for pmt in tables(where, 0x02):
                at2 = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
                while at2 < len(pmt) - 4:
                    sid = int.from_bytes(pmt[at2 + 1 : at2 + 3], "big") & 0x1FFF
                    streams.setdefault(sid, Stream(sid, program, pmt[at2]))
                    at2 += 5 + (int.from_bytes(pmt[at2 + 3 : at2 + 5], "big") & 0x0FFF)
    for s in streams.values():
        rows = np.flatnonzero((pid == s.pid) & has_payload)
        if not len(rows):
            continue
        twin, s.gaps = _steps(counter[rows], p[rows])
        s.duplicates = int(twin.sum())
        rows = rows[~twin]
        begins = np.flatnonzero(start[rows])
        data = []
        for b, e in zip(begins, np.append(begins, len(rows))[1:], strict=True):
            own = rows[b:e]
            plain = own[offset[own] == 4]
            if len(plain) >= len(own) - 2 and len(own) > 2 and offset[own[0]] != 4 and (offset[own[1:-1]] == 4).all():
                pes = p[own[0], offset[own[0]] :].tobytes() + p[own[1:-1], 4:].tobytes() + p[own[-1], offset[own[-1]] :].tobytes()
            else:
                pes = b"".join(p[i, offset[i] :].tobytes() for i in own)
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            size = int.from_bytes(pes[4:6], "big")
            body = pes[9 + pes[8] : 6 + size] if size else pes[9 + pes[8] :]
            if pes[7] & 0x80:
                x = pes[9:14].ljust(5, b"\0")
                pts = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
                s.pts.append(pts)
                if access[own[0]]:
                    s.random_access.append(pts)
            s.units += 1
            data.append(body)
        s.data = b"".join(data)
    return Parsed(len(p), list(streams.values()), bad, table_gaps)


def feature_text(parsed: Parsed) -> str:
    s = parsed.streams[0] if parsed.streams else Stream(0, 0, 0)
    ends = f"{s.pts[0]}-{s.pts[-1]}" if s.pts else "-"
    return f"packets={parsed.packets};streams={len(parsed.streams)};type={s.stream_type};units={s.units};pts={ends};access={len(s.random_access)};gaps={s.gaps};duplicates={s.duplicates};bad_tables={parsed.bad_tables};table_gaps={parsed.table_gaps}"


def payload_of(text: bytes, multiple: int = 64) -> bytes:
    """The bytes, and zeros up to a positive multiple."""
    return text.ljust(max(-(-len(text) // multiple), 1) * multiple, b"\x00")


def mux_column(payload: Column | str) -> Column:
    """Transport stream (binary) of a binary column; null for null."""

    @F.arrow_udf("binary")
    def store(values: pa.Array) -> pa.Array:
        return pa.array([mux(v.as_py()) if v.is_valid else None for v in values], pa.binary())

    return store(payload)


_STREAM_TYPE = pa.struct([
    ("pid", pa.int32()), ("program", pa.int32()), ("stream_type", pa.int32()), ("data", pa.binary()), ("pts", pa.list_(pa.int64())),
    ("random_access", pa.list_(pa.int64())), ("gaps", pa.int32()), ("duplicates", pa.int32()),
])


def parse_column(media: Column | str) -> Column:
    """Elementary streams of a transport stream column: pid, program, type, data, timestamps, random-access points, gaps, duplicates."""

    @F.arrow_udf("array<struct<pid:int,program:int,stream_type:int,data:binary,pts:array<bigint>,random_access:array<bigint>,gaps:int,duplicates:int>>")
    def read(values: pa.Array) -> pa.Array:
        keys = [f.name for f in _STREAM_TYPE]
        out = [[{k: getattr(s, k) for k in keys} for s in parse(v.as_py()).streams] if v.is_valid else None for v in values]
        return pa.array(out, pa.list_(_STREAM_TYPE))

    return read(media)


_DIGEST = "n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string"
_DIGEST_TYPE = pa.struct([
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def digest_column(text: Column | str) -> Column:
    """Stores each text as a transport stream, parses the stored bytes, and digests what was read back and the stream."""

    @F.arrow_udf(f"struct<{_DIGEST}>")
    def digest(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            data = (t.as_py() or "").encode()
            media = mux(payload_of(data))
            parsed = parse(media)
            back = parsed.streams[0].data
            out.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(parsed)))
        names = [f.name for f in _DIGEST_TYPE]
        return pa.array([dict(zip(names, x, strict=True)) for x in out], _DIGEST_TYPE)

    return digest(text)
