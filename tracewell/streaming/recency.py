"""Series bounded by recency, as a stream: keyed state with a cap in order of last touch, and a time to live.

`operators.groups.most_recent_groups` gives the same for a table at rest. Here every execution touches its series; when a shard
holds more than its cap, the series touched longest ago is given up, and so are those that nothing has touched for the time to
live. The stream that comes out has one row for each series given up, so that what was exported of it can be removed. State is
bounded by the cap, whatever the number of series or the length of the stream; shards are worked on by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GIVEN_UP = "shard long, series string, last long, given_up long, reason string"
_STATE = "series array<string>, last array<long>"
#: Rows that are objects at a time.
_ROWS = 1 << 14


class Recent:
    """Series in order of their last touch (microseconds), the longest ago first."""

    def __init__(self, cap: int, live_us: int | None, held: dict[str, int] | None = None) -> None:
        self.cap, self.live_us, self.held = cap, live_us, held or {}

    def touch(self, series: str, at: int) -> Iterator[tuple[str, int, int, str]]:
        """Notes a touch; yields (series, last touch, now, reason) of those given up."""
        while self.live_us is not None and self.held:
            first = next(iter(self.held))
            if self.held[first] >= at - self.live_us:
                break
            yield first, self.held.pop(first), at, "expired"
        self.held.pop(series, None)
        self.held[series] = at
        if len(self.held) > self.cap:
            first = next(iter(self.held))
            yield first, self.held.pop(first), at, "capacity"


def _keeping(cap: int, live_us: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series, last = state.get if state.exists else ((), ())
        recent = Recent(cap, live_us, dict(zip(series, map(int, last), strict=True)))
        out: list[tuple] = []
        for s, at in _ordered(frames):
            out.extend((key[0], *gone) for gone in recent.touch(s, at))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)
        state.update((list(recent.held), list(recent.held.values())))

    columns = [c.split()[0] for c in GIVEN_UP.split(", ")]
    return run


def _ordered(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
    """(series, at) of a shard's touches in order of at and seq. A touch is held as three numbers, a series' name once."""
    codes: dict[str, int] = {}
    parts = [(f["at"].to_numpy("int64"), f["seq"].to_numpy(), np.array([codes.setdefault(s, len(codes)) for s in f["series"]], "int32")) for f in frames]
    ats, seqs, series = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    names, order = list(codes), np.lexsort((seqs, ats))
    del seqs
    for k in range(0, len(order), _ROWS):
        some = order[k : k + _ROWS]
        yield from zip([names[c] for c in series[some]], ats[some].tolist(), strict=True)


def given_up_series(executions: DataFrame, series: Column, cap: int, shard: Column | None = None, shards: int = 32, live_seconds: float | None = None) -> DataFrame:
    """Stream of the series that a stream of executions (ts, seq) makes give up: at most `cap` are kept in each shard.

    Within a batch touches count in order of ts and seq; batches in the order they come. A null series is none.
    """
    at, name = F.unix_micros(F.col("ts").cast("timestamp")), series.cast("string")
    own = F.pmod(F.xxhash64(name), F.lit(shards)) if shard is None else shard
    rows = executions.select(own.cast("long").alias("shard"), name.alias("series"), at.alias("at"), F.col("seq").cast("long").alias("seq")).filter("series is not null")
    live_us = None if live_seconds is None else int(live_seconds * 1e6)
    found = rows.groupBy("shard").applyInPandasWithState(_keeping(cap, live_us), GIVEN_UP, _STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("shard", "series", F.timestamp_micros("last").alias("last"), F.timestamp_micros("given_up").alias("given_up"), "reason")
