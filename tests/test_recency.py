"""Series kept by recency, batch by batch, against a plain list."""

import random

from pyspark.sql import functions as F

from tracewell.streaming import recency


def brute(touches, cap, live):
    held, out = [], []
    for series, at in touches:
        if live is not None:
            old = [h for h in held if h[1] < at - live]
            out += [(s, a, at, "expired") for s, a in old]
            held = [h for h in held if h not in old]
        held = [h for h in held if h[0] != series] + [(series, at)]
        if len(held) > cap:
            out.append((*held.pop(0), at, "capacity"))
    return out


def test_against_a_plain_list():
    rnd = random.Random(1)
    for _ in range(200):
        at, touches = 0, []
        for _ in range(rnd.randint(1, 80)):
            at += rnd.choice([0, 1, 1, 5])
            touches.append((rnd.choice("abcdefgh"), at))
        cap, live = rnd.randint(1, 9), rnd.choice([None, 3, 10])
        recent, got, held = recency.Recent(cap, live), [], None
        for k, (s, a) in enumerate(touches):
            if k % 7 == 0:
                recent = recency.Recent(cap, live, dict(held) if held else None)  # as between batches
            got += recent.touch(s, a)
            held = list(recent.held.items())
        assert got == brute(touches, cap, live)


def test_a_stream_of_batches(spark, tmp_path):
    rows = [(k, f"s{k * 7 % 13}") for k in range(300)] + [(300, None)]
    for k in range(3):
        part = spark.createDataFrame(rows[k * 100 : k * 100 + 100] if k < 2 else rows[200:], "seq long, name string").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("seq long, name string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    gone = recency.given_up_series(stream, F.col("name"), 5, F.lit(0), live_seconds=4)
    gone.writeStream.format("memory").queryName("gone").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.series, int(r.last.timestamp()), int(r.given_up.timestamp()), r.reason) for r in spark.table("gone").collect())
    assert got == sorted(brute([(s, k) for k, s in rows if s is not None], 5, 4)) and {r[3] for r in got} == {"expired"}
