"""Streams over many micro-batches: keyed state with timers, late rows, restarts."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from airlake.streaming import operators as ST

T0 = dt.datetime(2024, 3, 1)


def land(spark, folder, name, rows, schema, at):
    """One file, with a modification time that puts it in its place."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-tmp-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}-tmp-{name}") if f.endswith(".parquet"))
    target = f"{folder}/{name}.parquet"
    with open(f"{folder}-tmp-{name}/{part}", "rb") as a, open(target, "wb") as b:
        b.write(a.read())
    os.utime(target, (1_700_000_000 + at, 1_700_000_000 + at))


CAND = "user_id long, notification_type string, city_id int, event_at timestamp_ntz, aqi_value double"


def greedy(rows, hours):
    last, out = {}, []
    for u, n, c, t, v in sorted(rows, key=lambda r: r[3]):
        if (u, n, c) not in last or t - last[u, n, c] >= dt.timedelta(hours=hours):
            last[u, n, c] = t
            out.append((u, n, c, t, v))
    return sorted(out)


def test_sends_jumps_like_the_row_loop():
    r = random.Random(1)
    for _ in range(200):
        times = np.array(sorted(r.randrange(100) for _ in range(r.randint(0, 30))), np.int64)
        before, gap = r.choice([None, r.randrange(100)]), r.randint(1, 20)
        want, last = [], before
        for i, t in enumerate(times.tolist()):
            if last is None or t - last >= gap:
                want.append(i)
                last = t
        got = ST.sends(times, before, gap)
        assert [int(times[i]) for i in got] == [int(times[i]) for i in want]


def test_timers_over_many_batches_and_a_restart(spark, tmp_path):
    r = random.Random(5)
    # hours apart by minutes and users; the second half of the files comes after a restart
    rows = [(r.randint(1, 4), "aqi_threshold", r.randint(0, 1), T0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(800)]
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        s = spark.readStream.schema(CAND).option("maxFilesPerTrigger", 1).parquet(src)
        ST.run_to_parquet(ST.stream_alerts_with_timers(s, 6, "1 hour"), out, ckpt)

    for i in range(4):
        land(spark, src, f"f{i}", rows[i * 100:(i + 1) * 100], CAND, i)
    run()
    first = sorted(tuple(x) for x in spark.read.parquet(out).collect())
    assert first == greedy(rows[:400], 6)
    for i in range(4, 8):
        land(spark, src, f"f{i}", rows[i * 100:(i + 1) * 100], CAND, i)
    run()
    got = sorted(tuple(x) for x in spark.read.parquet(out).collect())
    assert got == greedy(rows, 6) and len(got) > len(first)
    assert len([f for f in os.listdir(f"{ckpt}/commits") if f.isdigit()]) >= 8


def test_expired_state_is_cleared(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    land(spark, src, "a", [(u, "x", 0, T0, 1.0) for u in range(1, 21)], CAND, 0)
    land(spark, src, "b", [(99, "x", 0, T0 + dt.timedelta(days=3), 1.0)], CAND, 1)
    land(spark, src, "c", [(99, "x", 0, T0 + dt.timedelta(days=4), 1.0)], CAND, 2)
    s = spark.readStream.schema(CAND).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.stream_alerts_with_timers(s, 6, "1 hour").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) > min(kept[-2:])
    assert spark.read.parquet(out).count() == 22


EVENT = "measurement_id long, station_id long, ts timestamp_ntz, pollutant string, value double"


def test_late_rows(spark, tmp_path):
    """A row inside the watermark changes its window; one behind it is dropped,
    after a restart as well."""
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def m(i, hours, value):
        return (i, 1, T0 + dt.timedelta(hours=hours), "pm2_5", value)

    def run():
        s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
        ST.run_to_parquet(ST.stream_hourly_mean(s, "2 hours"), out, ckpt)

    land(spark, src, "f0", [m(1, 0.1, 10.0), m(2, 1.5, 5.0)], EVENT, 0)
    land(spark, src, "f1", [m(3, 0.2, 30.0), m(4, 2.0, 7.0)], EVENT, 1)     # 0.2 h is late, but inside the watermark
    run()
    land(spark, src, "f2", [m(5, 9.0, 1.0)], EVENT, 2)                      # moves the watermark to 7 h
    run()
    land(spark, src, "f3", [m(6, 0.3, 1000.0), m(7, 15.0, 2.0)], EVENT, 3)  # 0.3 h is behind it
    run()
    land(spark, src, "f4", [m(8, 30.0, 2.0)], EVENT, 4)
    run()
    got = {r["datetime"]: r["pm2_5_ugm3"] for r in spark.read.parquet(out).collect()}
    assert got[T0] == 20.0
    assert got[T0 + dt.timedelta(hours=1)] == 5.0 and got[T0 + dt.timedelta(hours=9)] == 1.0
    assert spark.read.parquet(out).filter(F.col("datetime") == F.lit(T0).cast("timestamp_ntz")).count() == 1
