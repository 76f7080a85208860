"""Alerts: cooldown, top-k, mark-read and the stateful stream vs batch."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airlake.operators import alerts as AL
from airlake.streaming import operators as ST


def test_top_k_matches_plain_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.random() < 0.5, rnd.randint(0, 1000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "notice_id long, user_id long, is_read boolean, t long")
    order = [F.col("is_read").asc(), F.col("t").desc(), F.col("notice_id").desc()]
    got = {(r.user_id, r.notice_id) for r in AL.top_k_per_group(df, ["user_id"], order, 25, 8, "notice_id").collect()}
    w = W.partitionBy("user_id").orderBy(*order)
    want = {(r.user_id, r.notice_id) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn <= 25").collect()}
    assert got == want


def test_cooldown_drops_recent_same_key(spark):
    cand = spark.createDataFrame([(1, 0, "aqi_threshold"), (2, 0, "aqi_threshold")],
                                 "user_id long, city_id int, notification_type string")
    t = dt.datetime(2024, 1, 2, 12)
    sent = spark.createDataFrame([(1, 0, "aqi_threshold", t - dt.timedelta(hours=5)),
                                  (2, 0, "aqi_threshold", t - dt.timedelta(hours=7))],
                                 "user_id long, city_id int, notification_type string, sent_at timestamp_ntz")
    out = AL.cooldown(cand, sent, F.lit(t).cast("timestamp_ntz"), 6)
    assert [r.user_id for r in out.collect()] == [2]


def test_mark_read_keeps_old_read_time(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)
    n = spark.createDataFrame([(1, False, None), (2, True, t0), (3, False, None)],
                              "notice_id long, is_read boolean, read_at timestamp_ntz")
    ids = spark.createDataFrame([(1,), (2,)], "notice_id long")
    got = {r.notice_id: (r.is_read, r.read_at) for r in AL.mark_read(n, ids, F.lit(t1).cast("timestamp_ntz")).collect()}
    assert got == {1: (True, t1), 2: (True, t0), 3: (False, None)}


def test_stream_cooldown_equals_batch_greedy(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = sorted({(rnd.randint(1, 4), base + dt.timedelta(hours=rnd.randint(0, 96))) for _ in range(150)})
    cand = spark.createDataFrame([(u, "aqi_threshold", 0, t, 150.0) for u, t in rows],
                                 "user_id long, notification_type string, city_id int, event_at timestamp_ntz, "
                                 "aqi_value double")
    src = tempfile.mkdtemp(prefix="airlake-test-src-")
    cand.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "d"))
    s = spark.readStream.schema(cand.schema).parquet(os.path.join(src, "d"))
    out = tempfile.mkdtemp(prefix="airlake-test-out-")
    ST.run_to_parquet(ST.stream_alerts(s, 6, "100 days"), os.path.join(out, "o"), os.path.join(out, "c"))
    got = {(r.user_id, r.sent_at) for r in spark.read.parquet(os.path.join(out, "o")).collect()}
    want = set()
    for u in {u for u, _ in rows}:
        last = None
        for _, t in sorted(x for x in rows if x[0] == u):
            if last is None or t - last >= dt.timedelta(hours=6):
                want.add((u, t))
                last = t
    assert got == want
