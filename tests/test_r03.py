"""Faults of the third review: work that grew too fast, with the results of before."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airlake.functions import geo as G
from airlake.operators import polyline as PL
from airlake.operators import routes as RT
from airlake.streaming import operators as ST


def test_nearest_is_compiled_up_to_four(spark):
    """Lists of two to four candidates were folded by an interpreted expression."""
    r = random.Random(3)
    rows = [(i, r.uniform(-80, 80), r.uniform(-170, 170),
             [(r.choice([4, 5, 6]) + 10 * j, r.uniform(-80, 80), r.uniform(-170, 170), r.randrange(99)) for j in range(i % 7)]) for i in range(70)]
    rows += [(90, 0.0, 0.0, [(2, 1.0, 0.0, 20), (1, -1.0, 0.0, 10)]), (91, 0.0, 0.0, None), (92, 0.0, 0.0, [(2, 1.0, 0.0, 20)] * 3 + [(1, -1.0, 0.0, 10)] * 3)]
    d = spark.createDataFrame(rows, "i int, la double, lo double, c array<struct<id:long,lat:double,lon:double,value:long>>")
    args = F.col("c"), F.col("la"), F.col("lo")
    got = d.select("i", G.nearest_of(*args, "long").alias("new"), G._folded(*args, "long").alias("old")).collect()
    assert all(x.new == x.old or (x.new is None and (x.old is None or x.old.id is None)) for x in got)
    assert {x.i: x.new.id for x in got if x.i in (90, 92)} == {90: 1, 92: 1}


def test_large_and_small_requests_give_the_greedy_pool(spark):
    r = random.Random(5)
    rows = [(q, i, r.choice([1000.0, 1050.0, 2000.0, 3000.0, 9000.0]), r.choice([60.0, 61.0, 200.0]), f"x{q}-{i}")
            for q, n in ((1, 3), (2, 64), (3, 65), (4, 200), (5, 1)) for i in range(n)]
    want = set()
    for q in range(1, 6):
        kept = []
        for x in (x for x in rows if x[0] == q):
            if len(kept) < 5 and not any(abs(x[2] - k[2]) / max(x[2], 1) < 0.08 and abs(x[3] - k[3]) / max(x[3], 1) < 0.08 for k in kept):
                kept.append(x)
        want |= set(kept)
    d = spark.createDataFrame([*rows, (None, 0, 1.0, 1.0, "no request"), (7, 0, None, 1.0, "first"), (7, 1, 5.0, 1.0, "unknown")],
                              "request_id long, route_idx int, distance_m double, duration_s double, more string")
    assert {tuple(x) for x in RT.dedupe_routes(d, 5, 0.08).collect()} == want | {(7, 0, None, 1.0, "first")}


def test_via_options_shuffles_no_geometry(spark):
    """whole geometries went through the shuffles and sorts."""
    rows = [(q, i, 10.0, 70.0, 20.0, 80.0, i % 3 * 10) for q, n in ((1, 5), (2, 3), (3, 4)) for i in range(n)]
    d = spark.createDataFrame(rows, "request_id long, route_idx int, src_lat double, src_lon double, dst_lat double, dst_lon double, n int")
    g = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n") * 12), lambda i: F.struct(
        (F.col("src_lat") + i).alias("lat"), (F.col("src_lon") + F.col("route_idx")).alias("lon")))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    cols = ["request_id", "route_idx", "via_lat", "via_lon", "label", "preview_waypoints"]
    lazy = RT.via_options(d, g).select(*cols)
    assert sorted(map(str, lazy.collect())) == sorted(map(str, RT.via_options(d.withColumn("geometry", g)).select(*cols).collect()))
    assert {(x.request_id, x.route_idx) for x in lazy.collect()} == {(1, 1), (1, 2), (1, 4), (3, 1), (3, 2)}
    first, *below = lazy._jdf.queryExecution().optimizedPlan().toString().split("Window")
    assert "filter(" in first and len(below) == 2 and "filter(_g" not in "".join(below)


def test_route_change_scores_the_routes_once(spark, sf, monkeypatch):
    """the saved routes were scored twice, and joined to themselves."""
    from airlake.plans import q_alerts as Q
    calls, plain = [], Q.cards
    monkeypatch.setattr(Q, "cards", lambda *a: calls.append(1) or plain(*a))
    rows = Q.alr_route_change(spark, sf).collect()
    assert len(calls) == 1 and all(x.aqi_change >= 0 for x in rows)


def test_polyline_batches_equal_single_lines(spark):
    """every point went through Python objects."""
    r, g = random.Random(1), []
    for _ in range(400):
        g.append(None if r.random() < 0.05 else [
            {"lat": r.choice([r.uniform(-90, 90), round(r.uniform(-1, 1), 5), 0.0, 12.345675]), "lon": r.uniform(-360, 360)}
            for _ in range(r.choice([0, 1, 2, 50]))])
    a = pa.array(g, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))
    for lo, hi in ((0, 400), (7, 107), (0, 0)):
        e, want = PL._encode_batch(a.slice(lo, hi - lo)), [None if x is None else PL._encode(x) for x in g[lo:hi]]
        assert e.to_pylist() == want
        counts, lat, lon = PL._decode_batch(e)
        lines = [PL._decode(x) if x else [] for x in want]
        assert counts.tolist() == [len(x) for x in lines]
        assert list(zip(lat.tolist(), lon.tolist())) == [p for x in lines for p in x]
    with pytest.raises(ValueError):
        PL._encode_batch(pa.array([[{"lat": None, "lon": 1.0}]], a.type))
    with pytest.raises(IndexError):
        PL._decode_batch(pa.array(["_p~iF~ps|U_"]))
    d = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, None), (None, "_p~iF~ps|U"), (4, "")], "k long, polyline string")
    assert [tuple(x) for x in PL.decode_waypoints(d, ["k"]).orderBy(F.col("k").asc_nulls_last(), "pos").collect()] == [
        (1, 0, 38.5, -120.2), (1, 1, 40.7, -120.95), (1, 2, 43.252, -126.453), (None, 0, 38.5, -120.2)]


def test_cooldown_goes_from_alert_to_alert():
    """every candidate was a Python row; one without a time was sent."""
    class State(SimpleNamespace):
        hasTimedOut, exists, deadline = False, False, None

        def update(self, v):
            self.exists, self.get = True, v

        def setTimeoutTimestamp(self, ms):
            self.deadline = ms

    r, fn, s = np.random.default_rng(0), ST._cooldown_fn(6), State()
    start, last, got, want = pd.Timestamp("2024-01-01"), None, [], []
    for part in range(3):
        at = start + pd.to_timedelta(np.sort(r.integers(0, 200, 80)) + part * 100, unit="h")
        p = pd.DataFrame({"event_at": [*at, pd.NaT], "aqi_value": r.random(81)}).sample(frac=1, random_state=part)
        for x in p.sort_values("event_at", kind="stable").itertuples():
            if x.event_at is not pd.NaT and (last is None or x.event_at - last >= pd.Timedelta(hours=6)):
                want.append((x.event_at, x.aqi_value))
                last = x.event_at
        for out in fn((7, "aqi_threshold", None), iter([p[:30], p[30:]]), s):
            assert out["user_id"].eq(7).all() and out["city_id"].isna().all()
            got += list(zip(out["sent_at"], out["aqi_value"]))
    assert got == want and s.get == (last.to_pydatetime(),)
    assert s.deadline == int((last + pd.Timedelta(hours=6)).timestamp() * 1000)
    none = State()
    assert not list(fn((1, "a", 2), iter([pd.DataFrame({"event_at": pd.to_datetime([None]), "aqi_value": [1.0]})]), none)) and not none.exists


def test_micro_batches_do_not_grow_with_the_files(spark):
    """a third of the files (all of them) were micro-batches, each a commit of every state partition."""
    from airlake.plans import q_streaming as Q
    for files in (1, 8, 200, 3000):
        conf = SimpleNamespace(conf=SimpleNamespace(get=lambda _: str(files)))
        n = Q._files_a_batch(conf)
        assert n >= 1 and -(-files // n) <= Q.PARTS
