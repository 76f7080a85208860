"""Polyline codec, exact rolling statistics, tolerant lag and the
registry contract."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake.operators import features as FE
from airlake.operators import polyline as PL


def test_polyline_roundtrip():
    pts = [{"lat": 38.5, "lon": -120.2}, {"lat": 40.7, "lon": -120.95}, {"lat": 43.252, "lon": -126.453}]
    enc = PL._encode(pts)
    assert enc == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"  # the format's published example
    assert PL._decode(enc) == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_rolling_matches_pandas(spark):
    vals = [10.1, None, 30.5, 22.2, 19.9, 50.0, None, 41.3, 12.2, 18.8]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)],
                               "city string, datetime timestamp_ntz, india_aqi double")
    out = df.select("datetime", FE.rolling_mean("india_aqi", 4, 2, "city", "datetime").alias("m"),
                    FE.rolling_std("india_aqi", 4, 2, "city", "datetime").alias("s")).orderBy("datetime").toPandas()
    s = pd.Series(vals, dtype=float).shift(1)
    want_m = s.rolling(4, min_periods=2).mean()
    want_s = s.rolling(4, min_periods=2).std()
    for a, b in zip(out["m"], want_m):
        assert (a is None or (isinstance(a, float) and math.isnan(a))) == math.isnan(b) or a == pytest.approx(b)
    for a, b in zip(out["s"], want_s):
        if not math.isnan(b):
            assert a == pytest.approx(b, rel=1e-9)


def test_tolerant_lag_order(spark):
    t0 = dt.datetime(2024, 1, 2, 12)
    hist = spark.createDataFrame([("c", t0 - dt.timedelta(hours=25), 1.0), ("c", t0 - dt.timedelta(hours=23), 2.0)],
                                 "city string, datetime timestamp_ntz, india_aqi double")
    tg = spark.createDataFrame([("c", t0)], "city string, target_dt timestamp_ntz")
    # exact hour missing: -1 h (value 1.0) comes before +1 h (value 2.0)
    assert FE.tolerant_lag(tg, hist, 24).first()["lag_24h"] == 1.0


def test_registry_contract():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 130
    assert set(o) <= set(q)
    from airlake.plans.registry import QUERIES
    assert set(QUERIES) <= set(q)
    for name in QUERIES:  # the library's own registry; the training-data queries are added by the entry alone
        assert not name.startswith("op") and "pipeline" not in name


def test_entry_runs(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) >= 1 and "rank" in rows[0].asDict()


def test_time_helpers_ignore_session_zone(spark):
    from airlake.functions import calendar as C
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp_ntz'1995-04-02 00:00:00' a")  # spring-forward day
        r = df.select(C.hours_between("a", C.add_seconds("a", 7452.0)).alias("h"),
                      C.add_seconds("a", 7452.0).alias("b"),
                      C.instant_to_ntz(C.ntz_to_instant("a")).alias("c")).first()
        assert r["h"] == pytest.approx(2.07)
        assert r["b"] == dt.datetime(1995, 4, 2, 2, 4, 12)
        assert r["c"] == dt.datetime(1995, 4, 2, 0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
