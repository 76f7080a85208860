"""Targets that cannot be read stay as they are; the recursive forecast against a plain version."""

import os

import numpy as np
import pandas as pd
import pytest

from airlake.functions import constants as K
from airlake.operators import forecast, merge
from airlake.operators.features import FEATURE_COLS, TARGET


def test_reseed_leaves_an_unreadable_target(spark, tmp_path):
    path = tmp_path / "facts"
    path.mkdir()
    (path / "part-00000.parquet").write_bytes(b"not parquet")
    rows = spark.sql("SELECT 1L AS station_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS datetime, 1.0D AS aqi")
    with pytest.raises(Exception):
        merge.reseed(spark, str(path), rows)
    assert (path / "part-00000.parquet").read_bytes() == b"not parquet" and os.listdir(path) == ["part-00000.parquet"]
    new = str(tmp_path / "new")
    assert merge.reseed(spark, new, rows) == "created" and merge.reseed(spark, new, rows) == "skipped"
    assert spark.read.parquet(new).count() == 1


def test_recursive_forecast():
    r = np.random.default_rng(1)
    hours = pd.date_range("2024-09-25", periods=170, freq="h")
    hours = hours[r.random(170) > 0.1]
    pdf = pd.DataFrame({"city": "x", "datetime": hours, TARGET: r.random(len(hours)) * 100 + 50, "intercept": 5.0})
    for f in FEATURE_COLS:
        pdf[f"coef_{f}"] = float(r.normal() * 0.02)
    got = forecast._recursive(pdf.sample(frac=1, random_state=0), 60, "city", FEATURE_COLS)
    known = dict(zip(pdf["datetime"], pdf[TARGET]))
    for t, aqi in zip(got["target_dt"], got["aqi"]):
        def near(x):
            for step in (0, -1, 1, -2, 2):
                if x + pd.Timedelta(hours=step) in known:
                    return known[x + pd.Timedelta(hours=step)]
            return np.mean(list(known.values()))
        past = pd.Series(known).sort_index()
        flag = t.month in K.FESTIVAL_PROXY_MONTHS
        want = {"hour": t.hour, "day_of_week": t.weekday(), "month": t.month, "day_of_year": t.dayofyear, "week_of_year": t.week,
                "is_weekend": t.weekday() >= 5, "season_enc": next(K.SEASON_CODES[n] for n, m in K.SEASONS if t.month in m),
                "festival_period": flag, "crop_burning_season": flag, "is_raining": K.WEATHER_DEFAULTS.get("precipitation_mm", 0.0) > 0,
                **K.WEATHER_DEFAULTS, **{f"lag_{n}h": near(t - pd.Timedelta(hours=n)) for n in K.LAG_HOURS}}
        for label, n in (("24h", 24), ("3d", 72), ("7d", 168), ("14d", 336)):
            want[f"rolling_{label}_mean"], want[f"rolling_{label}_std"] = past.tail(n).mean(), past.tail(n).std()
        value = 5.0 + sum(float(want[f]) * pdf[f"coef_{f}"].iloc[0] for f in FEATURE_COLS)
        value = min(K.FORECAST_CLIP_MAX, max(K.FORECAST_CLIP_MIN, value))
        assert abs(value - aqi) < 1e-6
        known[t] = value


def test_null_stays_null(spark):
    from pyspark.sql import functions as F

    from airlake.functions import risk
    row = spark.range(1).select(risk.base_score(F.lit(None).cast("double")).alias("a"), risk.duration_multiplier(F.lit(None).cast("double")).alias("b"),
                                risk.base_score(F.lit(700.0)).alias("c")).first()
    assert row.a is None and row.b is None and row.c == 1.0


def test_constant_column_gets_no_coefficient(spark):
    from airlake.operators.models import fit_ridge
    r = np.random.default_rng(0)
    x = r.random(600) * 10
    df = spark.createDataFrame(pd.DataFrame({"city": "x", "x": x, "p": 1013.0, "y": 3 * x + 7}))
    m = fit_ridge(df, ["x", "p"], "y", min_rows=100).first()
    assert m.coef_p == 0.0 and abs(m.coef_x - 3) < 0.05 and abs(m.intercept - 7) < 0.3
