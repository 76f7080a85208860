"""Golden scalars worked out by hand from the fixed band tables."""

import math

import pytest
from pyspark.sql import functions as F

from airlake.functions import aqi as A
from airlake.functions import calendar as C
from airlake.functions import constants as K
from airlake.functions import geo as G
from airlake.operators.risk import exposure_risk


def one(spark, col, value, dtype="double"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("v,expected", [
    (None, None), (-5.0, 0.0), (0.0, 0.0), (30.0, 50.0), (30.01, 51.0163333), (45.0, 75.5),
    (60.0, 100.0), (300.0, 420.8), (500.0, 500.0), (501.0, 500.0)])
def test_pm25_sub_index(spark, v, expected):
    got = one(spark, lambda c: A.sub_index(c, K.PM25_BANDS), v)
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected, abs=1e-6)


def test_india_aqi_max_of_subindices(spark):
    df = spark.createDataFrame([(45.0, 20.0, None, None, None, 1500.0)],
                               "pm2_5_ugm3 double, pm10_ugm3 double, no2_ugm3 double, so2_ugm3 double, "
                               "o3_ugm3 double, co_ugm3 double")
    # PM2.5 45 -> 75.5; CO 1.5 mg -> 75.5; PM10 20 -> 20
    assert df.select(A.india_aqi()).first()[0] == 75.5
    empty = spark.createDataFrame([(None,) * 6], df.schema)
    assert empty.select(A.india_aqi()).first()[0] is None


@pytest.mark.parametrize("aqi,cat", [(50.0, "Good"), (50.1, "Satisfactory"), (100.0, "Satisfactory"),
                                     (200.0, "Moderately Polluted"), (300.0, "Poor"), (400.0, "Very Poor"),
                                     (400.1, "Severe")])
def test_india_category(spark, aqi, cat):
    assert one(spark, A.india_category, aqi) == cat


def test_legacy_category_gap(spark):
    # 50.5 falls between the integer bands and ends as Severe
    assert one(spark, A.india_category_legacy, 50.5) == "Severe"
    assert one(spark, A.india_category_legacy, None) == "Unknown"


def test_legacy_negative_is_missing(spark):
    assert one(spark, lambda c: A.legacy_sub_index(c, K.LEGACY_PM25_BANDS), -1.0) is None


def test_us_aqi_half_even(spark):
    # 12 ug -> 50 exactly; 35.4 -> 100
    assert one(spark, A.us_aqi, 12.0) == 50.0
    assert one(spark, A.us_aqi, 35.4) == 100.0


@pytest.mark.parametrize("m,s", [(12, "winter"), (3, "summer"), (9, "monsoon"), (11, "post_monsoon")])
def test_season(spark, m, s):
    assert one(spark, C.season, m, "int") == s


@pytest.mark.parametrize("h,t", [(0, "night"), (6, "morning"), (12, "afternoon"), (18, "evening")])
def test_time_of_day(spark, h, t):
    assert one(spark, C.time_of_day, h, "int") == t


def test_exposure_risk_reference_example(spark):
    # AQI 150, age 30, no conditions, 8 h, resting, moderate: 0.5 * 0.6 * 100 = 30.0 (Moderate)
    df = spark.createDataFrame(
        [(150.0, 30, False, False, False, False, False, False, "moderate", 8.0, "resting")],
        "aqi double, age int, respiratory_disease boolean, heart_disease boolean, diabetes boolean, "
        "kidney_disease boolean, is_smoker boolean, is_pregnant boolean, sensitivity_level string, "
        "exposure_hours double, activity_level string")
    r = exposure_risk(df, with_text=True).first()
    assert r["risk_score"] == 30.0
    assert r["risk_category"] == "Moderate"
    assert r["explanation"].startswith("Your personalised risk score is 30/100 (Moderate). Current AQI is 150.")


def test_exposure_risk_caps_at_100(spark):
    df = spark.createDataFrame(
        [(480.0, 3, True, True, True, True, True, True, "very_high", 24.0, "intense")],
        "aqi double, age int, respiratory_disease boolean, heart_disease boolean, diabetes boolean, "
        "kidney_disease boolean, is_smoker boolean, is_pregnant boolean, sensitivity_level string, "
        "exposure_hours double, activity_level string")
    r = exposure_risk(df, with_text=True).first()
    assert r["risk_score"] == 100.0 and r["risk_category"] == "Severe"
    assert len(r["recommendations"]) == 4 + 6


def test_haversine_symmetric_and_known(spark):
    df = spark.createDataFrame([(28.6139, 77.2090, 19.0760, 72.8777)], "a double, b double, c double, d double")
    r = df.select(G.haversine_km("a", "b", "c", "d").alias("x"), G.haversine_km("c", "d", "a", "b").alias("y")).first()
    assert r["x"] == pytest.approx(r["y"], rel=1e-12)
    assert 1140 < r["x"] < 1160  # Delhi - Mumbai is about 1150 km


def test_direction_label(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0, 2.0, 5.0)], "a double, b double, c double, d double, e double, f double")
    assert df.select(G.direction_label("a", "b", "c", "d", "e", "f")).first()[0] == "Northern Route"
    assert not math.isnan(0.0)


def test_india_aqi_rounds_like_python_next_to_a_tie(spark):
    """1.25 * 21.08 is 26.349999999999998 in binary: one decimal gives 26.3."""
    cols = ["pm2_5_ugm3", "pm10_ugm3", "no2_ugm3", "so2_ugm3", "o3_ugm3", "co_ugm3"]
    x = [21.08, 21.24, 48.03, 7.5]
    df = spark.createDataFrame([(None, None, v, None, None, None) for v in x], ", ".join(f"{c} double" for c in cols))
    got = [r[0] for r in df.select(A.india_aqi()).collect()]
    want = [round(50 / 40 * v, 1) if v <= 40 else round((100 - 51) / (80 - 40) * (v - 40) + 51, 1) for v in x]
    assert got == want and got[0] == 26.3
