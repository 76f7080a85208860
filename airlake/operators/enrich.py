"""Row enrichment (ENR-*): every derived column is a Spark expression.

``add_derived`` is one projection, so Catalyst fuses it with the scan and
the neighbouring filters into a single whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import calendar as C
from ..functions import constants as K


def add_calendar(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """ENR-10..12: month, lower day name, weekend flag, season, time of day."""
    t = F.col(ts)
    return df.withColumns({
        "month": F.month(t),
        "day_name": C.day_name(t),
        "is_weekend": C.is_weekend(t),
        "season": C.season(F.month(t)),
        "time_of_day": C.time_of_day(F.hour(t)),
    })


def add_rain_flags(df: DataFrame, precip: str = "precipitation_mm") -> DataFrame:
    """ENR-13."""
    return df.withColumns({"is_raining": C.is_raining(precip), "heavy_rain": C.heavy_rain(precip)})


def add_context_flags(df: DataFrame, ts: str = "datetime", city: str = "city",
                      festival_dates=K.FESTIVAL_DATES,
                      crop_cities=K.CROP_BURNING_CITIES) -> DataFrame:
    """ENR-14, ENR-15."""
    return df.withColumns({
        "festival_period": C.festival(ts, festival_dates),
        "crop_burning_season": C.crop_burning(F.month(ts), city, crop_cities),
    })


def add_aqi(df: DataFrame) -> DataFrame:
    """ENR-3, 5, 7, 8, 9."""
    df = df.withColumns({
        "india_aqi": A.india_aqi(),
        "us_aqi": A.us_aqi("pm2_5_ugm3"),
        "pm25_category_india": A.pm25_category("pm2_5_ugm3"),
    })
    return df.withColumns({
        "india_aqi_category": A.india_category("india_aqi"),
        "aqi_category": A.us_category("us_aqi"),
    })


def add_derived(df: DataFrame, ts: str = "datetime", city: str = "city",
                festival_dates=K.FESTIVAL_DATES, crop_cities=K.CROP_BURNING_CITIES) -> DataFrame:
    """ENR-17: all derived columns of the hourly fact table."""
    return (df.transform(add_calendar, ts)
            .transform(add_rain_flags)
            .transform(add_context_flags, ts, city, festival_dates, crop_cities)
            .transform(add_aqi))


def add_legacy_aqi(df: DataFrame) -> DataFrame:
    """ENR-4 + ENR-6: training-set formula and its category."""
    df = df.withColumn("india_aqi_legacy", A.india_aqi_legacy())
    return df.withColumn("india_aqi_category_legacy", A.india_category_legacy("india_aqi_legacy"))


def aqi_coverage(df: DataFrame, aqi: str = "india_aqi") -> DataFrame:
    """ENR-18: share of rows with a computed AQI (percent, 2 decimals)."""
    return df.agg(F.count("*").alias("rows"),
                  F.count(aqi).alias("rows_with_aqi"),
                  F.round(F.count(aqi) * 100.0 / F.count("*"), 2).alias("coverage_pct"))


def category_counts(df: DataFrame, category: str = "india_aqi_category") -> DataFrame:
    """ENR-18: rows per category (NULL category counted as its own group)."""
    return df.groupBy(category).agg(F.count("*").alias("rows"))
