"""Shared inputs of the registered queries: enriched facts and friends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import add_derived
from ..operators.features import hourly_series
from ..sources import fixtures as X


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings with city attributes and all ENR-17 columns."""
    r = X.readings(spark, sf_dir)
    s = X.stations(spark, sf_dir).select("station_id", "city_id")
    c = X.cities(spark, sf_dir).select("city_id", F.col("name").alias("city"), "state",
                                       "latitude", "longitude")
    return add_derived(r.join(s, "station_id").join(c, "city_id"))


def hourly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input: the facts of every city as a gapless hourly series."""
    return hourly_series(facts(spark, sf_dir))


def as_of(df: DataFrame, ts: str = "datetime") -> Column:
    """Scalar subquery: newest timestamp of ``df``. Catalyst runs it once
    and folds it into the consuming filter; nothing passes the driver."""
    return df.agg(F.max(ts)).scalar()
