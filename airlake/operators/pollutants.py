"""Pollutant analysis (POL-*).

Unpivot turns the six pollutant columns into rows without a shuffle; the
standards table is a six-row literal joined by broadcast (its size is
fixed by the constants, not by the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stats import exact_mean

POLLUTANT_VALUE_COLUMNS = ["pm2_5_ugm3", "pm10_ugm3", "no2_ugm3", "so2_ugm3", "co_ugm3", "o3_ugm3"]


def unpivot_pollutants(facts: DataFrame, ids=("city", "datetime")) -> DataFrame:
    """POL-1: one row per (id, pollutant column) with a non-null value."""
    long = facts.select(*ids, *POLLUTANT_VALUE_COLUMNS).unpivot(
        list(ids), POLLUTANT_VALUE_COLUMNS, "column_name", "value")
    return long.filter(F.col("value").isNotNull())


def standards_table(spark) -> DataFrame:
    rows = [(i, name, col, std, K.POLLUTANT_UNIT) for i, (name, col, std) in enumerate(K.POLLUTANT_STANDARDS)]
    return spark.createDataFrame(rows, "position int, pollutant string, column_name string, "
                                       "national_standard double, unit string")


def pollutant_summary(facts: DataFrame, days: int = 7) -> DataFrame:
    """POL-2: per city, rows from the city's own newest time minus ``days``
    (inclusive): mean (2 decimals), share of rows strictly over the
    standard (1 decimal), status by the mean."""
    if not 1 <= days <= 30:
        raise ValueError("days must be within 1..30")
    newest = facts.groupBy(F.col("city").alias("_c")).agg(F.max("datetime").alias("_max"))
    recent = (facts.join(newest, F.col("city") == F.col("_c"))
              .filter(F.col("datetime") >= F.col("_max") - F.make_dt_interval(F.lit(days))))
    long = unpivot_pollutants(recent)
    std = F.broadcast(standards_table(facts.sparkSession))
    g = (long.join(std, "column_name").groupBy("city", "position", "pollutant", "column_name", "unit",
                                          "national_standard")
         .agg(exact_mean("value").alias("mean"),
              F.count("value").alias("n"),
              F.count(F.when(F.col("value") > F.col("national_standard"), 1)).alias("n_over")))
    return g.select(
        "city", "position", "pollutant", "column_name", "unit", "national_standard",
        F.round("mean", 2).alias("avg_concentration"),
        F.round(F.col("n_over") / F.col("n") * 100, 1).alias("pct_exceeding_standard"),
        F.when(F.col("mean") > F.col("national_standard"), F.lit("Exceeds standard"))
         .otherwise(F.lit("Within standard")).alias("status"))


def dominant_pollutant(summary: DataFrame) -> DataFrame:
    """POL-3: highest exceedance share; ties keep the table order."""
    key = F.struct(-F.col("pct_exceeding_standard"), F.col("position"))
    return summary.groupBy("city").agg(F.min_by("pollutant", key).alias("dominant"),
                                       F.max(F.when(F.col("pollutant") == "PM2.5",
                                                    F.col("pct_exceeding_standard"))).alias("pm25_pct"),
                                       F.max((F.col("pollutant") == "PM2.5").cast("int")).alias("has_pm25"))


def pollutant_narrative(summary: DataFrame, days: int = 7) -> DataFrame:
    """POL-4: sentence naming the dominant pollutant and PM2.5 exceedance."""
    d = dominant_pollutant(summary)
    pm = F.concat(F.lit("PM2.5 exceeded national standards "),
                  F.bround("pm25_pct", 0).cast("long").cast("string"), F.lit("% of the time."))
    text = F.concat(F.lit(f"Over the last {days} days in "), F.initcap("city"), F.lit(", "),
                    F.col("dominant"), F.lit(" is the dominant pollutant by exceedance frequency. "),
                    F.when(F.col("has_pm25") == 1, pm).otherwise(F.lit("")))
    return d.select("city", "dominant", text.alias("narrative"))


def share_of_standard(summary: DataFrame) -> DataFrame:
    """POL-5: min(100, mean / standard * 100) of the shown mean."""
    return summary.withColumn(
        "share_of_standard",
        F.least(F.lit(100.0), F.col("avg_concentration") / F.col("national_standard") * 100))
