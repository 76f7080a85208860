"""Landed payload files derived from the supplied tables by Spark jobs.

The source readers (SRC-*) and sinks are exercised on files that Spark
writes from the driver tables, so their volume grows with the tables.
Files go under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import fixtures as X
from ..sources.landing import POLLUTANT_FIELDS, WEATHER_FIELDS


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "landed", f"{name}-{uuid.uuid4().hex[:12]}")


def _hourly_payloads(df: DataFrame, fields: dict) -> DataFrame:
    """One payload per (station, day): parallel arrays in time order (at
    most 24 entries per group)."""
    inv = {v: k for k, v in fields.items()}
    present = [c for c in fields.values() if c in df.columns]
    row = F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm").alias("time"),
                   *[F.col(c).alias(inv[c]) for c in present])
    g = (df.groupBy("station_id", F.to_date("datetime").alias("day"))
         .agg(F.array_sort(F.collect_list(row)).alias("rows")))
    def field(name):
        return lambda r: r[name]
    hourly = F.struct(F.transform("rows", field("time")).alias("time"),
                      *[F.transform("rows", field(inv[c])).alias(inv[c]) for c in present])
    return g.select("station_id", hourly.alias("hourly"))


def weather_payloads(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "weather")
    _hourly_payloads(X.readings(spark, sf), WEATHER_FIELDS).write.json(path)
    return path


def pollutant_payloads(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "pollutants")
    _hourly_payloads(X.readings(spark, sf), POLLUTANT_FIELDS).write.json(path)
    return path


def measurement_payloads(spark: SparkSession, sf: str) -> str:
    """One payload per (station, parameter, day) with results carrying
    local (+05:30) and UTC times."""
    m = X.measurements(spark, sf)
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    local = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(5), F.lit(30)),
                          "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
    r = F.struct(F.col("ts").alias("_ts"), F.col("measurement_id").alias("_id"),
                 F.struct(local.alias("local"), utc.alias("utc")).alias("datetime"), F.col("value"))
    g = (m.groupBy("station_id", F.col("pollutant").alias("parameter"), F.to_date("ts").alias("day"))
         .agg(F.array_sort(F.collect_list(r)).alias("rs")))
    out = g.select("station_id", F.xxhash64("station_id", "parameter").alias("sensor_id"), "parameter",
                   F.transform("rs", lambda x: F.struct(x["datetime"].alias("datetime"),
                                                        x["value"].alias("value"))).alias("results"))
    path = scratch(spark, "measurements")
    out.write.json(path)
    return path


def wide_csv(spark: SparkSession, facts: DataFrame) -> str:
    """The facts as the 35-column wide CSV; even hours in ISO text, odd
    hours in ``M/d/yyyy H:mm`` (both formats occur in the original data)."""
    from ..functions import constants as K
    iso = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
    us = F.date_format("datetime", "M/d/yyyy H:mm")
    f = facts.withColumn("datetime", F.when(F.hour("datetime") % 2 == 0, iso).otherwise(us))
    f = f.withColumns({c: F.lit(None).cast("double") for c in K.CANONICAL_COLUMNS if c not in f.columns})
    path = scratch(spark, "csv")
    f.select(*K.CANONICAL_COLUMNS).write.option("header", True).csv(path)
    return path
