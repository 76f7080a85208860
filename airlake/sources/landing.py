"""Readers for landed payload files (SRC-1..8).

Every reader takes an explicit schema (no inference) and turns the
payload's parallel arrays into rows with ``arrays_zip`` + ``explode``, so
a directory of thousands of payloads is read in parallel by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K

# FIXED VALUES - payload field -> fact column
WEATHER_FIELDS = {"temperature_2m": "temperature_c", "relative_humidity_2m": "humidity_percent",
                  "dew_point_2m": "dew_point_c", "precipitation": "precipitation_mm",
                  "cloud_cover": "cloud_cover_percent", "pressure_msl": "pressure_msl_hpa",
                  "wind_speed_10m": "wind_speed_kmh", "wind_gusts_10m": "wind_gusts_kmh"}
POLLUTANT_FIELDS = {"pm10": "pm10_ugm3", "pm2_5": "pm2_5_ugm3", "carbon_monoxide": "co_ugm3",
                    "nitrogen_dioxide": "no2_ugm3", "sulphur_dioxide": "so2_ugm3", "ozone": "o3_ugm3",
                    "dust": "dust_ugm3", "aerosol_optical_depth": "aod"}
LOCAL_OFFSET = "+05:30"


def _hourly_schema(fields) -> T.StructType:
    inner = [T.StructField("time", T.ArrayType(T.StringType()))]
    inner += [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields]
    return T.StructType([T.StructField("station_id", T.LongType()),
                         T.StructField("hourly", T.StructType(inner))])


WEATHER_SCHEMA = _hourly_schema(WEATHER_FIELDS)
POLLUTANT_SCHEMA = _hourly_schema(POLLUTANT_FIELDS)
MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("sensor_id", T.LongType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("datetime", T.StructType([T.StructField("local", T.StringType()),
                                                T.StructField("utc", T.StringType())])),
        T.StructField("value", T.DoubleType())])))])


def _explode_hourly(df: DataFrame, fields: dict) -> DataFrame:
    # a missing array (field absent from the payload) becomes empty, so the
    # zip pads it with NULLs instead of dropping the whole payload
    arrays = [F.col("hourly.time").alias("time")] + [
        F.coalesce(F.col(f"hourly.{f}"), F.array().cast("array<double>")).alias(f) for f in fields]
    x = df.filter(F.col("hourly.time").isNotNull()).select("station_id", F.explode(F.arrays_zip(*arrays)).alias("r"))
    x = x.filter(F.col("r.time").isNotNull())
    return x.select("station_id", F.to_timestamp_ntz(F.col("r.time")).alias("datetime"),
                    *[F.col(f"r.{f}").alias(c) for f, c in fields.items()])


def weather_from_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: one row per index of the parallel hourly arrays; renamed
    columns; an empty payload gives no rows."""
    return _explode_hourly(spark.read.schema(WEATHER_SCHEMA).json(path), WEATHER_FIELDS)


def pollutants_from_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2."""
    return _explode_hourly(spark.read.schema(POLLUTANT_SCHEMA).json(path), POLLUTANT_FIELDS)


def measurements_from_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: long readings; time = local else UTC text, parsed with its
    zone, shifted to IST and made zone-less; NULL or unparsable time and
    NULL values dropped; for a repeated (sensor, time) the last wins."""
    df = spark.read.schema(MEASUREMENT_SCHEMA).json(path)
    x = df.select("station_id", "sensor_id", "parameter",
                  F.posexplode("results").alias("seq", "r"))
    txt = F.coalesce(F.col("r.datetime.local"), F.col("r.datetime.utc"))
    ts = F.try_to_timestamp(txt, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    # instant -> wall time in the session zone -> wall time at +05:30,
    # so the result does not depend on the session's time zone
    zone = spark.conf.get("spark.sql.session.timeZone")
    ist = F.convert_timezone(F.lit(zone), F.lit(LOCAL_OFFSET), ts.cast("timestamp_ntz"))
    x = x.select("station_id", "sensor_id", "parameter", "seq", ist.alias("ts"),
                 F.col("r.value").alias("value")).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return (x.groupBy("station_id", "sensor_id", "parameter", "ts")
            .agg(F.max_by("value", "seq").alias("value")))


CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in K.CANONICAL_COLUMNS])
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm"]


def parse_datetime(c) -> F.Column:
    """Mixed ``M/d/yyyy H:mm`` and ISO text; unparsable -> NULL."""
    c = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATETIME_FORMATS]).cast("timestamp_ntz")


def coerce_bool(c, loose: bool = False) -> F.Column:
    """SRC-5: True/"True" -> true, everything else false; ``loose``
    accepts true/1/yes in any case (the seed loader)."""
    s = F.lower(F.trim(c.cast("string")))
    ok = ("true", "1", "yes") if loose else ("true",)
    return F.coalesce(s.isin(*ok), F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """SRC-6: NaN -> NULL in every floating column."""
    cols = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols)


BOOL_COLUMNS = ["is_weekend", "is_raining", "heavy_rain", "festival_period", "crop_burning_season"]
TEXT_COLUMNS = ["city", "state", "datetime", "day_name", "season", "time_of_day", "india_aqi_category",
                "aqi_category", "pm25_category_india"]


def read_readings_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: the 35-column wide CSV read as text with a fixed schema;
    datetimes in both formats, unparsable rows dropped; city lower+trim;
    numbers via try_cast; flags via SRC-5."""
    df = spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)
    cols = {}
    for c in K.CANONICAL_COLUMNS:
        if c == "datetime":
            cols[c] = parse_datetime(F.col(c))
        elif c in ("city", "state"):
            cols[c] = F.lower(F.trim(F.col(c)))
        elif c in BOOL_COLUMNS:
            cols[c] = coerce_bool(F.col(c))
        elif c == "month":
            cols[c] = F.col(c).try_cast("double").cast("int")
        elif c in TEXT_COLUMNS:
            cols[c] = F.col(c)
        else:
            cols[c] = F.col(c).try_cast("double")
    return nan_to_null(df.select(*[cols[c].alias(c) for c in K.CANONICAL_COLUMNS])).filter(
        F.col("datetime").isNotNull())


def training_frame(facts: DataFrame, stations: DataFrame, cities: DataFrame) -> DataFrame:
    """SRC-7: facts with city name (lower case), non-null target."""
    s = stations.select("station_id", "city_id")
    c = cities.select("city_id", F.lower("name").alias("city"))
    f = facts.drop("city", "city_id") if "city" in facts.columns else facts
    return f.join(s, "station_id").join(c, "city_id").filter(F.col("india_aqi").isNotNull())


def recent_slice(df: DataFrame, days: int, cities: DataFrame | None = None) -> DataFrame:
    """SRC-8: rows with datetime >= the global newest - days (one global
    maximum, as the original); unknown cities dropped when a city table
    is given."""
    newest = df.agg(F.max("datetime")).scalar()
    out = df.filter(F.col("datetime") >= newest - F.make_dt_interval(F.lit(days)))
    if cities is not None:
        out = out.join(cities.select(F.lower("name").alias("city")), "city", "left_semi")
    return out
