"""Ingest merge, incremental load and sinks (MRG-*, SNK-1).

Incremental loads are set operations: a batch is de-duplicated on its
natural key (station, datetime) with a partial ``max_by`` aggregate and
anti-joined against the target's keys; nothing is looped per station.
Progress is tracked per station (the original used one global maximum,
which never back-fills a lagging station).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import calendar as C
from ..functions import constants as K
from ..functions.stats import exact_avg

PARAMETERS = ["pm2_5", "pm10", "no2", "so2", "o3", "co"]
PARAMETER_COLUMNS = {"pm2_5": "pm2_5_ugm3", "pm10": "pm10_ugm3", "no2": "no2_ugm3", "so2": "so2_ugm3",
                     "o3": "o3_ugm3", "co": "co_ugm3"}
KEY = ["station_id", "datetime"]


def sensor_map(measurements: DataFrame) -> DataFrame:
    """GEO-4: sensor per (station, parameter); the last (highest) sensor id
    wins; stations without wanted parameters drop out."""
    return (measurements.filter(F.col("pollutant").isin(*PARAMETERS))
            .groupBy("station_id", F.col("pollutant").alias("parameter"))
            .agg(F.max("measurement_id").alias("sensor_id")))


# FIXED VALUES - parameters as the sensor service names them, and their columns
SENSOR_COLUMNS = {"pm2.5": "pm2_5_ugm3", "pm10": "pm10_ugm3", "no2": "no2_ugm3",
                  "so2": "so2_ugm3", "o3": "o3_ugm3", "co": "co_ugm3"}


def city_sensors(cities: DataFrame, locations: DataFrame, max_km: float = 50.0) -> DataFrame:
    """GEO-4: city, loc_id, loc_name, dist_km (1 decimal) and sensors (map from
    fact column to sensor id) of the nearest location of every city.

    ``locations`` has loc_id, loc_name, latitude, longitude and ``sensors``, a
    list of (id, parameter). Locations without coordinates are not looked at;
    of equally near ones the smallest id counts. Parameters are matched without
    regard to case, and the last sensor of a parameter wins. Cities whose
    nearest location is farther than ``max_km``, or has no wanted sensor, drop.
    """
    from .routes import nearest
    points = cities.select(F.col("name").alias("city"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = nearest(points, ["city"], locations.filter("latitude is not null and longitude is not null"), "loc_id")
    near = near.filter(F.col("nearest_km") <= max_km)

    def last(name: str, column: str) -> Column:
        ids = F.transform(F.filter("sensors", lambda s: F.lower(s["parameter"]) == name), lambda s: s["id"])
        return F.when(F.size(ids) > 0, F.struct(F.lit(column).alias("key"), F.element_at(ids, -1).alias("value")))

    found = F.map_from_entries(F.array_compact(F.array(*[last(n, c) for n, c in SENSOR_COLUMNS.items()])))
    mapped = locations.filter(F.col("sensors").isNotNull()).select("loc_id", "loc_name", found.alias("sensors"))
    return (near.join(mapped, near["nearest_id"] == mapped["loc_id"]).filter(F.size("sensors") > 0)
            .select("city", "loc_id", "loc_name", F.round("nearest_km", 1).alias("dist_km"), "sensors"))


def resample_hourly(long: DataFrame, spine: bool = False, scale: int = 2) -> DataFrame:
    """MRG-1: mean per station, hour and parameter, pivoted wide over the
    fixed parameter list (no extra job to discover values). With
    ``spine``, hours without data inside each station's range appear as
    NULL rows."""
    g = (long.withColumn("datetime", C.hour_floor("ts"))
         .groupBy("station_id", "datetime").pivot("pollutant", PARAMETERS)
         .agg(exact_avg("value", scale)))
    g = g.select("station_id", "datetime", *[F.col(p).alias(PARAMETER_COLUMNS[p]) for p in PARAMETERS])
    if not spine:
        return g
    rng = g.groupBy("station_id").agg(F.min("datetime").alias("_a"), F.max("datetime").alias("_b"))
    hours = rng.select("station_id", F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR"))).alias("datetime"))
    return hours.join(g, KEY, "left")


def merge_weather_pollutants(weather: DataFrame, pollutants: DataFrame) -> DataFrame:
    """MRG-2: weather is the spine; pollutants LEFT joined on the hour."""
    return weather.join(pollutants, KEY, "left")


def prefer_measured(measured: DataFrame, modelled: DataFrame, min_rows: int = 5) -> DataFrame:
    """MRG-3: per station, the measured rows when there are more than
    ``min_rows`` of them, else the modelled rows; tagged with ``source``."""
    n = measured.groupBy("station_id").agg(F.count("*").alias("_n"))
    good = n.filter(F.col("_n") > min_rows).select("station_id")
    m = measured.join(good, "station_id", "left_semi").withColumn("source", F.lit("measured"))
    o = modelled.join(good, "station_id", "left_anti").withColumn("source", F.lit("modelled"))
    return m.unionByName(o, allowMissingColumns=True)


def fill_missing_columns(df: DataFrame, cols=("dust_ugm3", "aod")) -> DataFrame:
    """MRG-4: absent columns become NULL doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in cols if c not in df.columns})


def attach_city_constants(df: DataFrame, stations: DataFrame, cities: DataFrame) -> DataFrame:
    """MRG-5: city, state, latitude and longitude on each row (dimension
    joins; the dimensions go under the size-checked broadcast threshold)."""
    s = stations.select("station_id", "city_id")
    c = cities.select("city_id", F.col("name").alias("city"), "state", "latitude", "longitude")
    return df.join(s, "station_id").join(c, "city_id")


def time_window_filter(df: DataFrame, start: Column, end: Column, ts: str = "datetime") -> DataFrame:
    """MRG-6: both ends inclusive."""
    return df.filter(F.col(ts).between(start, end))


def union_cities(*dfs: DataFrame) -> DataFrame:
    """MRG-7: concatenation by column name (ordering belongs to the sink)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_city_frames(spark: SparkSession, path: str, key: str = "city") -> DataFrame:
    """MRG-7 over landed frames, one folder ``<key>=<value>`` per city: one scan
    of all of them, columns matched by name, missing ones NULL."""
    return (spark.read.option("mergeSchema", True).parquet(path)
            .withColumn(key, F.col(key).cast("long") if key.endswith("_id") else F.col(key).cast("string")))


def canonical_columns(df: DataFrame) -> DataFrame:
    """MRG-8: the wide CSV column order; missing columns skipped."""
    return df.select(*[c for c in K.CANONICAL_COLUMNS if c in df.columns])


DEFAULT_START = "2025-11-26 23:00:00"


def plan_gaps(facts: DataFrame, stations: DataFrame, as_of: Column,
              override_start: str | None = None) -> DataFrame:
    """MRG-9: per station, from = newest + 1 h (floored to the hour), to =
    as_of floored; ``needs_fetch`` when from < to; past_days =
    clamp(ceil(gap hours / 24) + 1, 2, 92); historical when the gap > 120 h.
    Stations without data start at the default (or override) start."""
    newest = facts.groupBy("station_id").agg(F.max("datetime").alias("newest"))
    s = stations.select("station_id").join(newest, "station_id", "left")
    start = (F.lit(override_start).cast("timestamp_ntz") if override_start else
             F.coalesce(C.hour_floor(F.col("newest") + F.make_dt_interval(F.lit(0), F.lit(1))),
                        F.lit(DEFAULT_START).cast("timestamp_ntz")))
    end = C.hour_floor(as_of)
    gap_h = C.hours_between(start, end)
    return s.select("station_id", "newest", start.alias("fetch_from"), end.alias("fetch_to"),
                    (start < end).alias("needs_fetch"), gap_h.alias("gap_hours"),
                    F.greatest(F.lit(2), F.least(F.lit(92), F.ceil(gap_h / 24) + 1)).cast("int").alias("past_days"),
                    (gap_h > 120).alias("historical"))


def dedupe_batch(batch: DataFrame, order: str | None = None, key=KEY) -> DataFrame:
    """One row per key; the first row (smallest ``order``) wins. Partial
    aggregation, so a repeated key is combined map-side."""
    if order is None:
        return batch.dropDuplicates(list(key))
    others = [c for c in batch.columns if c not in key]
    return (batch.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
            .select(*key, "_r.*"))


def insert_new(target: DataFrame, batch: DataFrame, order: str | None = None, key=KEY) -> DataFrame:
    """MRG-10: the batch rows to append: de-duplicated on the key (first
    wins), minus keys already in the target. The key is unique by
    construction afterwards (the original had no unique constraint)."""
    b = dedupe_batch(batch, order, key)
    return b.join(target.select(*key), list(key), "left_anti")


def append_distinct(existing: DataFrame, new: DataFrame, key=("city", "datetime")) -> DataFrame:
    """MRG-11: existing rows plus new rows whose key is not there yet."""
    add = new.join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(add, allowMissingColumns=True)


def rows_after(source: DataFrame, target: DataFrame, ts: str = "datetime") -> DataFrame:
    """MRG-12: source rows newer than the target's newest time (a scalar
    subquery), with the US category added."""
    newest = target.agg(F.max(ts)).scalar()
    out = source.filter(F.col(ts) > newest)
    if "us_aqi" in out.columns:
        out = out.withColumn("aqi_category", A.us_category("us_aqi"))
    return out


def gap_insert(batch: DataFrame, facts: DataFrame, per_station: bool = True) -> DataFrame:
    """MRG-13: only rows after the newest fact time; per station by
    default (global maximum with ``per_station=False``)."""
    if not per_station:
        return batch.filter(F.col("datetime") > facts.agg(F.max("datetime")).scalar())
    newest = facts.groupBy(F.col("station_id").alias("_s")).agg(F.max("datetime").alias("_m"))
    j = batch.join(newest, F.col("station_id") == F.col("_s"), "left")
    return j.filter(F.col("_m").isNull() | (F.col("datetime") > F.col("_m"))).drop("_s", "_m")


def retain(facts: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """MRG-14: keep the last ``days`` days (date-partitioned sinks can drop
    whole partitions instead)."""
    return facts.filter(F.col("datetime") >= as_of - F.make_dt_interval(F.lit(days)))


def station_code(name: Column) -> Column:
    return F.concat(F.upper(F.regexp_replace(name, " ", "_")), F.lit("_CSV"))


def station_name(name: Column) -> Column:
    return F.concat(F.initcap(name), F.lit(" (CSV Aggregate)"))


def dimension_insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """MRG-15: rows of ``new`` whose ``key`` is absent from ``existing``."""
    return new.join(existing.select(key), key, "left_anti")


def freshness(facts: DataFrame, as_of: Column, stale_hours: int = 2) -> DataFrame:
    """MRG-16: rows, newest time, whole hours since it, stale flag."""
    a = facts.agg(F.count("*").alias("rows"), F.max("datetime").alias("newest"))
    gap = F.floor(C.hours_between(F.col("newest"), as_of)).cast("long")
    return a.select("rows", "newest", gap.alias("gap_hours"),
                    (F.col("newest").isNull() | (gap > stale_hours)).alias("stale"))


def run_summary(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """MRG-17: per city: fetched and inserted rows, date range; the
    distinct-city count is the row count of the result."""
    f = batch.groupBy("city").agg(F.count("*").alias("fetched"), F.min("datetime").alias("date_from"),
                                  F.max("datetime").alias("date_to"))
    i = inserted.groupBy("city").agg(F.count("*").alias("inserted"))
    return f.join(i, "city", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def insert_with_totals(target: DataFrame, batch: DataFrame, path: str, sources=("measured", "modelled"),
                       source: str = "source", order: str | None = None, key=KEY) -> dict:
    """MRG-17 in the pass that writes: appends the batch's new rows to the
    Parquet folder ``path`` and returns the run's totals: rows_fetched,
    rows_inserted, start_dt, end_dt, and rows_<source> of each given source.

    The totals are observed on the rows as they pass, so the batch is read once.
    An empty batch gives zeros and no dates."""
    fetched, added = Observation("fetched"), Observation("added")
    per_source = [F.count(F.when(F.col(source) == s, F.lit(1))).alias(f"rows_{s}") for s in sources]
    seen = batch.observe(fetched, F.count(F.lit(1)).alias("rows_fetched"), F.min("datetime").alias("start_dt"),
                         F.max("datetime").alias("end_dt"), *per_source)
    new = insert_new(target, seen, order, key).observe(added, F.count(F.lit(1)).alias("rows_inserted"))
    new.write.mode("append").parquet(path)
    return {**fetched.get, **added.get}


def export_frame(df: DataFrame) -> DataFrame:
    """MRG-18 shape: ISO ``yyyy-MM-dd HH:mm:ss`` datetime text and the US
    category column."""
    out = df.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    if "us_aqi" in df.columns:
        out = out.withColumn("aqi_category", A.us_category("us_aqi"))
    return out


def export_csv(df: DataFrame, path: str) -> None:
    """MRG-18: append as CSV with a header."""
    export_frame(df).write.mode("append").option("header", True).csv(path)


def left_merge_weather(df: DataFrame, weather: DataFrame, key: str = "city") -> DataFrame:
    """MRG-19: both sides floored to the hour, the old weather columns
    dropped first, LEFT join on (key, hour); adds ``has_weather``."""
    wcols = [c for c in weather.columns if c not in (key, "datetime")]
    base = df.drop(*[c for c in wcols if c in df.columns]).withColumn("_hour", C.hour_floor("datetime"))
    w = weather.withColumn("_hour", C.hour_floor("datetime")).drop("datetime").withColumn("_w", F.lit(True))
    j = base.join(w, [key, "_hour"], "left").drop("_hour")
    return j.withColumn("has_weather", F.coalesce("_w", F.lit(False))).drop("_w")


def weather_coverage(merged: DataFrame) -> DataFrame:
    """MRG-19 coverage: share of rows that found weather, percent."""
    return merged.agg(F.round(F.avg(F.col("has_weather").cast("double")) * 100, 2).alias("coverage_pct"))


def write_facts(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-1: Parquet partitioned by date, sorted by station within files.

    The rows are rebalanced by date: a day with most of the rows is split over
    several tasks and files, small days share a task. ``overwrite`` replaces the
    whole table, ``days`` the days that ``df`` holds and leaves the others."""
    overwrite = "dynamic" if mode == "days" else "static"
    (df.withColumn("date", F.to_date("datetime")).hint("rebalance", F.col("date"))
     .sortWithinPartitions("date", "station_id", "datetime")
     .write.mode("overwrite" if mode == "days" else mode).option("partitionOverwriteMode", overwrite)
     .partitionBy("date").parquet(path))


def read_days(spark: SparkSession, path: str, first, last) -> DataFrame:
    """The facts of the days ``first`` to ``last`` (dates, inclusive): only
    their folders are listed and read."""
    return spark.read.parquet(path).filter(F.col("date").between(F.lit(first), F.lit(last)))


def drop_days(spark: SparkSession, path: str, before) -> list[str]:
    """MRG-14 on the sink: removes the folders of the days before a date and
    returns their names. No row is read or rewritten."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(top) if f.isDirectory())
    old = [n for n in names if n.startswith("date=") and n[5:] < str(before)]
    for n in old:
        fs.delete(hadoop.Path(top, n), True)
    return old


def reseed(spark, target_path: str, source: DataFrame, mode: str = "skip", key=KEY) -> str:
    """MRG-20: non-empty target: ``skip`` (default) leaves it, ``replace``
    overwrites it, ``missing`` appends only absent keys. Returns the action."""
    from ..session import has_files
    # an unreadable target raises here and is left as it is; only an absent or empty one is created
    target = spark.read.parquet(target_path) if has_files(spark, target_path) else None
    empty = target is None or target.isEmpty()
    if empty:
        write_facts(source, target_path, "overwrite")
        return "created"
    if mode == "skip":
        return "skipped"
    if mode == "replace":
        write_facts(source, target_path, "overwrite")
        return "replaced"
    if mode == "missing":
        write_facts(insert_new(target, source, None, key).drop("date"), target_path, "append")
        return "appended"
    raise ValueError("mode must be skip, replace or missing")
