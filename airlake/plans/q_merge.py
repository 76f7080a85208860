"""Registered ingest, merge, incremental-load, source and sink queries
(MRG-*, SRC-*, SNK-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import constants as K
from ..functions.stats import exact_avg_sql
from ..operators import merge as M
from ..sources import fixtures as X
from ..sources import landing as L
from . import landed
from .inputs import as_of, facts
from .registry import register

WEATHER = ["temperature_c", "humidity_percent", "precipitation_mm", "wind_speed_kmh"]
POLL = ["pm2_5_ugm3", "pm10_ugm3", "no2_ugm3", "so2_ugm3", "o3_ugm3"]
NOW = "(SELECT max(datetime) FROM facts)"
RESAMPLE_SQL = f"""
SELECT station_id, date_trunc('hour', ts) AS datetime,
  {', '.join(f"{exact_avg_sql('value', 2, f'''pollutant = '{p}' ''')} AS {M.PARAMETER_COLUMNS[p]}"
             for p in M.PARAMETERS)}
FROM measurements GROUP BY 1, 2"""


@register("mrg_resample_hourly", RESAMPLE_SQL)
def mrg_resample_hourly(spark, sf):
    return M.resample_hourly(X.measurements(spark, sf))


@register("mrg_resample_hourly_spine", f"""
WITH g AS ({RESAMPLE_SQL}),
h AS (SELECT station_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
      FROM g GROUP BY 1)
SELECT h.station_id, h.datetime, {', '.join(f'g.{c}' for c in M.PARAMETER_COLUMNS.values())}
FROM h LEFT JOIN g USING (station_id, datetime)""")
def mrg_resample_hourly_spine(spark, sf):
    return M.resample_hourly(X.measurements(spark, sf), spine=True)


@register("mrg_merge_weather_pollutants", f"""
WITH g AS ({RESAMPLE_SQL})
SELECT r.station_id, r.datetime, {', '.join(f'r.{c}' for c in WEATHER)},
       {', '.join(f'g.{c}' for c in M.PARAMETER_COLUMNS.values())}
FROM readings r LEFT JOIN g USING (station_id, datetime)""")
def mrg_merge_weather_pollutants(spark, sf):
    w = X.readings(spark, sf).select("station_id", "datetime", *WEATHER)
    return M.merge_weather_pollutants(w, M.resample_hourly(X.measurements(spark, sf)))


@register("mrg_prefer_measured", f"""
WITH g AS ({RESAMPLE_SQL}),
n AS (SELECT station_id FROM g GROUP BY 1 HAVING count(*) > 100)
SELECT station_id, datetime, pm2_5_ugm3, 'measured' AS source FROM g WHERE station_id IN (SELECT * FROM n)
UNION ALL
SELECT station_id, datetime, pm2_5_ugm3, 'modelled' AS source FROM readings
WHERE station_id NOT IN (SELECT * FROM n)""")
def mrg_prefer_measured(spark, sf):
    meas = M.resample_hourly(X.measurements(spark, sf)).select("station_id", "datetime", "pm2_5_ugm3")
    model = X.readings(spark, sf).select("station_id", "datetime", "pm2_5_ugm3")
    return M.prefer_measured(meas, model, 100)


@register("mrg_fill_missing_columns", """
SELECT station_id, datetime, pm2_5_ugm3, CAST(NULL AS DOUBLE) AS dust_ugm3, CAST(NULL AS DOUBLE) AS aod
FROM readings""")
def mrg_fill_missing_columns(spark, sf):
    r = X.readings(spark, sf).select("station_id", "datetime", "pm2_5_ugm3")
    return M.fill_missing_columns(r)


@register("mrg_attach_city_constants", """
SELECT r.station_id, r.datetime, c.city_id, c.name AS city, c.state, c.latitude, c.longitude
FROM readings r JOIN stations s USING (station_id) JOIN cities c ON s.city_id = c.city_id""")
def mrg_attach_city_constants(spark, sf):
    r = X.readings(spark, sf).select("station_id", "datetime")
    return M.attach_city_constants(r, X.stations(spark, sf), X.cities(spark, sf)).select(
        "station_id", "datetime", "city_id", "city", "state", "latitude", "longitude")


@register("mrg_time_window_filter", f"""
SELECT station_id, datetime FROM readings
WHERE datetime BETWEEN {NOW} - INTERVAL 3 DAY AND {NOW} - INTERVAL 1 DAY""")
def mrg_time_window_filter(spark, sf):
    f = facts(spark, sf)
    t = as_of(f)
    r = X.readings(spark, sf).select("station_id", "datetime")
    return M.time_window_filter(r, t - F.make_dt_interval(F.lit(3)), t - F.make_dt_interval(F.lit(1)))


@register("mrg_union_cities", "SELECT station_id, datetime, pm2_5_ugm3 FROM readings")
def mrg_union_cities(spark, sf):
    """The per-city frames of a landed folder, written in one pass and read as
    one frame by column name: the number of scans doesn't follow the cities."""
    path = landed.scratch(spark, "city-frames")
    X.readings(spark, sf).select("station_id", "datetime", "pm2_5_ugm3").write.partitionBy("station_id").parquet(path)
    return M.union_cities(M.read_city_frames(spark, path, "station_id")).select("station_id", "datetime", "pm2_5_ugm3")


@register("mrg_canonical_columns", f"SELECT {', '.join(c for c in K.CANONICAL_COLUMNS if c not in ('dew_point_c', 'wind_gusts_kmh', 'pressure_msl_hpa', 'cloud_cover_percent', 'dust_ugm3', 'aod'))} FROM facts")
def mrg_canonical_columns(spark, sf):
    return M.canonical_columns(facts(spark, sf))


@register("mrg_plan_gaps", f"""
WITH n AS (SELECT station_id, max(datetime) AS newest FROM facts GROUP BY 1),
p AS (SELECT s.station_id, n.newest,
        coalesce(date_trunc('hour', n.newest + INTERVAL 1 HOUR), TIMESTAMP '{M.DEFAULT_START}') AS fetch_from,
        date_trunc('hour', {NOW} + INTERVAL 30 HOUR) AS fetch_to FROM stations s LEFT JOIN n USING (station_id))
SELECT station_id, newest, fetch_from, fetch_to, fetch_from < fetch_to AS needs_fetch,
  (epoch(fetch_to) - epoch(fetch_from)) / 3600.0 AS gap_hours,
  CAST(greatest(2, least(92, ceil((epoch(fetch_to) - epoch(fetch_from)) / 3600.0 / 24) + 1)) AS INTEGER) AS past_days,
  (epoch(fetch_to) - epoch(fetch_from)) / 3600.0 > 120 AS historical FROM p""")
def mrg_plan_gaps(spark, sf):
    f = facts(spark, sf)
    now = as_of(f) + F.make_dt_interval(F.lit(0), F.lit(30))
    return M.plan_gaps(f, X.stations(spark, sf), now)


@register("mrg_insert_new", f"""
SELECT station_id, datetime, pm2_5_ugm3 FROM readings WHERE datetime >= {NOW} - INTERVAL 5 DAY
  AND datetime > {NOW} - INTERVAL 3 DAY""")
def mrg_insert_new(spark, sf):
    f = facts(spark, sf)
    t = as_of(f)
    r = X.readings(spark, sf).select("station_id", "datetime", "pm2_5_ugm3")
    target = r.filter(F.col("datetime") <= t - F.make_dt_interval(F.lit(3)))
    batch = r.filter(F.col("datetime") >= t - F.make_dt_interval(F.lit(5)))
    return M.insert_new(target, batch)


@register("mrg_append_distinct", "SELECT city, datetime, india_aqi FROM facts")
def mrg_append_distinct(spark, sf):
    f = facts(spark, sf).select("city", "datetime", "india_aqi")
    t = as_of(f)
    old = f.filter(F.col("datetime") <= t - F.make_dt_interval(F.lit(3)))
    new = f.filter(F.col("datetime") >= t - F.make_dt_interval(F.lit(5)))
    return M.append_distinct(old, new)


@register("mrg_rows_after", f"""
SELECT city, datetime, us_aqi, {A.us_category_sql('us_aqi')} AS aqi_category FROM facts
WHERE datetime > {NOW} - INTERVAL 2 DAY""")
def mrg_rows_after(spark, sf):
    f = facts(spark, sf).select("city", "datetime", "us_aqi")
    target = f.filter(F.col("datetime") <= as_of(f) - F.make_dt_interval(F.lit(2)))
    return M.rows_after(f, target)


@register("mrg_gap_insert", f"""
WITH m AS (SELECT station_id, max(datetime) AS mx FROM readings
           WHERE datetime <= {NOW} - INTERVAL 2 DAY - to_hours(CAST(station_id AS INTEGER)) GROUP BY 1)
SELECT r.station_id, r.datetime FROM readings r LEFT JOIN m USING (station_id)
WHERE m.mx IS NULL OR r.datetime > m.mx""")
def mrg_gap_insert(spark, sf):
    f = facts(spark, sf)
    r = X.readings(spark, sf).select("station_id", "datetime")
    lag = F.make_dt_interval(F.lit(2)) + F.make_dt_interval(F.lit(0), F.col("station_id").cast("int"))
    target = r.filter(F.col("datetime") <= as_of(f) - lag)
    return M.gap_insert(r, target)


@register("mrg_retain", f"SELECT station_id, datetime FROM facts WHERE datetime >= {NOW} - INTERVAL 7 DAY")
def mrg_retain(spark, sf):
    f = facts(spark, sf)
    return M.retain(f, as_of(f), 7).select("station_id", "datetime")


@register("mrg_dimension_insert_missing", """
SELECT c.city_id, upper(replace(c.name, ' ', '_')) || '_CSV' AS station_code,
       upper(substr(c.name, 1, 1)) || lower(substr(c.name, 2)) || ' (CSV Aggregate)' AS station_name
FROM cities c WHERE c.city_id NOT IN (SELECT city_id FROM stations)""")
def mrg_dimension_insert_missing(spark, sf):
    c = X.cities(spark, sf)
    new = c.select("city_id", M.station_code(F.col("name")).alias("station_code"),
                   M.station_name(F.col("name")).alias("station_name"))
    return M.dimension_insert_missing(X.stations(spark, sf), new, "city_id")


@register("mrg_freshness", f"""
SELECT count(*) AS rows, max(datetime) AS newest,
  CAST(floor((epoch({NOW} + INTERVAL 3 HOUR) - epoch(max(datetime))) / 3600) AS BIGINT) AS gap_hours,
  max(datetime) IS NULL OR floor((epoch({NOW} + INTERVAL 3 HOUR) - epoch(max(datetime))) / 3600) > 2 AS stale
FROM facts""")
def mrg_freshness(spark, sf):
    f = facts(spark, sf)
    return M.freshness(f, as_of(f) + F.make_dt_interval(F.lit(0), F.lit(3)))


@register("mrg_run_summary", f"""
WITH b AS (SELECT * FROM facts WHERE datetime >= {NOW} - INTERVAL 5 DAY),
i AS (SELECT * FROM b WHERE datetime > {NOW} - INTERVAL 3 DAY)
SELECT b.city, count(*) AS fetched, min(b.datetime) AS date_from, max(b.datetime) AS date_to,
       coalesce((SELECT count(*) FROM i WHERE i.city = b.city), 0) AS inserted
FROM b GROUP BY b.city""")
def mrg_run_summary(spark, sf):
    f = facts(spark, sf)
    t = as_of(f)
    batch = f.filter(F.col("datetime") >= t - F.make_dt_interval(F.lit(5)))
    target = f.filter(F.col("datetime") <= t - F.make_dt_interval(F.lit(3)))
    ins = M.insert_new(target, batch)
    return M.run_summary(batch, ins)


@register("mrg_run_totals", f"""
WITH b AS (SELECT *, station_id % 2 = 0 AS m FROM facts WHERE datetime >= {NOW} - INTERVAL 5 DAY)
SELECT count(*) AS rows_fetched, count(CASE WHEN datetime > {NOW} - INTERVAL 3 DAY THEN 1 END) AS rows_inserted,
       min(datetime) AS start_dt, max(datetime) AS end_dt, count(CASE WHEN m THEN 1 END) AS rows_measured,
       count(CASE WHEN NOT m THEN 1 END) AS rows_modelled FROM b""")
def mrg_run_totals(spark, sf):
    f = facts(spark, sf).withColumn("source", F.when(F.col("station_id") % 2 == 0, "measured").otherwise("modelled"))
    t = as_of(f)
    batch = f.filter(F.col("datetime") >= t - F.make_dt_interval(F.lit(5)))
    target = f.filter(F.col("datetime") <= t - F.make_dt_interval(F.lit(3)))
    totals = M.insert_with_totals(target, batch, landed.scratch(spark, "run-totals"))
    return spark.createDataFrame([totals], "rows_fetched long, rows_inserted long, start_dt timestamp_ntz, end_dt timestamp_ntz, "
                                           "rows_measured long, rows_modelled long")


@register("mrg_export_frame", f"""
SELECT city, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, us_aqi,
       {A.us_category_sql('us_aqi')} AS aqi_category FROM facts""")
def mrg_export_frame(spark, sf):
    return M.export_frame(facts(spark, sf).select("city", "datetime", "us_aqi"))


@register("mrg_left_merge_weather", """
SELECT f.city, f.datetime, f.india_aqi, w.temperature_c, w.temperature_c IS NOT NULL AS has_weather
FROM facts f LEFT JOIN (SELECT c.name AS city, r.datetime, r.temperature_c FROM readings r
   JOIN stations s USING (station_id) JOIN cities c ON s.city_id = c.city_id WHERE hour(r.datetime) % 2 = 0) w
ON f.city = w.city AND f.datetime = w.datetime""")
def mrg_left_merge_weather(spark, sf):
    f = facts(spark, sf).select("city", "datetime", "india_aqi", "temperature_c")
    w = facts(spark, sf).filter(F.hour("datetime") % 2 == 0).select("city", "datetime", "temperature_c")
    return M.left_merge_weather(f, w)


@register("mrg_reseed", "SELECT station_id, datetime, pm2_5_ugm3 FROM readings")
def mrg_reseed(spark, sf):
    """MRG-20: seed an empty target with the first 20 days, then the
    'missing' mode appends only the absent (station, hour) keys."""
    path = landed.scratch(spark, "reseed")
    r = X.readings(spark, sf)
    M.reseed(spark, path, r.filter(F.dayofmonth("datetime") <= 20))
    M.reseed(spark, path, r, mode="missing")
    return spark.read.parquet(path).select("station_id", "datetime", "pm2_5_ugm3")


@register("snk_write_facts", """
SELECT CAST(datetime AS DATE) AS date, count(*) AS rows FROM readings GROUP BY 1""")
def snk_write_facts(spark, sf):
    path = landed.scratch(spark, "facts")
    M.write_facts(X.readings(spark, sf), path, "overwrite")
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("rows"))


# -- sources -----------------------------------------------------------------------

@register("src_weather_from_json", """
SELECT station_id, datetime, temperature_c, humidity_percent, CAST(NULL AS DOUBLE) AS dew_point_c,
  precipitation_mm, CAST(NULL AS DOUBLE) AS cloud_cover_percent, CAST(NULL AS DOUBLE) AS pressure_msl_hpa,
  wind_speed_kmh, CAST(NULL AS DOUBLE) AS wind_gusts_kmh FROM readings""")
def src_weather_from_json(spark, sf):
    return L.weather_from_json(spark, landed.weather_payloads(spark, sf))


@register("src_pollutants_from_json", """
SELECT station_id, datetime, pm10_ugm3, pm2_5_ugm3, co_ugm3, no2_ugm3, so2_ugm3, o3_ugm3,
  CAST(NULL AS DOUBLE) AS dust_ugm3, CAST(NULL AS DOUBLE) AS aod FROM readings""")
def src_pollutants_from_json(spark, sf):
    return L.pollutants_from_json(spark, landed.pollutant_payloads(spark, sf))


@register("src_measurements_from_json", """
SELECT station_id, pollutant AS parameter, date_trunc('second', ts) + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS ts,
       arg_max(value, ts) AS value
FROM measurements GROUP BY 1, 2, 3""")
def src_measurements_from_json(spark, sf):
    m = L.measurements_from_json(spark, landed.measurement_payloads(spark, sf))
    return m.select("station_id", "parameter", "ts", "value")


@register("src_read_readings_csv", """
SELECT city, datetime, india_aqi, us_aqi, pm2_5_ugm3, is_weekend, is_raining, month FROM facts""")
def src_read_readings_csv(spark, sf):
    c = L.read_readings_csv(spark, landed.wide_csv(spark, facts(spark, sf)))
    return c.select("city", "datetime", "india_aqi", "us_aqi", "pm2_5_ugm3", "is_weekend", "is_raining", "month")


@register("src_coerce_bool", """
SELECT notice_id, is_read AS strict_flag, is_read AS loose_flag FROM notices""")
def src_coerce_bool(spark, sf):
    n = X.notices(spark, sf)
    s = F.initcap(F.col("is_read").cast("string"))
    return n.select("notice_id", L.coerce_bool(s).alias("strict_flag"),
                    L.coerce_bool(F.col("is_read").cast("int"), loose=True).alias("loose_flag"))


@register("src_nan_to_null", """
SELECT station_id, datetime, CASE WHEN hour(datetime) = 0 THEN NULL ELSE pm2_5_ugm3 END AS pm2_5_ugm3
FROM readings""")
def src_nan_to_null(spark, sf):
    r = X.readings(spark, sf).select(
        "station_id", "datetime",
        F.when(F.hour("datetime") == 0, F.lit(float("nan"))).otherwise(F.col("pm2_5_ugm3")).alias("pm2_5_ugm3"))
    return L.nan_to_null(r)


@register("src_training_frame", """
SELECT f.station_id, f.datetime, lower(c.name) AS city, f.india_aqi FROM readings0 f
  JOIN stations s USING (station_id) JOIN cities c ON s.city_id = c.city_id WHERE f.india_aqi IS NOT NULL"""
          .replace("readings0", "facts"))
def src_training_frame(spark, sf):
    t = L.training_frame(facts(spark, sf), X.stations(spark, sf), X.cities(spark, sf))
    return t.select("station_id", "datetime", "city", "india_aqi")


@register("src_recent_slice", f"""
SELECT city, datetime, india_aqi FROM facts WHERE datetime >= {NOW} - INTERVAL 7 DAY""")
def src_recent_slice(spark, sf):
    f = facts(spark, sf).select("city", "datetime", "india_aqi")
    return L.recent_slice(f, 7, X.cities(spark, sf))
