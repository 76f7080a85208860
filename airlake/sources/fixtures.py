"""Domain views over the supplied driver tables.

The driver tables are TPC-H-like; these views give them the shape of the
air-quality model (cities, stations, hourly readings, health profiles,
candidate routes, notices). Every view is a lazy Spark plan over the supplied
tables. Every nation is a city with one station; customers live in their own
nation, and the users of the events are dealt over the stations, as many as
the nation table has. The DuckDB text of the same views is in
``airlake.plans.oracle_views``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import hour_floor
from ..functions.geo import Path
from .tables import load

SENSITIVITY_BY_MOD4 = ["low", "moderate", "high", "very_high"]
ACTIVITY_BY_MOD4 = ["resting", "light", "moderate", "intense"]
NOTICE_TYPE_BY_MOD4 = ["aqi_threshold", "forecast_alert", "route_saved", "route_monitor"]
POLLUTANT_BY_EVENT = [("click", "pm2_5"), ("view", "pm10"), ("signup", "no2"),
                      ("purchase", "so2"), ("error", "o3")]


def station_count(spark: SparkSession, sf_dir: str) -> Column:
    """Scalar subquery: stations are numbered from 0 to this, less one."""
    return load(spark, sf_dir, "nation").agg(F.count(F.lit(1))).scalar()


def station_of(spark: SparkSession, sf_dir: str, user="user_id") -> Column:
    """The station that a user of the events is near."""
    return F.col(user) % station_count(spark, sf_dir)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
            .select(k.alias("city_id"),
                    F.lower("n_name").alias("name"),
                    F.lower("r_name").alias("state"),
                    (F.lit(8.0) + (k * 7) % 25).alias("latitude"),
                    (F.lit(70.0) + (k * 11) % 25).alias("longitude"),
                    F.lit(True).alias("is_active")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cities(spark, sf_dir)
    return c.select(F.col("city_id").cast("long").alias("station_id"),
                    "city_id",
                    F.concat(F.upper("name"), F.lit("_CSV")).alias("station_code"),
                    F.concat(F.initcap("name"), F.lit(" (CSV Aggregate)")).alias("station_name"),
                    "latitude", "longitude",
                    F.lit("csv").alias("data_source"),
                    F.lit(True).alias("is_active"))


def _pollutant_of(event_type) -> F.Column:
    expr = None
    for et, p in POLLUTANT_BY_EVENT[:-1]:
        expr = (F.when if expr is None else expr.when)(event_type == et, F.lit(p))
    return expr.otherwise(F.lit(POLLUTANT_BY_EVENT[-1][1]))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sub-hourly sensor readings: one row per event."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("measurement_id"),
                    station_of(spark, sf_dir).alias("station_id"),
                    F.col("ts"),
                    _pollutant_of(F.col("event_type")).alias("pollutant"),
                    F.col("value"))


def _davg(cond) -> F.Column:
    """Average of 2-decimal values summed exactly as DECIMAL, divided once."""
    s = F.sum(F.when(cond, F.col("value").cast("decimal(18,2)"))).cast("double")
    return s / F.count(F.when(cond, F.lit(1)))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly fact rows per (station, hour) from the event stream."""
    e = load(spark, sf_dir, "events")
    et = F.col("event_type")
    mx = F.max("event_id")
    return (e.groupBy(station_of(spark, sf_dir).alias("station_id"),
                      hour_floor("ts").alias("datetime"))
            .agg(_davg(et == "click").alias("pm2_5_ugm3"),
                 _davg(et == "view").alias("pm10_ugm3"),
                 _davg(et == "signup").alias("no2_ugm3"),
                 _davg(et == "purchase").alias("so2_ugm3"),
                 _davg(et == "error").alias("o3_ugm3"),
                 (_davg(F.lit(True)) * 40).alias("co_ugm3"),
                 (_davg(F.lit(True)) / 15).alias("temperature_c"),
                 (F.max("value") / 20).alias("wind_speed_kmh"),
                 (F.sum("user_id") % 101).cast("double").alias("humidity_percent"),
                 F.when(mx % 7 == 0, (mx % 23).cast("double")).otherwise(F.lit(0.0))
                 .alias("precipitation_mm")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    sens = F.array(*[F.lit(s) for s in SENSITIVITY_BY_MOD4])
    act = F.array(*[F.lit(s) for s in ACTIVITY_BY_MOD4])
    return c.select(
        k.alias("user_id"),
        F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise((k % 90 + 1).cast("int")).alias("age"),
        (seg == "BUILDING").alias("respiratory_disease"),
        (seg == "MACHINERY").alias("heart_disease"),
        (k % 5 == 0).alias("diabetes"),
        (k % 7 == 0).alias("kidney_disease"),
        (k % 3 == 0).alias("is_smoker"),
        (k % 11 == 0).alias("is_pregnant"),
        F.element_at(sens, (k % 4 + 1).cast("int")).alias("sensitivity_level"),
        F.element_at(act, ((k + F.col("c_nationkey")) % 4 + 1).cast("int")).alias("activity_level"),
        ((k % 48) / 2.0).alias("exposure_hours"),
        ((k % 30) * 10).cast("int").alias("aqi_threshold"),
        F.col("c_nationkey").cast("int").alias("home_city_id"),
    )


def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate route of a request (lineitem x order)."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                            "l_extendedprice", "l_shipdate")
    # orders meet customers and lines meet suppliers first: the big join and the numbering then share one shuffle
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .join(o.join(c, o.o_custkey == c.c_custkey), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("request_id"),
                    (F.row_number().over(w) - 1).cast("int").alias("route_idx"),
                    F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("planned_start"),
                    F.col("c_nationkey").alias("source_city_id"),
                    F.col("s_nationkey").alias("dest_city_id"),
                    (F.col("l_quantity") * 1000).alias("distance_m"),
                    (F.col("l_extendedprice") / 10).alias("duration_s")))


def with_endpoints(routes: DataFrame, city_df: DataFrame) -> DataFrame:
    """Attach source and destination coordinates (dimension joins)."""
    src = city_df.select(F.col("city_id").alias("source_city_id"),
                         F.col("latitude").alias("src_lat"), F.col("longitude").alias("src_lon"))
    dst = city_df.select(F.col("city_id").alias("dest_city_id"),
                         F.col("latitude").alias("dst_lat"), F.col("longitude").alias("dst_lon"))
    return routes.join(src, "source_city_id").join(dst, "dest_city_id")


def n_points_expr(route_idx="route_idx") -> F.Column:
    """Number of geometry segments of a fixture route; points are 0..n."""
    return F.lit(20) + (F.col(route_idx) * 17) % 60


def point_lat(i, n, route_idx="route_idx") -> F.Column:
    off = ((F.col(route_idx) * 3 + i) % 5 - 2) * 0.01
    return F.col("src_lat") + (F.col("dst_lat") - F.col("src_lat")) * i / n + off


def point_lon(i, n, route_idx="route_idx") -> F.Column:
    off = ((F.col(route_idx) * 3 + i) % 5 - 2) * 0.01
    return F.col("src_lon") + (F.col("dst_lon") - F.col("src_lon")) * i / n + off


def geometry_expr() -> Column:
    """The ordered geometry of a route with endpoints as array<struct<lat,lon>>."""
    n = n_points_expr()
    return F.transform(F.sequence(F.lit(0), n),
                       lambda i: F.struct(point_lat(i, n).alias("lat"), point_lon(i, n).alias("lon")))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])))
def _geometries(route_idx: pa.Array, src_lat: pa.Array, src_lon: pa.Array, dst_lat: pa.Array, dst_lon: pa.Array) -> pa.Array:
    """``geometry_expr`` for whole batches, with the same operations in the same order."""
    idx, *ends = (c.to_numpy(zero_copy_only=False) for c in (route_idx, src_lat, src_lon, dst_lat, dst_lon))
    n = 20 + (idx * 17) % 60
    at = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)

    def of(x):
        return np.repeat(x, n + 1)

    i = np.arange(at[-1], dtype=np.int32) - of(at[:-1])
    off = ((np.arange(5) - 2) * 0.01)[(of((idx * 3 % 5).astype(np.int32)) + i) % 5]
    segments = of(n.astype(float))
    points = [pa.array(of(a) + of(z - a) * i / segments + off) for a, z in (ends[::2], ends[1::2])]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(points, ["lat", "lon"]))


def route_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Path]:
    """Candidate routes with endpoints (and ``_n``, their segments), and the
    points of ``route_geometry`` by position, without building arrays."""
    r = with_endpoints(route_candidates(spark, sf_dir), cities(spark, sf_dir)).withColumn("_n", n_points_expr())
    n = F.col("_n")
    return r, Path(n + 1, lambda i: point_lat(i, n), lambda i: point_lon(i, n))


def route_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate routes with their ordered geometry as array<struct<lat,lon>>."""
    r = with_endpoints(route_candidates(spark, sf_dir), cities(spark, sf_dir))
    return r.withColumn("geometry", _geometries("route_idx", "src_lat", "src_lon", "dst_lat", "dst_lon"))


def route_sample_points(spark: SparkSession, sf_dir: str, stride_target: int = 30) -> DataFrame:
    """The sampled waypoints (positions 0, stride, ..; stride = max(1,
    points div ``stride_target``)) of every candidate route, computed from
    the geometry rule with plain column arithmetic instead of building the
    whole array first. Carries the route's columns."""
    r = with_endpoints(route_candidates(spark, sf_dir), cities(spark, sf_dir))
    n = n_points_expr()
    stride = F.greatest(F.lit(1), ((n + 1) / stride_target).cast("int"))
    x = r.withColumn("pos", F.explode(F.sequence(F.lit(0), n, stride)))
    i = F.col("pos")
    return x.withColumns({"lat": point_lat(i, n), "lon": point_lon(i, n)})


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = route_geometry(spark, sf_dir)
    return g.select("request_id", "route_idx",
                    F.posexplode("geometry").alias("pos", "pt")).select(
        "request_id", "route_idx", "pos", F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    types = F.array(*[F.lit(t) for t in NOTICE_TYPE_BY_MOD4])
    ntype = F.element_at(types, (F.col("event_id") % 4 + 1).cast("int"))
    is_read = F.col("event_id") % 3 == 0
    sent = F.col("ts")
    return e.select(
        F.col("event_id").alias("notice_id"),
        F.col("user_id"),
        station_of(spark, sf_dir).cast("int").alias("city_id"),
        F.when(ntype.isin("route_saved", "route_monitor"), F.col("event_id")).alias("route_id"),
        ntype.alias("notification_type"),
        F.col("value").alias("aqi_value"),
        sent.alias("sent_at"),
        is_read.alias("is_read"),
        F.when(is_read, sent + F.expr("INTERVAL 1 HOUR")).alias("read_at"),
    )


def pooled_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate routes with the way they were found: every seventh request
    went through a via point, a request has up to three natural routes, and the
    others are synthetic."""
    r = route_candidates(spark, sf_dir)
    i, q = F.col("route_idx"), F.col("request_id")
    via = (q % 7 == 0) & (i == 0)
    return r.withColumn("kind", F.when(via, "via").when(i <= q % 4, "natural").otherwise("synthetic"))


def sensor_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measuring locations (suppliers, near their nation's city) with their
    sensors (parts) as a nested list in sensor order; about twenty each."""
    s = load(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    # FIXED VALUES - names as the sensor service spells them, some of them not wanted
    names = F.array(*[F.lit(x) for x in ("pm2.5", "PM10", "no2", "so2", "humidity", "o3", "CO", "pm1")])
    p = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % s.agg(F.count(F.lit(1))).scalar() + 1).alias("loc_id"),
        F.element_at(names, ((F.col("p_partkey") * 5 + F.col("p_size")) % 8 + 1).cast("int")).alias("parameter"))
    sensors = p.groupBy("loc_id").agg(F.array_sort(F.collect_list(F.struct("id", "parameter"))).alias("sensors"))
    at = s.select(k.alias("loc_id"), F.col("s_name").alias("loc_name"),
                  F.when(k % 29 != 0, F.lit(8.0) + (n * 7) % 25 + (k % 13 - 6) * 0.1).alias("latitude"),
                  (F.lit(70.0) + (n * 11) % 25 + (k * 7 % 11 - 5) * 0.1).alias("longitude"))
    return at.join(sensors, "loc_id", "left")
