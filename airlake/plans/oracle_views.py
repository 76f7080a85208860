"""DuckDB SQL text of the fixture views, for the oracle check.

Written separately from the Spark plans in ``airlake.sources.fixtures``;
``with_views(sql)`` prepends the CTEs a query mentions (and their
dependencies) so each oracle statement is self-contained.
"""

from __future__ import annotations

import re

from ..functions import aqi as A
from ..functions import calendar as C
from ..functions import constants as K

_DAVG = ("(CAST(SUM(CASE WHEN {c} THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) "
         "/ COUNT(CASE WHEN {c} THEN 1 END))")


def davg(c: str) -> str:
    return _DAVG.format(c=c)


VIEWS: dict[str, str] = {}

VIEWS["cities"] = """
SELECT n_nationkey AS city_id, lower(n_name) AS name, lower(r_name) AS state,
       8.0::DOUBLE + (n_nationkey * 7) % 25 AS latitude,
       70.0::DOUBLE + (n_nationkey * 11) % 25 AS longitude,
       true AS is_active
FROM nation JOIN region ON n_regionkey = r_regionkey"""

VIEWS["stations"] = """
SELECT CAST(city_id AS BIGINT) AS station_id, city_id,
       upper(name) || '_CSV' AS station_code,
       upper(substr(name, 1, 1)) || lower(substr(name, 2)) || ' (CSV Aggregate)' AS station_name,
       latitude, longitude, 'csv' AS data_source, true AS is_active
FROM cities"""

VIEWS["measurements"] = """
SELECT event_id AS measurement_id, user_id % (SELECT count(*) FROM nation) AS station_id, ts,
       CASE event_type WHEN 'click' THEN 'pm2_5' WHEN 'view' THEN 'pm10'
            WHEN 'signup' THEN 'no2' WHEN 'purchase' THEN 'so2' ELSE 'o3' END AS pollutant,
       value
FROM events"""

VIEWS["readings"] = f"""
SELECT user_id % (SELECT count(*) FROM nation) AS station_id, date_trunc('hour', ts) AS datetime,
       {davg("event_type = 'click'")} AS pm2_5_ugm3,
       {davg("event_type = 'view'")} AS pm10_ugm3,
       {davg("event_type = 'signup'")} AS no2_ugm3,
       {davg("event_type = 'purchase'")} AS so2_ugm3,
       {davg("event_type = 'error'")} AS o3_ugm3,
       {davg("true")} * 40 AS co_ugm3,
       {davg("true")} / 15 AS temperature_c,
       max(value) / 20 AS wind_speed_kmh,
       CAST(sum(user_id) % 101 AS DOUBLE) AS humidity_percent,
       CASE WHEN max(event_id) % 7 = 0 THEN CAST(max(event_id) % 23 AS DOUBLE) ELSE 0.0::DOUBLE END
         AS precipitation_mm
FROM events GROUP BY 1, 2"""

VIEWS["profiles"] = """
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 90 + 1 AS INTEGER) END AS age,
       c_mktsegment = 'BUILDING' AS respiratory_disease,
       c_mktsegment = 'MACHINERY' AS heart_disease,
       c_custkey % 5 = 0 AS diabetes, c_custkey % 7 = 0 AS kidney_disease,
       c_custkey % 3 = 0 AS is_smoker, c_custkey % 11 = 0 AS is_pregnant,
       ['low', 'moderate', 'high', 'very_high'][c_custkey % 4 + 1] AS sensitivity_level,
       ['resting', 'light', 'moderate', 'intense'][(c_custkey + c_nationkey) % 4 + 1] AS activity_level,
       (c_custkey % 48) / 2.0::DOUBLE AS exposure_hours,
       CAST((c_custkey % 30) * 10 AS INTEGER) AS aqi_threshold,
       CAST(c_nationkey AS INTEGER) AS home_city_id
FROM customer"""

VIEWS["route_candidates"] = """
SELECT l_orderkey AS request_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS route_idx,
       o_custkey AS user_id, o_orderdate AS planned_start,
       c_nationkey AS source_city_id, s_nationkey AS dest_city_id,
       l_quantity * 1000 AS distance_m, l_extendedprice / 10 AS duration_s
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN supplier ON l_suppkey = s_suppkey"""

VIEWS["route_ends"] = """
SELECT r.*, s.latitude AS src_lat, s.longitude AS src_lon,
       d.latitude AS dst_lat, d.longitude AS dst_lon
FROM route_candidates r JOIN cities s ON r.source_city_id = s.city_id
     JOIN cities d ON r.dest_city_id = d.city_id"""

VIEWS["waypoints"] = """
SELECT request_id, route_idx, CAST(i AS INTEGER) AS pos,
       src_lat + (dst_lat - src_lat) * i / n + ((route_idx * 3 + i) % 5 - 2) * 0.01::DOUBLE AS lat,
       src_lon + (dst_lon - src_lon) * i / n + ((route_idx * 3 + i) % 5 - 2) * 0.01::DOUBLE AS lon
FROM (SELECT *, 20 + (route_idx * 17) % 60 AS n FROM route_ends) r,
     LATERAL (SELECT unnest(generate_series(0, r.n)) AS i) g"""

VIEWS["notices"] = """
SELECT event_id AS notice_id, user_id, CAST(user_id % (SELECT count(*) FROM nation) AS INTEGER) AS city_id,
       CASE WHEN event_id % 4 IN (2, 3) THEN event_id END AS route_id,
       ['aqi_threshold', 'forecast_alert', 'route_saved', 'route_monitor'][event_id % 4 + 1]
         AS notification_type,
       value AS aqi_value, ts AS sent_at, event_id % 3 = 0 AS is_read,
       CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS read_at
FROM events"""


def derived_sql(ts: str = "datetime", city: str = "city") -> str:
    """The ENR-17 columns as a SELECT list over a row with pollutant and
    weather columns."""
    return ",\n       ".join([
        f"CAST(month({ts}) AS INTEGER) AS month",
        f"{C.day_name_sql(ts)} AS day_name",
        f"{C.is_weekend_sql(ts)} AS is_weekend",
        f"{C.season_sql(f'month({ts})')} AS season",
        f"{C.time_of_day_sql(f'hour({ts})')} AS time_of_day",
        "coalesce(precipitation_mm, 0.0) > 0.0 AS is_raining",
        f"coalesce(precipitation_mm, 0.0) > {K.RAIN_HEAVY_MM!r} AS heavy_rain",
        f"{C.festival_sql(ts)} AS festival_period",
        f"{C.crop_burning_sql(f'month({ts})', city)} AS crop_burning_season",
        f"{A.india_aqi_sql()} AS india_aqi",
        f"{A.us_aqi_sql('pm2_5_ugm3')} AS us_aqi",
        f"{A.pm25_category_sql('pm2_5_ugm3')} AS pm25_category_india",
    ])


VIEWS["facts0"] = f"""
SELECT r.*, s.city_id, c.name AS city, c.state, c.latitude, c.longitude,
       {derived_sql("r.datetime", "c.name")}
FROM readings r JOIN stations s ON r.station_id = s.station_id
     JOIN cities c ON s.city_id = c.city_id"""

VIEWS["facts"] = f"""
SELECT *, {A.india_category_sql('india_aqi')} AS india_aqi_category,
       {A.us_category_sql('us_aqi')} AS aqi_category
FROM facts0"""


VIEWS["hourly"] = """
SELECT s.city, s.datetime, last_value(f.india_aqi IGNORE NULLS) OVER (PARTITION BY s.city ORDER BY s.datetime
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS india_aqi
FROM (SELECT city, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
      FROM facts GROUP BY city) s LEFT JOIN facts f ON f.city = s.city AND f.datetime = s.datetime"""


def _deps(sql: str) -> list[str]:
    out = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out.append(name)
    return out


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str, seen: tuple = ()):
        if name in order:
            return
        for d in _deps(VIEWS[name]):
            if d != name and d not in seen:
                visit(d, seen + (name,))
        order.append(name)

    for n in _deps(sql):
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
    body = sql.lstrip()
    head = body[:15].upper()
    if head.startswith("WITH RECURSIVE") and body[14:15].isspace():
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"


def ctes(*parts: tuple[str, str], select: str) -> str:
    """``WITH a AS (..), b AS (..) <select>`` from (name, body) pairs;
    repeated names (shared fragments) are emitted once."""
    seen, out = set(), []
    for name, body in parts:
        if name in seen:
            continue
        seen.add(name)
        out.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(out) + "\n" + select
