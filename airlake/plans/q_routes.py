"""Registered route queries (GEO-*).

Inputs: candidate routes (lineitem x orders) with straight-line
geometries between their source and destination cities, scored against
the newest AQI of each measured city.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import risk as R
from ..functions.stats import bround_sql, exact_avg_sql, round_sql
from ..operators import routes as RT
from ..operators import serving as S
from ..sources import fixtures as X
from ..session import cut_lineage
from .inputs import facts
from .oracle_views import ctes
from .q_risk import scored_sql
from .registry import register

# -- shared Spark inputs -------------------------------------------------------


def city_aqi(spark, sf):
    return RT.city_aqi_map(S.latest_rows(facts(spark, sf)))


def scored(spark, sf, *carry):
    """Scored routes with their measures and the columns named in ``carry``:
    every route column is a key of the aggregate over its points, so only
    those that the query needs go through it."""
    pts = X.route_sample_points(spark, sf).select("request_id", "route_idx", "pos", "lat", "lon",
                                                  "distance_m", "duration_s", *carry)
    return RT.route_measures(RT.exposure_from_points(pts, city_aqi(spark, sf)))


def cards(spark, sf, *carry):
    """Route cards, in one pass over the scored routes, with the route columns named in ``carry``."""
    return RT.exposure_reduction(RT.classify_routes(scored(spark, sf, *carry)))


# -- shared SQL fragments --------------------------------------------------------

LATEST = ("latest", """SELECT * FROM facts f WHERE datetime =
   (SELECT max(datetime) FROM facts g WHERE g.station_id = f.station_id)""")
CAM = ("cam", """SELECT city_id, latitude, longitude,
   coalesce(CASE WHEN india_aqi <> 0 THEN india_aqi END, 100.0::DOUBLE) AS aqi FROM latest""")
WPN = ("wpn", "SELECT w.*, 21 + (route_idx * 17) % 60 AS npts FROM waypoints w")
SAMP = ("samp", "SELECT * FROM wpn WHERE pos % greatest(1, npts // 30) = 0")
NEAR = ("near", f"""SELECT request_id, route_idx, pos, aqi FROM (
   SELECT s.request_id, s.route_idx, s.pos, c.aqi,
          row_number() OVER (PARTITION BY s.request_id, s.route_idx, s.pos
                             ORDER BY {G.haversine_km_sql('s.lat', 's.lon', 'c.latitude', 'c.longitude')},
                                      c.city_id) AS rn
   FROM samp s, cam c) x WHERE rn = 1""")
EXPO = ("expo", f"SELECT request_id, route_idx, {exact_avg_sql('aqi', 6)} AS avg_aqi_raw FROM near GROUP BY 1, 2")
SCORED = ("scored", f"""SELECT r.*, e.avg_aqi_raw, {bround_sql('r.distance_m / 1000', 2)} AS distance_km,
   {bround_sql('r.duration_s / 60', 1)} AS time_min, {bround_sql('e.avg_aqi_raw', 1)} AS avg_aqi
FROM route_ends r JOIN expo e USING (request_id, route_idx)""")
SCORING = [LATEST, CAM, WPN, SAMP, NEAR, EXPO, SCORED]
CLASSIFY = SCORING + [
    ("st", """SELECT request_id, min(duration_s) AS tmin, max(duration_s) AS tmax,
       min(avg_aqi) AS amin, max(avg_aqi) AS amax FROM scored GROUP BY 1"""),
    ("bal", """SELECT s.*, 0.4::DOUBLE * CASE WHEN tmax > tmin THEN (duration_s - tmin) / (tmax - tmin) ELSE 0.0 END
       + 0.6::DOUBLE * CASE WHEN amax > amin THEN (avg_aqi - amin) / (amax - amin) ELSE 0.0 END AS bal
       FROM scored s JOIN st USING (request_id)"""),
    ("rk", """SELECT request_id, route_idx,
       row_number() OVER (PARTITION BY request_id ORDER BY duration_s, route_idx) AS r_f,
       row_number() OVER (PARTITION BY request_id ORDER BY avg_aqi, route_idx) AS r_c,
       row_number() OVER (PARTITION BY request_id ORDER BY bal, route_idx) AS r_b FROM bal"""),
    ("cls", """SELECT request_id, route_type, route_idx FROM rk,
       (VALUES ('fastest'), ('clean'), ('balanced')) v(route_type)
       WHERE (route_type = 'fastest' AND r_f = 1) OR (route_type = 'clean' AND r_c = 1)
          OR (route_type = 'balanced' AND r_b = 1)"""),
    ("cards0", "SELECT c.route_type, s.* FROM cls c JOIN scored s USING (request_id, route_idx)"),
    ("cards", f"""SELECT c.*, CASE WHEN c.route_type <> 'fastest' AND f.avg_aqi > 0
       THEN {bround_sql('(f.avg_aqi - c.avg_aqi) / f.avg_aqi * 100', 1)} END AS exposure_reduction_pct
       FROM cards0 c JOIN (SELECT request_id, avg_aqi FROM cards0 WHERE route_type = 'fastest') f
       USING (request_id)"""),
]

CARD_COLS = ["request_id", "route_type", "route_idx", "distance_km", "time_min", "avg_aqi",
             "exposure_reduction_pct"]


@register("geo_haversine_km", f"""
SELECT request_id, route_idx, round({G.haversine_km_sql('src_lat', 'src_lon', 'dst_lat', 'dst_lon')}, 6) AS km
FROM route_ends""")
def geo_haversine_km(spark, sf):
    r = X.with_endpoints(X.route_candidates(spark, sf), X.cities(spark, sf))
    return r.select("request_id", "route_idx",
                    F.round(G.haversine_km("src_lat", "src_lon", "dst_lat", "dst_lon"), 6).alias("km"))


@register("geo_nearest_city", ctes(WPN, ("mid", "SELECT * FROM wpn WHERE pos = npts // 2"), select=f"""
SELECT request_id, route_idx, CAST(city_id AS BIGINT) AS nearest_id FROM (
  SELECT m.request_id, m.route_idx, c.city_id, row_number() OVER (PARTITION BY m.request_id, m.route_idx
     ORDER BY {G.haversine_km_sql('m.lat', 'm.lon', 'c.latitude', 'c.longitude')}, c.city_id) AS rn
  FROM mid m, cities c) x WHERE rn = 1"""))
def geo_nearest_city(spark, sf):
    r, p = X.route_paths(spark, sf)
    mid = (p.size / 2).cast("int")
    pts = r.select("request_id", "route_idx", p.lat(mid).alias("lat"), p.lon(mid).alias("lon"))
    n = RT.nearest(pts, ["request_id", "route_idx"], X.cities(spark, sf))
    return n.select("request_id", "route_idx", "nearest_id")


@register("geo_match_station", ctes(("d", f"""SELECT c.city_id, s.station_id,
   {G.haversine_km_sql('c.latitude', 'c.longitude', 's.latitude', 's.longitude')} AS km
   FROM cities c, stations s"""), ("b", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id
   ORDER BY km, station_id) AS rn FROM d) x WHERE rn = 1"""), select="""
SELECT city_id, CASE WHEN km <= 50.0 THEN station_id END AS station_id,
       CASE WHEN km <= 50.0 THEN round(km, 1) END AS distance_km FROM b"""))
def geo_match_station(spark, sf):
    return RT.match_station(X.cities(spark, sf), X.stations(spark, sf), 50.0)


@register("geo_sensor_map", """
SELECT station_id, pollutant AS parameter, max(measurement_id) AS sensor_id FROM measurements GROUP BY 1, 2""")
def geo_sensor_map(spark, sf):
    from ..operators.merge import sensor_map
    return sensor_map(X.measurements(spark, sf))


@register("geo_city_sensors", f"""
WITH loc AS (SELECT s_suppkey AS loc_id, s_name AS loc_name,
    CASE WHEN s_suppkey % 29 <> 0 THEN 8.0::DOUBLE + (s_nationkey * 7) % 25 + (s_suppkey % 13 - 6) * 0.1::DOUBLE END AS la,
    70.0::DOUBLE + (s_nationkey * 11) % 25 + (s_suppkey * 7 % 11 - 5) * 0.1::DOUBLE AS lo FROM supplier),
sensor AS (SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS loc_id,
    lower(['pm2.5', 'PM10', 'no2', 'so2', 'humidity', 'o3', 'CO', 'pm1'][(p_partkey * 5 + p_size) % 8 + 1]) AS parameter FROM part),
wanted AS (SELECT * FROM (VALUES (1, 'pm2.5', 'pm2_5_ugm3'), (2, 'pm10', 'pm10_ugm3'), (3, 'no2', 'no2_ugm3'), (4, 'so2', 'so2_ugm3'),
    (5, 'o3', 'o3_ugm3'), (6, 'co', 'co_ugm3')) w(n, parameter, col)),
maps AS (SELECT loc_id, map_from_entries(list({{'key': col, 'value': id}} ORDER BY n)) AS sensors
    FROM (SELECT loc_id, n, col, max(id) AS id FROM sensor JOIN wanted USING (parameter) GROUP BY 1, 2, 3) GROUP BY 1),
near AS (SELECT c.name AS city, l.loc_id, l.loc_name, {G.haversine_km_sql('c.latitude', 'c.longitude', 'l.la', 'l.lo')} AS km
    FROM cities c, loc l WHERE l.la IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY km, loc_id) AS rn FROM near)
SELECT city, loc_id, loc_name, {round_sql('km', 1)} AS dist_km, sensors FROM best JOIN maps USING (loc_id) WHERE rn = 1 AND km <= 50""")
def geo_city_sensors(spark, sf):
    from ..operators.merge import city_sensors
    return city_sensors(X.cities(spark, sf), X.sensor_locations(spark, sf))


@register("geo_sample_waypoints", ctes(WPN, SAMP, select="""
SELECT request_id, route_idx, count(*) AS n_samples, max(pos) AS last_pos FROM samp GROUP BY 1, 2"""))
def geo_sample_waypoints(spark, sf):
    r, p = X.route_paths(spark, sf)
    s = RT.sample_waypoints(r, geometry=p)
    return s.groupBy("request_id", "route_idx").agg(F.count("*").alias("n_samples"),
                                                    F.max("pos").alias("last_pos"))


@register("geo_route_exposure", ctes(*SCORING, select="""
SELECT request_id, route_idx, avg_aqi FROM scored"""))
def geo_route_exposure(spark, sf):
    return scored(spark, sf).select("request_id", "route_idx", "avg_aqi")


@register("geo_route_measures", ctes(*SCORING, select="""
SELECT request_id, route_idx, distance_km, time_min, avg_aqi FROM scored"""))
def geo_route_measures(spark, sf):
    return scored(spark, sf).select("request_id", "route_idx", "distance_km", "time_min", "avg_aqi")


@register("geo_classify_routes", ctes(*CLASSIFY, select="SELECT request_id, route_type, route_idx FROM cls"))
def geo_classify_routes(spark, sf):
    return RT.classify_routes(scored(spark, sf)).select("request_id", "route_type", "route_idx")


@register("geo_exposure_reduction", ctes(*CLASSIFY, select=f"SELECT {', '.join(CARD_COLS)} FROM cards"))
def geo_exposure_reduction(spark, sf):
    return cards(spark, sf).select(*CARD_COLS)


_EXPL = """printf('%s route: %.1f km, ~%d min. Avg AQI exposure %d (%s).',
  upper(substr(route_type, 1, 1)) || substr(route_type, 2), round_even(distance_km, 1),
  CAST(round_even(time_min, 0) AS BIGINT), CAST(round_even(avg_aqi, 0) AS BIGINT),
  CASE WHEN avg_aqi IS NULL THEN 'Unknown' WHEN avg_aqi <= 50 THEN 'Good' WHEN avg_aqi <= 100 THEN 'Satisfactory'
       WHEN avg_aqi <= 200 THEN 'Moderately Polluted' WHEN avg_aqi <= 300 THEN 'Poor'
       WHEN avg_aqi <= 400 THEN 'Very Poor' ELSE 'Severe' END) ||
  CASE WHEN route_type = 'clean' AND exposure_reduction_pct > 0
       THEN printf(' %d%% less pollution exposure than the fastest route.',
                   CAST(round_even(exposure_reduction_pct, 0) AS BIGINT))
       WHEN route_type = 'balanced' THEN ' Optimised balance of travel time and air quality.' ELSE '' END"""


@register("geo_route_explanation", ctes(*CLASSIFY, select=f"""
SELECT request_id, route_type, {_EXPL} AS explanation FROM cards"""))
def geo_route_explanation(spark, sf):
    return RT.route_explanation(cards(spark, sf)).select("request_id", "route_type", "explanation")


@register("geo_single_path", ctes(*CLASSIFY, select="""
SELECT request_id, count(DISTINCT route_idx) = 1 AS single_path,
  CASE WHEN count(DISTINCT route_idx) = 1 THEN 'All three route types follow the same road — no distinct alternative paths were found for this journey.'
       ELSE 'The ''clean'' route minimises your AQI exposure. The ''balanced'' route offers the best time-vs-pollution trade-off.' END AS tip
FROM cls GROUP BY request_id"""))
def geo_single_path(spark, sf):
    return RT.single_path(cards(spark, sf))


@register("geo_similar_pairs", """
SELECT a.request_id, a.route_idx AS a_idx, b.route_idx AS b_idx
FROM route_candidates a JOIN route_candidates b ON a.request_id = b.request_id AND a.route_idx <> b.route_idx
WHERE abs(a.distance_m - b.distance_m) / greatest(a.distance_m, 1.0) < 0.08
  AND abs(a.duration_s - b.duration_s) / greatest(a.duration_s, 1.0) < 0.08""")
def geo_similar_pairs(spark, sf):
    return RT.similar_pairs(X.route_candidates(spark, sf))


def _dedupe_sql(cap: int = 5) -> list[tuple[str, str]]:
    parts = [("r0", "SELECT request_id, route_idx, distance_m, duration_s FROM route_candidates")]
    for k in range(1, cap + 1):
        parts.append((f"k{k}", f"""SELECT r.* FROM r{k - 1} r JOIN (SELECT request_id, min(route_idx) AS m
            FROM r{k - 1} GROUP BY 1) f ON r.request_id = f.request_id AND r.route_idx = f.m"""))
        parts.append((f"r{k}", f"""SELECT r.* FROM r{k - 1} r JOIN k{k} k ON r.request_id = k.request_id
            WHERE r.route_idx <> k.route_idx AND NOT (
              abs(r.distance_m - k.distance_m) / greatest(r.distance_m, 1.0) < 0.08
              AND abs(r.duration_s - k.duration_s) / greatest(r.duration_s, 1.0) < 0.08)"""))
    parts.append(("kept", " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, cap + 1))))
    return parts


@register("geo_dedupe_routes", ctes(*_dedupe_sql(), select="SELECT request_id, route_idx FROM kept"))
def geo_dedupe_routes(spark, sf):
    r = X.route_candidates(spark, sf).select("request_id", "route_idx", "distance_m", "duration_s")
    return RT.dedupe_routes(r).select("request_id", "route_idx")


_ALIKE = ("abs({0}.d - {1}.d) / greatest({0}.d, 1.0) < 0.08 AND abs({0}.t - {1}.t) / greatest({0}.t, 1.0) < 0.08")


@register("geo_route_pool", f"""
WITH RECURSIVE r AS (
  SELECT request_id, route_idx, distance_m AS d, duration_s AS t,
         CASE WHEN request_id % 7 = 0 AND route_idx = 0 THEN 'via' WHEN route_idx <= request_id % 4 THEN 'natural' ELSE 'synthetic' END AS kind
  FROM route_candidates),
via AS (SELECT * FROM r WHERE kind = 'via'),
beside AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.request_id ORDER BY n.route_idx) AS nth
  FROM r n JOIN via v ON n.request_id = v.request_id WHERE n.kind = 'natural' AND NOT ({_ALIKE.format('n', 'v')})),
plain AS (SELECT * FROM r WHERE request_id NOT IN (SELECT request_id FROM via)),
nat AS (SELECT * FROM plain WHERE kind = 'natural'),
few AS (SELECT request_id, count(CASE WHEN kind = 'natural' THEN 1 END) AS n FROM plain GROUP BY 1 HAVING n < 3),
queue AS (SELECT p.*, row_number() OVER (PARTITION BY p.request_id ORDER BY p.route_idx) AS place
          FROM plain p JOIN few USING (request_id) WHERE p.kind = 'synthetic'),
walk(request_id, place, pool) AS (
  SELECT f.request_id, 0::BIGINT, coalesce(list({{'i': n.route_idx, 'd': n.d, 't': n.t}}) FILTER (n.route_idx IS NOT NULL), [])
  FROM few f LEFT JOIN nat n USING (request_id) GROUP BY 1
  UNION ALL
  SELECT w.request_id, q.place,
         CASE WHEN len(w.pool) >= 5 OR len(list_filter(w.pool, lambda x: abs(q.d - x.d) / greatest(q.d, 1.0) < 0.08
                                                          AND abs(q.t - x.t) / greatest(q.t, 1.0) < 0.08)) > 0
              THEN w.pool ELSE list_append(w.pool, {{'i': q.route_idx, 'd': q.d, 't': q.t}}) END
  FROM walk w JOIN queue q ON q.request_id = w.request_id AND q.place = w.place + 1),
added AS (SELECT request_id, unnest(pool).i AS route_idx FROM (
            SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place DESC) AS rn FROM walk) WHERE rn = 1)
SELECT request_id, route_idx, 'via' AS kind FROM via
UNION ALL SELECT request_id, route_idx, kind FROM beside WHERE nth <= 2
UNION ALL SELECT request_id, route_idx, kind FROM nat
UNION ALL SELECT a.request_id, a.route_idx, 'synthetic' FROM added a JOIN queue q ON q.request_id = a.request_id AND q.route_idx = a.route_idx""")
def geo_route_pool(spark, sf):
    r = X.pooled_routes(spark, sf).select("request_id", "route_idx", "distance_m", "duration_s", "kind")
    return RT.route_pool(r).select("request_id", "route_idx", "kind")


_VIA_T = ", ".join(f"({i}, {t!r}, {s}, {sc!r})" for i, (t, s, sc) in
                   enumerate(__import__("airlake.functions.constants", fromlist=["_"]).VIA_CANDIDATES))


@register("geo_via_points", ctes(
    ("rq", f"""SELECT request_id, src_lat, src_lon, dst_lat, dst_lon,
       greatest(8.0::DOUBLE, least(250.0::DOUBLE, {G.haversine_km_sql('src_lat', 'src_lon', 'dst_lat', 'dst_lon')} * 0.15::DOUBLE)) AS off,
       dst_lat - src_lat AS dlat, dst_lon - src_lon AS dlon,
       sqrt((dst_lat - src_lat) * (dst_lat - src_lat) + (dst_lon - src_lon) * (dst_lon - src_lon)) AS mag,
       111.0::DOUBLE * greatest(0.05::DOUBLE, cos(radians((src_lat + dst_lat) / 2))) AS lonkm
       FROM route_ends WHERE route_idx = 0"""),
    ("vp", f"""SELECT request_id, src_lat, src_lon, dst_lat, dst_lon, CAST(via_no AS INTEGER) AS via_no,
       (src_lat + t * dlat) + sg * (-dlon / mag) * off * sc / 111.0::DOUBLE AS via_lat,
       (src_lon + t * dlon) + sg * (dlat / mag) * off * sc / lonkm AS via_lon
       FROM rq, (VALUES {_VIA_T}) v(via_no, t, sg, sc) WHERE mag >= 1e-9"""),
    select=f"""SELECT request_id, via_no, round(via_lat, 6) AS via_lat, round(via_lon, 6) AS via_lon,
       {G.direction_label_sql('src_lat', 'src_lon', 'dst_lat', 'dst_lon', 'via_lat', 'via_lon')} AS label FROM vp"""))
def geo_via_points(spark, sf):
    r = X.with_endpoints(X.route_candidates(spark, sf), X.cities(spark, sf)).filter("route_idx = 0")
    return RT.via_points(r).select("request_id", "via_no", F.round("via_lat", 6).alias("via_lat"),
                                   F.round("via_lon", 6).alias("via_lon"), "label")


@register("geo_via_options", ctes(*_dedupe_sql(), WPN,
    ("pool", """SELECT k.request_id, k.route_idx FROM kept k JOIN (SELECT request_id FROM kept GROUP BY 1
       HAVING count(*) > 3) b USING (request_id)"""),
    ("vo", f"""SELECT p.request_id, p.route_idx, w.lat AS via_lat, w.lon AS via_lon, w.npts,
       {G.direction_label_sql('e.src_lat', 'e.src_lon', 'e.dst_lat', 'e.dst_lon', 'w.lat', 'w.lon')} AS base
       FROM pool p JOIN wpn w ON p.request_id = w.request_id AND p.route_idx = w.route_idx
         AND w.pos = w.npts // 2
       JOIN route_ends e ON p.request_id = e.request_id AND p.route_idx = e.route_idx"""),
    select="""SELECT request_id, route_idx, via_lat, via_lon,
       CASE WHEN rn = 1 THEN base ELSE base || ' ' || CAST(rn AS VARCHAR) END AS label,
       CAST((npts - 1) // greatest(1, npts // 50) + 1 AS INTEGER) AS n_preview
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, base ORDER BY route_idx) AS rn FROM vo) x"""))
def geo_via_options(spark, sf):
    r, p = X.route_paths(spark, sf)
    r = r.select("request_id", "route_idx", "distance_m", "duration_s", "src_lat", "src_lon", "dst_lat", "dst_lon", "_n")
    o = RT.via_options(RT.dedupe_routes(r), p)
    return o.select("request_id", "route_idx", "via_lat", "via_lon", "label",
                    F.size("preview_waypoints").alias("n_preview"))


@register("geo_map_polyline", ctes(WPN, select="""
SELECT request_id, route_idx,
  CAST(count(*) FILTER (WHERE pos % greatest(1, npts // 200) = 0)
       + CASE WHEN max(npts - 1) % greatest(1, max(npts) // 200) = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_map_points
FROM wpn GROUP BY 1, 2"""))
def geo_map_polyline(spark, sf):
    m = RT.map_polyline(*X.route_paths(spark, sf))
    return m.select("request_id", "route_idx", F.size("map_waypoints").alias("n_map_points"))


def trips(spark, sf):
    c = cards(spark, sf, "user_id", "planned_start", "source_city_id", "dest_city_id").filter(
        F.col("route_type") == "balanced")
    names = X.cities(spark, sf)
    end = F.col("planned_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                      F.col("duration_s").cast("decimal(18,6)"))
    return (c.withColumn("planned_end", end)
            .join(names.select(F.col("city_id").alias("source_city_id"), F.col("name").alias("source_name")),
                  "source_city_id")
            .join(names.select(F.col("city_id").alias("dest_city_id"), F.col("name").alias("dest_name")),
                  "dest_city_id"))


TRIPS = CLASSIFY + [
    ("trips", """SELECT c.*, c.planned_start + to_microseconds(CAST(round(c.duration_s * 1000000) AS BIGINT))
        AS planned_end, s.name AS source_name, d.name AS dest_name
     FROM cards c JOIN cities s ON c.source_city_id = s.city_id JOIN cities d ON c.dest_city_id = d.city_id
     WHERE route_type = 'balanced'"""),
    ("t1", """SELECT t.*, p.* EXCLUDE (user_id, exposure_hours),
       greatest(0.25::DOUBLE, least(12.0::DOUBLE, (epoch_us(planned_end) - epoch_us(planned_start)) / 3.6e9))
         AS trip_hours
     FROM trips t JOIN profiles p ON t.user_id = p.user_id WHERE planned_end > planned_start"""),
    ("t2", scored_sql("t1", "avg_aqi", "trip_hours")),
    ("t3", f"SELECT *, {R.risk_category_sql('risk_score')} AS risk_category FROM t2"),
]


@register("geo_planned_route_risk", ctes(*TRIPS, select=f"""
SELECT request_id, user_id, trip_hours, risk_score, risk_category,
  risk_category IN ('High', 'Severe') AS health_warning,
  CASE WHEN risk_category IN ('High', 'Severe') THEN
    'Route Health Alert (' || risk_category || ' Risk): Your planned journey from ' || source_name || ' to ' ||
    dest_name || ' on ' || strftime(planned_start, '%b %d, %H:%M') || ' – ' || strftime(planned_end, '%H:%M') ||
    ' has a personal risk score of ' || CAST(CAST(round_even(risk_score, 0) AS BIGINT) AS VARCHAR) ||
    '/100 based on the route''s avg AQI (' || CAST(CAST(round_even(avg_aqi, 0) AS BIGINT) AS VARCHAR) ||
    ') and your health profile. ' ||
    {R.explanation_sql('risk_score', 'risk_category', 'avg_aqi', 'condition_contribution',
                       'activity_contribution', 'duration_contribution')} END AS warning_message
FROM t3"""))
def geo_planned_route_risk(spark, sf):
    r = RT.planned_route_risk(trips(spark, sf), X.profiles(spark, sf))
    return r.select("request_id", "user_id", "trip_hours", "risk_score", "risk_category",
                    "health_warning", "warning_message")


@register("geo_route_history", ctes(*CLASSIFY, ("sv", """SELECT *, planned_start AS created_at FROM cards
     WHERE planned_start >= (SELECT max(planned_start) FROM cards) - INTERVAL 30 DAY"""), select="""
SELECT user_id, request_id, route_type, created_at, count(*) OVER (PARTITION BY user_id) AS count FROM sv"""))
def geo_route_history(spark, sf):
    c = cards(spark, sf, "user_id", "planned_start").select("user_id", "request_id", "route_type", F.col("planned_start").alias("created_at"))
    c = cut_lineage(c)  # read for the newest, the counts and the rows: four columns are kept, not scored again
    newest = c.agg(F.max("created_at")).scalar()
    h = RT.route_history(c, newest, 30)
    return h.select("user_id", "request_id", "route_type", "created_at", "count")


@register("geo_arrival_time", ctes(*CLASSIFY, select="""
SELECT request_id, route_type, planned_start + to_microseconds(CAST(round(time_min * 60 * 1000000) AS BIGINT))
  AS arrival_at FROM cards"""))
def geo_arrival_time(spark, sf):
    return RT.arrival_time(cards(spark, sf, "planned_start")).select("request_id", "route_type", "arrival_at")


@register("geo_waypoints", """
SELECT request_id, route_idx, pos, round(lat * 100000.0) / 100000.0 AS lat,
       round(lon * 100000.0) / 100000.0 AS lon FROM waypoints""")
def geo_waypoints(spark, sf):
    """GEO-5 (rows-only): geometries encoded to polylines, then decoded back
    into ordered waypoint rows on the executors."""
    from ..operators.polyline import decode_waypoints, encode_geometry
    g = X.route_geometry(spark, sf).select("request_id", "route_idx", "geometry")
    enc = g.withColumn("polyline", encode_geometry(F.col("geometry"))).drop("geometry")
    return decode_waypoints(enc, ["request_id", "route_idx"], "polyline")
