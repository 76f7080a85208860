"""Registered alert queries (ALR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi as A
from ..operators import alerts as AL
from ..operators import routes as RT
from ..operators import serving as S
from ..sources import fixtures as X
from ..session import cut_lineage
from .inputs import as_of, facts
from .oracle_views import ctes
from ..functions import risk as R
from .q_risk import scored_sql
from .q_routes import CLASSIFY, cards
from .registry import register

CITY_AQI = ("city_aqi", """SELECT city_id, arg_max(india_aqi, datetime) AS aqi
     FROM facts WHERE india_aqi IS NOT NULL GROUP BY city_id""")
NOW = "(SELECT max(datetime) FROM facts)"


def _cat(c: str) -> str:
    return A.india_category_sql(c, "Unknown")


def _int(c: str) -> str:
    return f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR)"


CAND = [CITY_AQI, ("cand", f"""SELECT p.user_id, p.home_city_id AS city_id, 'aqi_threshold' AS notification_type,
       a.aqi AS aqi_value, CASE WHEN p.aqi_threshold IS NULL OR p.aqi_threshold = 0 THEN 100
                              ELSE p.aqi_threshold END AS threshold,
       'AQI Alert: ' || upper(substr(c.name, 1, 1)) || lower(substr(c.name, 2)) || ' AQI is now ' ||
       {_int('a.aqi')} || ' (' || {_cat('a.aqi')} || '), exceeding your threshold of ' ||
       CAST(CASE WHEN p.aqi_threshold IS NULL OR p.aqi_threshold = 0 THEN 100 ELSE p.aqi_threshold END AS VARCHAR)
       || '. Consider limiting outdoor activity.' AS message
  FROM profiles p JOIN city_aqi a ON p.home_city_id = a.city_id JOIN cities c ON p.home_city_id = c.city_id
  WHERE p.home_city_id IS NOT NULL AND a.aqi > CASE WHEN p.aqi_threshold IS NULL OR p.aqi_threshold = 0
        THEN 100 ELSE p.aqi_threshold END""")]


def _candidates(spark, sf):
    f = facts(spark, sf)
    return AL.threshold_alerts(X.profiles(spark, sf), S.latest_nonnull_aqi(f).drop("aqi_at"),
                               X.cities(spark, sf))


@register("alr_threshold_candidates", ctes(*CAND, select="SELECT * FROM cand"))
def alr_threshold_candidates(spark, sf):
    return _candidates(spark, sf)


@register("alr_threshold_alerts", ctes(*CAND, select=f"""
SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM notices n WHERE n.user_id = c.user_id
  AND n.notification_type = c.notification_type AND (c.city_id IS NULL OR n.city_id = c.city_id)
  AND n.sent_at >= {NOW} - INTERVAL 6 HOUR)"""))
def alr_threshold_alerts(spark, sf):
    f = facts(spark, sf)
    return AL.cooldown(_candidates(spark, sf), X.notices(spark, sf), as_of(f), 6)


def saved_routes(spark, sf):
    """Saved routes: the balanced card of every request, written once (a
    request's one row), as the newest start is needed before they are filtered."""
    c = cards(spark, sf, "user_id", "planned_start", "src_lat", "src_lon", "source_city_id", "dest_city_id").filter(
        F.col("route_type") == "balanced")
    end = F.col("planned_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                      F.col("duration_s").cast("decimal(18,6)"))
    names = X.cities(spark, sf)
    c = cut_lineage(c.select(F.col("request_id").alias("route_id"), "user_id", "planned_start", end.alias("planned_end"),
                             "src_lat", "src_lon", F.col("avg_aqi").alias("avg_aqi_exposure"), "source_city_id",
                             "dest_city_id"))
    return (c.join(names.select(F.col("city_id").alias("source_city_id"), F.col("name").alias("source_name")),
                  "source_city_id")
            .join(names.select(F.col("city_id").alias("dest_city_id"), F.col("name").alias("dest_name")),
                  "dest_city_id"))


def _now(saved):
    return saved.agg(F.max("planned_start")).scalar() - F.make_dt_interval(F.lit(7))


SAVED = CLASSIFY + [
    ("saved", """SELECT c.request_id AS route_id, c.user_id, c.planned_start,
       c.planned_start + to_microseconds(CAST(round(c.duration_s * 1000000) AS BIGINT)) AS planned_end,
       c.src_lat, c.src_lon, c.avg_aqi AS avg_aqi_exposure, s.name AS source_name, d.name AS dest_name
     FROM cards c JOIN cities s ON c.source_city_id = s.city_id JOIN cities d ON c.dest_city_id = d.city_id
     WHERE c.route_type = 'balanced'"""),
    ("nw", "SELECT max(planned_start) - INTERVAL 7 DAY AS now FROM saved"),
    ("up", """SELECT s.*, (epoch_us(s.planned_start) - epoch_us(nw.now)) / 3.6e9 AS hours_until
     FROM saved s, nw WHERE s.planned_start > nw.now AND s.planned_start <= nw.now + INTERVAL 7 DAY"""),
    ("tier", """SELECT *, CAST(CASE WHEN hours_until > 168 THEN NULL WHEN hours_until > 72 THEN 36.0
       WHEN hours_until > 24 THEN 18.0 WHEN hours_until > 6 THEN 4.0 ELSE 2.0 END AS DOUBLE) AS cooldown_hours
       FROM up"""),
    ("cool", """SELECT t.* FROM tier t, nw WHERE t.cooldown_hours IS NOT NULL AND NOT EXISTS (
       SELECT 1 FROM notices n WHERE n.notification_type IN ('route_saved', 'route_monitor')
         AND n.route_id = t.route_id AND n.user_id = t.user_id
         AND n.sent_at >= nw.now - to_microseconds(CAST(round(t.cooldown_hours * 3600 * 1000000) AS BIGINT)))"""),
]


def _upcoming(spark, sf):
    s = saved_routes(spark, sf)
    now = _now(s)
    u = AL.upcoming_routes(s, now)
    return u.withColumn("hours_until", AL.hours_until(F.col("planned_start"), now)), now


@register("alr_upcoming_routes", ctes(*SAVED, select="SELECT route_id, user_id, planned_start, hours_until FROM up"))
def alr_upcoming_routes(spark, sf):
    u, _ = _upcoming(spark, sf)
    return u.select("route_id", "user_id", "planned_start", "hours_until")


@register("alr_route_cooldown_tier", ctes(*SAVED, select="SELECT route_id, hours_until, cooldown_hours FROM tier"))
def alr_route_cooldown_tier(spark, sf):
    u, _ = _upcoming(spark, sf)
    return u.select("route_id", "hours_until", AL.cooldown_tier(F.col("hours_until")).alias("cooldown_hours"))


@register("alr_route_cooldown", ctes(*SAVED, select="SELECT route_id, user_id, cooldown_hours FROM cool"))
def alr_route_cooldown(spark, sf):
    u, now = _upcoming(spark, sf)
    u = u.withColumn("cooldown_hours", AL.cooldown_tier(F.col("hours_until"))).filter(
        F.col("cooldown_hours").isNotNull())
    return AL.route_cooldown(u, X.notices(spark, sf), now).select("route_id", "user_id", "cooldown_hours")


MON = SAVED + [
    CITY_AQI,
    ("rnear", """SELECT route_id, city_id FROM (SELECT c.route_id, ci.city_id, row_number() OVER (
       PARTITION BY c.route_id ORDER BY """ + __import__("airlake.functions.geo", fromlist=["_"]).haversine_km_sql(
        "c.src_lat", "c.src_lon", "ci.latitude", "ci.longitude") + """, ci.city_id) AS rn
       FROM cool c, cities ci) x WHERE rn = 1"""),
    ("cur", """SELECT c.*, a.city_id, a.aqi AS current_aqi FROM cool c JOIN rnear n USING (route_id)
       JOIN city_aqi a ON n.city_id = a.city_id"""),
    ("lastn", """SELECT route_id AS r, arg_max(aqi_value, sent_at) AS last_aqi FROM notices
       WHERE notification_type IN ('route_saved', 'route_monitor') GROUP BY route_id"""),
    ("prev", """SELECT c.*, coalesce(l.last_aqi, CASE WHEN avg_aqi_exposure <> 0 THEN avg_aqi_exposure END,
       current_aqi) AS previous_aqi FROM cur c LEFT JOIN lastn l ON c.route_id = l.r"""),
    ("chg", f"""SELECT *, abs(current_aqi - previous_aqi) AS aqi_change,
       abs(current_aqi - previous_aqi) / greatest(previous_aqi, 1.0) * 100 AS aqi_change_pct,
       (hours_until <= 24 AND current_aqi > 200) OR ({_cat('current_aqi')} <> {_cat('previous_aqi')})
         OR abs(current_aqi - previous_aqi) >= 20
         OR abs(current_aqi - previous_aqi) / greatest(previous_aqi, 1.0) * 100 >= 15 AS should_notify
       FROM prev"""),
]


def _monitor_inputs(spark, sf):
    s = saved_routes(spark, sf)
    now = _now(s)
    f = facts(spark, sf)
    return s, now, S.latest_nonnull_aqi(f).drop("aqi_at").withColumnRenamed("aqi", "aqi")


def _previous(spark, sf):
    """Upcoming routes outside their cooldown, with current and previous AQI."""
    s, now, ca = _monitor_inputs(spark, sf)
    u = AL.upcoming_routes(s, now).withColumn("hours_until", AL.hours_until(F.col("planned_start"), now))
    u = u.withColumn("cooldown_hours", AL.cooldown_tier(F.col("hours_until"))).filter(
        F.col("cooldown_hours").isNotNull())
    u = cut_lineage(AL.route_cooldown(u, X.notices(spark, sf), now))  # few rows of a long plan, read four times
    pts = u.select("route_id", F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon"))
    near = RT.nearest(pts, ["route_id"], X.cities(spark, sf)).select("route_id", F.col("nearest_id").alias("city_id"))
    u = u.join(near, "route_id").join(ca.withColumnRenamed("aqi", "current_aqi"), "city_id")
    return AL.previous_aqi(u, X.notices(spark, sf))


@register("alr_previous_aqi", ctes(*MON, select="SELECT route_id, current_aqi, previous_aqi FROM prev"))
def alr_previous_aqi(spark, sf):
    return _previous(spark, sf).select("route_id", "current_aqi", "previous_aqi")


@register("alr_route_change", ctes(*MON, select="""
SELECT route_id, aqi_change, aqi_change_pct, should_notify FROM chg"""))
def alr_route_change(spark, sf):
    return AL.route_change(_previous(spark, sf)).select("route_id", "aqi_change", "aqi_change_pct", "should_notify")


@register("alr_route_monitor", ctes(*MON,
    ("mf1", """SELECT m.*, p.* EXCLUDE (user_id, exposure_hours),
       greatest(0.25::DOUBLE, least(12.0::DOUBLE, (epoch_us(planned_end) - epoch_us(planned_start)) / 3.6e9))
         AS trip_hours FROM chg m LEFT JOIN profiles p ON m.user_id = p.user_id WHERE should_notify"""),
    ("mf2", scored_sql("mf1", "current_aqi", "trip_hours")),
    ("mf3", f"SELECT *, {R.risk_category_sql('risk_score')} AS risk_category FROM mf2"),
    select=f"""SELECT route_id, user_id, current_aqi, previous_aqi, risk_score, risk_category,
  'AQI Update for ' || coalesce(source_name, 'origin') || ' \u2192 ' || coalesce(dest_name, 'destination') ||
  ': current AQI ' || {_int('current_aqi')} || ' (' || {_cat('current_aqi')} || ')' ||
  coalesce(' | Risk: ' || risk_category, '') || '. ' || {_int('hours_until')} || 'h until departure.' AS message FROM mf3"""))
def alr_route_monitor(spark, sf):
    s, now, ca = _monitor_inputs(spark, sf)
    m = AL.route_monitor(s, X.notices(spark, sf), ca, X.cities(spark, sf), X.profiles(spark, sf), now,
                         RT.nearest)
    return m.select("route_id", "user_id", "current_aqi", "previous_aqi", "risk_score", "risk_category",
                    "message")


@register("alr_alert_texts", ctes(*MON, select="""
SELECT route_id,
  CASE WHEN hours_until <= 6 THEN 'URGENT - ' WHEN hours_until <= 24 THEN 'AQI Alert - '
       ELSE 'AQI Update - ' END AS urgency,
  CASE WHEN hours_until < 1 THEN CAST(CAST(floor(hours_until * 60) AS BIGINT) AS VARCHAR) || ' minutes'
       WHEN hours_until < 24 THEN CAST(CAST(floor(hours_until) AS BIGINT) AS VARCHAR) ||
            CASE WHEN CAST(floor(hours_until) AS BIGINT) <> 1 THEN ' hours' ELSE ' hour' END
       ELSE CAST(CAST(floor(hours_until / 24) AS BIGINT) AS VARCHAR) ||
            CASE WHEN CAST(floor(hours_until / 24) AS BIGINT) <> 1 THEN ' days' ELSE ' day' END END AS countdown
FROM up"""))
def alr_alert_texts(spark, sf):
    u, _ = _upcoming(spark, sf)
    h = F.col("hours_until")
    return u.select("route_id", AL.urgency_prefix(h).alias("urgency"), AL.countdown(h).alias("countdown"))


@register("alr_inbox", """
SELECT n.notice_id, n.user_id, n.city_id, n.route_id, n.notification_type, n.aqi_value, n.sent_at, n.is_read,
       n.read_at, CAST(n.position AS INTEGER) AS position, c.name AS city,
       CASE n.notification_type WHEN 'aqi_threshold' THEN 'AQI Threshold Alert'
            WHEN 'forecast_alert' THEN 'Forecast Alert' WHEN 'risk_alert' THEN 'Health Risk Alert'
            ELSE 'Notification' END AS title
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_read, sent_at DESC, notice_id DESC)
      AS position FROM notices) n LEFT JOIN cities c ON n.city_id = c.city_id
WHERE n.position <= 50""")
def alr_inbox(spark, sf):
    i = AL.inbox(X.notices(spark, sf), X.cities(spark, sf), limit=50)
    return i.withColumn("position", F.col("position").cast("int"))


@register("alr_unread_counts", """
SELECT user_id, count(*) AS unread FROM notices WHERE NOT is_read GROUP BY user_id""")
def alr_unread_counts(spark, sf):
    return AL.unread_counts(X.notices(spark, sf))


@register("alr_mark_read", """
SELECT notice_id, user_id, city_id, route_id, notification_type, aqi_value, sent_at,
       is_read OR notification_type = 'aqi_threshold' AS is_read,
       CASE WHEN notification_type = 'aqi_threshold' AND NOT is_read THEN (SELECT max(ts) FROM events)
            ELSE read_at END AS read_at
FROM notices""")
def alr_mark_read(spark, sf):
    n = X.notices(spark, sf)
    ids = n.filter(F.col("notification_type") == "aqi_threshold").select("notice_id")
    at = n.agg(F.max("sent_at")).scalar()
    return AL.mark_read(n, ids, at)
