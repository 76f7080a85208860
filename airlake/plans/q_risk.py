"""Registered personal-risk queries (RSK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions.stats import exact_avg, exact_avg_sql
from ..operators import risk as K
from ..operators import serving as S
from ..sources import fixtures as X
from .inputs import as_of, facts
from .oracle_views import ctes
from .registry import register

SCORE_COLS = ["user_id", "home_city_id", "aqi", "risk_score", "risk_category", *R.FACTOR_NAMES]


def exposure_risk_sql(aqi: str = "aqi", hours: str = "exposure_hours", activity: str = "activity_level") -> str:
    """SELECT-list of the RSK-7 factor, score and category columns; needs a
    ``raw`` pass, so it is used as two nested selects."""
    base = R.base_score_sql(aqi)
    age = R.age_multiplier_sql("age")
    cond = R.condition_multiplier_sql()
    act = R.activity_multiplier_sql(activity)
    dur = R.duration_multiplier_sql(hours)
    sens = R.sensitivity_multiplier_sql("coalesce(sensitivity_level, 'moderate')")
    return (f"{base} AS f_base, {age} AS f_age, {cond} AS f_cond, {act} AS f_act, "
            f"{dur} AS f_dur, {sens} AS f_sens")


def scored_sql(src: str, aqi: str = "aqi", hours: str = "exposure_hours") -> str:
    return f"""SELECT *, round_even(least(100.0::DOUBLE, f_base * f_age * f_cond * f_act * f_dur * f_sens * 100), 1)
         AS risk_score,
       round_even(f_base, 3) AS aqi_contribution, round_even(f_age, 3) AS age_contribution,
       round_even(f_cond, 3) AS condition_contribution, round_even(f_act, 3) AS activity_contribution,
       round_even(f_dur, 3) AS duration_contribution, round_even(f_sens, 3) AS sensitivity_contribution
FROM (SELECT *, {exposure_risk_sql(aqi, hours)} FROM {src}) z"""


CITY_AQI = ("city_aqi", """SELECT city_id AS home_city_id, arg_max(india_aqi, datetime) AS aqi
     FROM facts WHERE india_aqi IS NOT NULL GROUP BY city_id""")
USERS = [CITY_AQI,
         ("u0", "SELECT * FROM profiles JOIN city_aqi USING (home_city_id)"),
         ("u1", scored_sql("u0")),
         ("users", f"SELECT *, {R.risk_category_sql('risk_score')} AS risk_category FROM u1")]


def _users(spark, sf, with_text=False):
    f = facts(spark, sf)
    return K.score_users(X.profiles(spark, sf), S.latest_nonnull_aqi(f).drop("aqi_at"), with_text)


@register("rsk_score_users", ctes(*USERS, select=f"SELECT {', '.join(SCORE_COLS)} FROM users"))
def rsk_score_users(spark, sf):
    return _users(spark, sf).select(*SCORE_COLS)


@register("rsk_base_score", f"""
SELECT station_id, datetime, {R.base_score_sql('india_aqi')} AS base_score FROM facts
WHERE india_aqi IS NOT NULL""")
def rsk_base_score(spark, sf):
    f = facts(spark, sf).filter(F.col("india_aqi").isNotNull())
    return f.select("station_id", "datetime", R.base_score("india_aqi").alias("base_score"))


@register("rsk_recommendations", ctes(*USERS, select=f"""
SELECT user_id, risk_category, {R.recommendations_sql('risk_category')} AS recommendations FROM users"""))
def rsk_recommendations(spark, sf):
    return _users(spark, sf, True).select("user_id", "risk_category", "recommendations")


@register("rsk_explanation", ctes(*USERS, select=f"""
SELECT user_id, {R.explanation_sql('risk_score', 'risk_category', 'aqi', 'condition_contribution',
                                   'activity_contribution', 'duration_contribution')} AS explanation
FROM users"""))
def rsk_explanation(spark, sf):
    return _users(spark, sf, True).select("user_id", "explanation")


SNAP_PROFILE = """SELECT c.*, a.aqi, 30 AS age, false AS respiratory_disease, false AS heart_disease,
       false AS diabetes, false AS kidney_disease, false AS is_smoker, false AS is_pregnant,
       'moderate' AS sensitivity_level, 2.0::DOUBLE AS exposure_hours, 'light' AS activity_level
FROM cities c JOIN city_aqi a ON c.city_id = a.home_city_id WHERE c.is_active"""


@register("rsk_city_snapshot", ctes(CITY_AQI, ("sp", SNAP_PROFILE), ("s1", scored_sql("sp")), select=f"""
SELECT name AS city, state, latitude, longitude, aqi AS current_aqi, risk_score,
       {R.risk_category_sql('risk_score')} AS risk_category FROM s1"""))
def rsk_city_snapshot(spark, sf):
    f = facts(spark, sf)
    return K.city_snapshot(X.cities(spark, sf), S.latest_nonnull_aqi(f).drop("aqi_at"))


DAILY = ("daily", f"""SELECT city_id AS home_city_id, CAST(datetime AS DATE) AS day,
       round({exact_avg_sql('india_aqi', 1)}, 1) AS aqi
FROM facts WHERE india_aqi IS NOT NULL GROUP BY 1, 2""")
LOGS = [DAILY,
        ("l0", "SELECT * FROM profiles JOIN daily USING (home_city_id)"),
        ("l1", scored_sql("l0")),
        ("logs", f"""SELECT user_id, home_city_id AS city_id, CAST(day AS TIMESTAMP) AS created_at,
               aqi AS aqi_used, risk_score, {R.risk_category_sql('risk_score')} AS risk_category FROM l1""")]


def daily_city_aqi(f):
    return (f.filter(F.col("india_aqi").isNotNull())
            .groupBy("city_id", F.to_date("datetime").alias("day"))
            .agg(F.round(exact_avg("india_aqi", 1), 1).alias("aqi")))


@register("rsk_risk_history", ctes(*LOGS, ("recent", """SELECT * FROM logs WHERE created_at >=
     (SELECT max(datetime) FROM facts) - INTERVAL 7 DAY"""), select="""
SELECT r.user_id, created_at, c.name AS city, aqi_used, risk_score, risk_category,
       count(*) OVER (PARTITION BY r.user_id) AS count
FROM recent r LEFT JOIN cities c ON r.city_id = c.city_id"""))
def rsk_risk_history(spark, sf):
    f = facts(spark, sf)
    logs = K.daily_risk_log(X.profiles(spark, sf), daily_city_aqi(f))
    return K.risk_history(logs, X.cities(spark, sf), as_of(f), days=7)


_LABELS = ", ".join(f"({i}, '{n}', '{label}')" for i, (n, label) in
                    enumerate(zip(R.FACTOR_NAMES, R.FACTOR_LABELS)))
BREAKDOWN = USERS + [
    ("fl", f"SELECT * FROM (VALUES {_LABELS}) t(position, factor, label)"),
    ("fr", f"""SELECT u.user_id, u.risk_score, u.risk_category, CAST(fl.position AS INTEGER) AS position,
       fl.factor, fl.label,
       CASE fl.factor {' '.join(f"WHEN '{n}' THEN u.{n}" for n in R.FACTOR_NAMES)} END AS value
FROM users u, fl"""),
    ("bd", """SELECT *, CASE WHEN value = 1.0 THEN 'neutral' WHEN value > 1.0 THEN 'increases_risk'
            ELSE 'decreases_risk' END AS impact,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 1.0) DESC, position) AS INTEGER)
         AS dominance_rank
FROM fr"""),
]


@register("rsk_factor_breakdown", ctes(*BREAKDOWN, select="SELECT * FROM bd"))
def rsk_factor_breakdown(spark, sf):
    return K.factor_breakdown(_users(spark, sf))


@register("rsk_factor_narrative", ctes(*BREAKDOWN, select="""
SELECT user_id, 'Your risk score of ' || CAST(CAST(round_even(max(risk_score), 0) AS BIGINT) AS VARCHAR) ||
  '/100 (' || max(risk_category) || ') ' ||
  CASE WHEN count(CASE WHEN dominance_rank <= 2 AND value <> 1.0 THEN 1 END) > 0
       THEN 'was most influenced by: ' ||
            string_agg(CASE WHEN dominance_rank <= 2 AND value <> 1.0 THEN label END, ', '
                       ORDER BY dominance_rank) || '.'
       ELSE 'is primarily driven by the current AQI level.' END AS narrative
FROM bd GROUP BY user_id"""))
def rsk_factor_narrative(spark, sf):
    return K.factor_narrative(K.factor_breakdown(_users(spark, sf)))
