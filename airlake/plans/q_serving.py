"""Registered serving queries (QRY-*) and enrichment checks (ENR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi as A
from ..functions import constants as K
from ..operators import enrich as E
from ..operators import serving as S
from ..sources import fixtures as X
from .inputs import as_of, facts
from .oracle_views import derived_sql
from .registry import register

CUR = ", ".join(S.CURRENT_COLUMNS)

LATEST_SQL = """(SELECT * FROM facts f WHERE datetime =
   (SELECT max(datetime) FROM facts g WHERE g.station_id = f.station_id))"""


@register("qry_list_cities", """
SELECT city_id AS id, name, state, latitude, longitude FROM cities WHERE is_active""")
def qry_list_cities(spark, sf):
    return S.list_cities(X.cities(spark, sf))


@register("qry_latest_per_city", f"SELECT city_id, {CUR} FROM {LATEST_SQL} t")
def qry_latest_per_city(spark, sf):
    return S.latest_per_city(facts(spark, sf))


@register("qry_rankings_desc", f"""
SELECT city_id, {CUR}, CAST(row_number() OVER (ORDER BY india_aqi DESC NULLS FIRST, city) AS INTEGER) AS rank
FROM {LATEST_SQL} t""")
def qry_rankings_desc(spark, sf):
    return S.rankings(S.latest_per_city(facts(spark, sf)), "desc")


@register("qry_rankings_asc", f"""
SELECT city_id, {CUR}, CAST(row_number() OVER (ORDER BY india_aqi ASC NULLS LAST, city) AS INTEGER) AS rank
FROM {LATEST_SQL} t""")
def qry_rankings_asc(spark, sf):
    return S.rankings(S.latest_per_city(facts(spark, sf)), "asc")


@register("qry_dataset_stats", """
SELECT count(*) AS total_records, (SELECT count(*) FROM cities) AS cities,
       min(datetime) AS date_from, max(datetime) AS date_to,
       CASE WHEN CAST(sum(CAST(india_aqi AS DECIMAL(18,1))) AS DOUBLE) / count(india_aqi) <> 0
            THEN round(CAST(sum(CAST(india_aqi AS DECIMAL(18,1))) AS DOUBLE) / count(india_aqi), 1)
       END AS avg_india_aqi
FROM facts""")
def qry_dataset_stats(spark, sf):
    return S.dataset_stats(facts(spark, sf), X.cities(spark, sf))


@register("qry_category_distribution", """
SELECT india_aqi_category AS category, count(*) AS rows FROM facts
WHERE india_aqi_category IS NOT NULL GROUP BY 1""")
def qry_category_distribution(spark, sf):
    return S.category_distribution(facts(spark, sf))


@register("qry_city_current", f"""
SELECT city, {", ".join(c for c in S.CURRENT_COLUMNS if c != "city")}
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS rn FROM facts) t
WHERE rn = 1""")
def qry_city_current(spark, sf):
    return S.city_current(facts(spark, sf))


@register("qry_city_history", """
SELECT city, datetime, india_aqi, india_aqi_category, pm2_5_ugm3, pm10_ugm3,
       count(*) OVER (PARTITION BY city) AS count
FROM facts WHERE datetime >= (SELECT max(datetime) FROM facts) - INTERVAL 7 DAY""")
def qry_city_history(spark, sf):
    f = facts(spark, sf)
    return S.city_history(f, as_of(f), days=7)


@register("qry_latest_nonnull_aqi", """
SELECT city_id, arg_max(india_aqi, datetime) AS aqi, max(datetime) AS aqi_at
FROM facts WHERE india_aqi IS NOT NULL GROUP BY city_id""")
def qry_latest_nonnull_aqi(spark, sf):
    return S.latest_nonnull_aqi(facts(spark, sf))


@register("qry_daily_mean_chart", """
WITH d AS (
  SELECT city, CAST(datetime AS DATE) AS day,
         CAST(floor(CAST(sum(CAST(india_aqi AS DECIMAL(18,1))) AS DOUBLE) / count(india_aqi) + 0.5)
              AS BIGINT) AS aqi
  FROM facts WHERE india_aqi IS NOT NULL GROUP BY 1, 2)
SELECT d.city, day, aqi, chart_min, chart_max,
       greatest(CAST(200 AS BIGINT), CAST(ceil(chart_max / 50) * 50 + 50 AS BIGINT)) AS axis_max
FROM d JOIN (SELECT city, min(aqi) AS chart_min, max(aqi) AS chart_max FROM d GROUP BY city) b
  ON d.city = b.city""")
def qry_daily_mean_chart(spark, sf):
    return S.daily_mean_chart(facts(spark, sf))


@register("qry_best_worst_city", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY india_aqi DESC NULLS FIRST, city) AS rank
           FROM {LATEST_SQL} t)
SELECT (SELECT city FROM r ORDER BY coalesce(india_aqi, 0.0), rank LIMIT 1) AS best_city,
       (SELECT india_aqi FROM r ORDER BY coalesce(india_aqi, 0.0), rank LIMIT 1) AS best_aqi,
       (SELECT city FROM r ORDER BY rank LIMIT 1) AS worst_city,
       (SELECT india_aqi FROM r ORDER BY rank LIMIT 1) AS worst_aqi""")
def qry_best_worst_city(spark, sf):
    return S.best_worst_city(S.rankings(S.latest_per_city(facts(spark, sf)), "desc"))


@register("qry_search_cities", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY india_aqi DESC NULLS FIRST, city) AS rank
           FROM {LATEST_SQL} t)
SELECT CAST(rank AS INTEGER) AS rank, city, state, india_aqi FROM r
WHERE contains(lower(city), 'a') OR contains(lower(state), 'a') ORDER BY rank LIMIT 8""")
def qry_search_cities(spark, sf):
    return S.search_cities(S.rankings(S.latest_per_city(facts(spark, sf)), "desc"), "a")


_ADV_CASE = ("CASE WHEN india_aqi IS NULL OR india_aqi = 0 THEN NULL WHEN india_aqi <= 50 THEN 0 "
             "WHEN india_aqi <= 100 THEN 1 WHEN india_aqi <= 200 THEN 2 WHEN india_aqi <= 300 THEN 3 "
             "WHEN india_aqi <= 400 THEN 4 ELSE 5 END")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ADVICE = ", ".join(
    f"({i}, {_text(rng)}, {_text(cat)}, {_text(who)}, {_text(sens)}, {_text(' | '.join(prec))})"
    for i, (_, rng, cat, who, sens, prec) in enumerate(K.AQI_ADVISORY))


@register("qry_advisory_for", f"""
SELECT t.city, t.india_aqi, t.band, a.range, a.category, a.who, a.sensitive, a.precautions
FROM (SELECT city, india_aqi, {_ADV_CASE} AS band FROM {LATEST_SQL} t) t
LEFT JOIN (VALUES {_ADVICE}) a(band, range, category, who, sensitive, precautions) ON t.band = a.band""")
def qry_advisory_for(spark, sf):
    """QRY-12: the whole advisory of each city; its precautions in one text."""
    adv = S.advisory_for(S.latest_per_city(facts(spark, sf)))
    return adv.select("city", "india_aqi", "band", "range", "category", "who", "sensitive",
                      F.array_join("precautions", " | ").alias("precautions"))


# -- enrichment --------------------------------------------------------------

@register("enr_add_derived", f"""
SELECT station_id, datetime, {derived_sql("datetime", "'nation'")},
       {A.india_category_sql('india_aqi')} AS india_aqi_category,
       {A.us_category_sql(A.us_aqi_sql('pm2_5_ugm3'))} AS aqi_category
FROM readings""")
def enr_add_derived(spark, sf):
    r = X.readings(spark, sf).withColumn("city", F.lit("nation"))
    d = E.add_derived(r)
    return d.select("station_id", "datetime", "month", "day_name", "is_weekend", "season",
                    "time_of_day", "is_raining", "heavy_rain", "festival_period",
                    "crop_burning_season", "india_aqi", "us_aqi", "pm25_category_india",
                    "india_aqi_category", "aqi_category")


@register("enr_india_aqi_legacy", f"""
SELECT station_id, datetime, {A.india_aqi_legacy_sql()} AS india_aqi_legacy,
       {A.india_category_legacy_sql(A.india_aqi_legacy_sql())} AS india_aqi_category_legacy
FROM readings""")
def enr_india_aqi_legacy(spark, sf):
    return E.add_legacy_aqi(X.readings(spark, sf)).select(
        "station_id", "datetime", "india_aqi_legacy", "india_aqi_category_legacy")


@register("enr_aqi_coverage", """
SELECT count(*) AS rows, count(india_aqi) AS rows_with_aqi,
       round(count(india_aqi) * 100.0::DOUBLE / count(*), 2) AS coverage_pct FROM facts""")
def enr_aqi_coverage(spark, sf):
    return E.aqi_coverage(facts(spark, sf))


@register("enr_category_counts", """
SELECT india_aqi_category, count(*) AS rows FROM facts GROUP BY 1""")
def enr_category_counts(spark, sf):
    return E.category_counts(facts(spark, sf))
