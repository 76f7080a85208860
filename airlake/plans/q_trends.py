"""Registered trend and pollutant queries (TRD-*, POL-*)."""

from __future__ import annotations

from ..functions import calendar as C
from ..functions import constants as K
from ..functions.stats import exact_avg_sql, exact_mean_sql, round_sql
from ..operators import pollutants as P
from ..operators import trends as T
from .inputs import as_of, facts
from .oracle_views import ctes
from .registry import register

SCOPE = ("s", """SELECT f.*, a.as_of FROM facts f, (SELECT max(datetime) AS as_of FROM facts) a
          WHERE f.datetime >= a.as_of - INTERVAL 90 DAY AND f.india_aqi IS NOT NULL""")
_L7 = "datetime >= as_of - INTERVAL 7 DAY"
_P7 = "datetime >= as_of - INTERVAL 14 DAY AND datetime < as_of - INTERVAL 7 DAY"
_L30 = "datetime >= as_of - INTERVAL 30 DAY"

PER_G = ("per_g", f"""SELECT city, count(*) AS n_rows,
             {round_sql(exact_avg_sql('india_aqi', 1, _L7), 1)} AS avg_aqi_7d,
             {round_sql(exact_avg_sql('india_aqi', 1, _L30), 1)} AS avg_aqi_30d,
             {exact_avg_sql('india_aqi', 1, _P7)} AS prior_avg
      FROM s GROUP BY city HAVING count(*) >= 24""")
PER_H = ("per_h", """SELECT *, (avg_aqi_7d - prior_avg) / prior_avg * 100 AS chg,
             coalesce(avg_aqi_7d <> 0 AND prior_avg > 0, false) AS has FROM per_g""")
PER = ("per", """SELECT city, n_rows, avg_aqi_7d, avg_aqi_30d,
       CASE WHEN has THEN round(chg, 1) END AS change_7d_pct,
       CASE WHEN has AND chg < -5 THEN 'improving' WHEN has AND chg > 5 THEN 'worsening'
            ELSE 'stable' END AS trend_direction
FROM per_h""")
PERIOD = [SCOPE, PER_G, PER_H, PER]

TOD_BUCKET = f"coalesce(time_of_day, {C.time_of_day_sql('hour(datetime)')})"
DOW_BUCKET = "dayname(datetime)"


def pattern_ctes(p: str, bucket: str, where: str = "") -> list[tuple[str, str]]:
    return [SCOPE,
            (f"{p}_b", f"SELECT *, {bucket} AS bucket FROM s {where}"),
            (f"{p}_m", f"SELECT city, bucket, {exact_avg_sql('india_aqi', 1)} AS mean "
                       f"FROM {p}_b GROUP BY 1, 2"),
            (f"{p}_r", f"""SELECT *, row_number() OVER (PARTITION BY city ORDER BY mean DESC, bucket) AS rw,
             row_number() OVER (PARTITION BY city ORDER BY mean ASC, bucket) AS rb FROM {p}_m"""),
            (p, f"SELECT city, bucket, {round_sql('mean', 1)} AS avg_aqi, rw = 1 AS is_worst, "
                f"rb = 1 AS is_best FROM {p}_r")]


TOD = pattern_ctes("tod", TOD_BUCKET)
DOW = pattern_ctes("dow", DOW_BUCKET)
SEA = pattern_ctes("sea", "season", "WHERE season IS NOT NULL")


@register("trd_period_averages", ctes(*PERIOD, select="SELECT * FROM per"))
def trd_period_averages(spark, sf):
    f = facts(spark, sf)
    return T.period_averages(f, as_of(f))


@register("trd_time_of_day_pattern", ctes(*TOD, select="SELECT * FROM tod"))
def trd_time_of_day_pattern(spark, sf):
    f = facts(spark, sf)
    return T.pattern(f, as_of(f), "time_of_day")


@register("trd_day_of_week_pattern", ctes(*DOW, select="SELECT * FROM dow"))
def trd_day_of_week_pattern(spark, sf):
    f = facts(spark, sf)
    return T.pattern(f, as_of(f), "day_of_week")


@register("trd_season_pattern", ctes(*SEA, select="SELECT * FROM sea"))
def trd_season_pattern(spark, sf):
    f = facts(spark, sf)
    return T.pattern(f, as_of(f), "season")


@register("trd_patterns", ctes(*TOD, *DOW, *SEA, select="""
SELECT city, 'time_of_day' AS kind, bucket, avg_aqi, is_worst, is_best FROM tod
UNION ALL SELECT city, 'day_of_week', bucket, avg_aqi, is_worst, is_best FROM dow
UNION ALL SELECT city, 'season', bucket, avg_aqi, is_worst, is_best FROM sea"""))
def trd_patterns(spark, sf):
    f = facts(spark, sf)
    return T.patterns(f, as_of(f))


@register("trd_pattern_maps", ctes(*TOD, select="""
SELECT city, map_from_entries(list(struct_pack(k := bucket, v := avg_aqi) ORDER BY bucket)) AS averages
FROM tod GROUP BY city"""))
def trd_pattern_maps(spark, sf):
    f = facts(spark, sf)
    return T.pattern_maps(f, as_of(f), "time_of_day")


_PCT0 = "CAST(CAST(round_even(abs(change_7d_pct), 0) AS BIGINT) AS VARCHAR)"


@register("trd_trend_narrative", ctes(*PERIOD, *TOD, *SEA, select=f"""
SELECT per.city, trend_direction,
  upper(substr(per.city, 1, 1)) || lower(substr(per.city, 2)) || ' — ' ||
  CASE trend_direction
    WHEN 'improving' THEN 'Air quality has improved by ' || {_PCT0} || '% over the last 7 days.'
    WHEN 'worsening' THEN 'Air quality has worsened by ' || {_PCT0} || '% over the last 7 days.'
    ELSE 'Air quality has been relatively stable over the last 7 days.' END ||
  ' Avoid outdoor activity during ' || replace(tw.bucket, '_', ' ') ||
  ' hours. Air is cleanest during ' || replace(tb.bucket, '_', ' ') ||
  '. Worst season historically: ' || replace(coalesce(sw.bucket, 'unknown'), '_', ' ') || '.' AS narrative
FROM per JOIN (SELECT city, bucket FROM tod WHERE is_worst) tw ON per.city = tw.city
     JOIN (SELECT city, bucket FROM tod WHERE is_best) tb ON per.city = tb.city
     LEFT JOIN (SELECT city, bucket FROM sea WHERE is_worst) sw ON per.city = sw.city"""))
def trd_trend_narrative(spark, sf):
    f = facts(spark, sf)
    return T.trend_narrative(f, as_of(f))


# -- pollutants --------------------------------------------------------------

_STD_ROWS = ", ".join(f"({i}, '{n}', '{c}', {s!r}::DOUBLE)" for i, (n, c, s) in enumerate(K.POLLUTANT_STANDARDS))


def _unpivot(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT city, datetime, '{c}' AS column_name, {c} AS value FROM {src} WHERE {c} IS NOT NULL"
        for c in P.POLLUTANT_VALUE_COLUMNS)


SUMMARY = [
    ("rec", """SELECT f.* FROM facts f JOIN (SELECT city AS c, max(datetime) AS mx FROM facts GROUP BY 1) m
             ON f.city = m.c WHERE f.datetime >= m.mx - INTERVAL 7 DAY"""),
    ("lng", _unpivot("rec")),
    ("std", f"SELECT * FROM (VALUES {_STD_ROWS}) t(position, pollutant, column_name, national_standard)"),
    ("sg", f"""SELECT city, position, pollutant, std.column_name, national_standard, {exact_mean_sql('value')} AS mean,
             count(value) AS n, count(CASE WHEN value > national_standard THEN 1 END) AS n_over
      FROM lng JOIN std ON lng.column_name = std.column_name GROUP BY ALL"""),
    ("sm", f"""SELECT city, CAST(position AS INTEGER) AS position, pollutant, column_name, '{K.POLLUTANT_UNIT}' AS unit,
       national_standard, {round_sql('mean', 2)} AS avg_concentration,
       round(n_over / n * 100, 1) AS pct_exceeding_standard,
       CASE WHEN mean > national_standard THEN 'Exceeds standard' ELSE 'Within standard' END AS status
       FROM sg"""),
]
DOMINANT = SUMMARY + [
    ("so", """SELECT *, row_number() OVER (PARTITION BY city ORDER BY pct_exceeding_standard DESC, position)
              AS rn FROM sm"""),
    ("dom", """SELECT city, max(CASE WHEN rn = 1 THEN pollutant END) AS dominant,
       max(CASE WHEN pollutant = 'PM2.5' THEN pct_exceeding_standard END) AS pm25_pct,
       CAST(max(CASE WHEN pollutant = 'PM2.5' THEN 1 ELSE 0 END) AS INTEGER) AS has_pm25
       FROM so GROUP BY city"""),
]


@register("pol_unpivot_pollutants", ctes(("rec", "SELECT * FROM facts"), select=_unpivot("rec")))
def pol_unpivot_pollutants(spark, sf):
    return P.unpivot_pollutants(facts(spark, sf))


@register("pol_pollutant_summary", ctes(*SUMMARY, select="SELECT * FROM sm"))
def pol_pollutant_summary(spark, sf):
    return P.pollutant_summary(facts(spark, sf), 7)


@register("pol_dominant_pollutant", ctes(*DOMINANT, select="SELECT * FROM dom"))
def pol_dominant_pollutant(spark, sf):
    return P.dominant_pollutant(P.pollutant_summary(facts(spark, sf), 7))


@register("pol_pollutant_narrative", ctes(*DOMINANT, select="""
SELECT city, dominant,
  'Over the last 7 days in ' || upper(substr(city, 1, 1)) || lower(substr(city, 2)) || ', ' || dominant ||
  ' is the dominant pollutant by exceedance frequency. ' ||
  CASE WHEN has_pm25 = 1 THEN 'PM2.5 exceeded national standards ' ||
       CAST(CAST(round_even(pm25_pct, 0) AS BIGINT) AS VARCHAR) || '% of the time.' ELSE '' END AS narrative
FROM dom"""))
def pol_pollutant_narrative(spark, sf):
    return P.pollutant_narrative(P.pollutant_summary(facts(spark, sf), 7), 7)


@register("pol_share_of_standard", ctes(*SUMMARY, select="""
SELECT *, least(100.0::DOUBLE, avg_concentration / national_standard * 100) AS share_of_standard
FROM sm"""))
def pol_share_of_standard(spark, sf):
    return P.share_of_standard(P.pollutant_summary(facts(spark, sf), 7))
