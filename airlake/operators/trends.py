"""Trend analysis (TRD-*), per city, all cities in one pass.

Period means are conditional aggregates in a single ``groupBy(city)``, so
the 90-day slice is scanned once and partially aggregated before the
shuffle (a hot city costs one partial row per task, not a skewed sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.stats import exact_avg

SCOPE_DAYS = 90
MIN_ROWS = 24


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def scoped(facts: DataFrame, as_of: Column, days: int = SCOPE_DAYS) -> DataFrame:
    """Rows of the trend scope: last ``days`` days with a non-null AQI."""
    return facts.filter((F.col("datetime") >= as_of - _days(days)) & F.col("india_aqi").isNotNull())


def period_averages(facts: DataFrame, as_of: Column, min_rows: int = MIN_ROWS) -> DataFrame:
    """TRD-1 + TRD-2: mean of the last 7 and 30 days (>= bound), of the
    prior 7 days (half-open), change and direction. Cities with fewer than
    ``min_rows`` rows in scope are left out."""
    t = F.col("datetime")
    last7 = t >= as_of - _days(7)
    prior7 = (t >= as_of - _days(14)) & (t < as_of - _days(7))
    last30 = t >= as_of - _days(30)
    agg = (scoped(facts, as_of).groupBy("city").agg(
        F.count("*").alias("n_rows"),
        F.round(exact_avg("india_aqi", 1, last7), 1).alias("avg_aqi_7d"),
        F.round(exact_avg("india_aqi", 1, last30), 1).alias("avg_aqi_30d"),
        exact_avg("india_aqi", 1, prior7).alias("prior_avg"))
        .filter(F.col("n_rows") >= min_rows))
    change = (F.col("avg_aqi_7d") - F.col("prior_avg")) / F.col("prior_avg") * 100
    has = (F.col("avg_aqi_7d").isNotNull() & (F.col("avg_aqi_7d") != 0)
           & F.col("prior_avg").isNotNull() & (F.col("prior_avg") > 0))
    return agg.select(
        "city", "n_rows", "avg_aqi_7d", "avg_aqi_30d",
        F.when(has, F.round(change, 1)).alias("change_7d_pct"),
        F.when(has & (change < -5), F.lit("improving"))
         .when(has & (change > 5), F.lit("worsening"))
         .otherwise(F.lit("stable")).alias("trend_direction"))


def _bucketed(facts: DataFrame, as_of: Column, kind: str) -> DataFrame:
    f = scoped(facts, as_of)
    if kind == "time_of_day":
        b = F.coalesce(F.col("time_of_day"), C.time_of_day(F.hour("datetime")))
    elif kind == "day_of_week":
        b = F.initcap(C.day_name("datetime"))
    elif kind == "season":
        f = f.filter(F.col("season").isNotNull())
        b = F.col("season")
    else:
        raise ValueError(kind)
    return f.withColumn("bucket", b)


def pattern(facts: DataFrame, as_of: Column, kind: str) -> DataFrame:
    """TRD-3/4/5: mean AQI per bucket (1 decimal) with worst/best flags;
    ties go to the alphabetically first bucket, comparing unrounded means."""
    means = (_bucketed(facts, as_of, kind).groupBy("city", "bucket")
             .agg(exact_avg("india_aqi", 1).alias("mean")))
    picks = means.groupBy("city").agg(
        F.min_by("bucket", F.struct(-F.col("mean"), F.col("bucket"))).alias("worst"),
        F.min_by("bucket", F.struct(F.col("mean"), F.col("bucket"))).alias("best"))
    return means.join(picks, "city").select(
        "city", "bucket", F.round("mean", 1).alias("avg_aqi"),
        (F.col("bucket") == F.col("worst")).alias("is_worst"),
        (F.col("bucket") == F.col("best")).alias("is_best"))


#: Kinds of ``patterns``, as ``pattern`` names them.
KINDS = ("time_of_day", "day_of_week", "season")


def patterns(facts: DataFrame, as_of: Column) -> DataFrame:
    """TRD-3 to TRD-5 in one pass over the facts by grouping sets: ``pattern`` of
    every kind, with its ``kind``."""
    f = scoped(facts, as_of).withColumns({
        "time_of_day": F.coalesce(F.col("time_of_day"), C.time_of_day(F.hour("datetime"))),
        "day_of_week": F.initcap(C.day_name("datetime"))})
    means = (f.groupingSets([["city", k] for k in KINDS], "city", *KINDS)
             .agg(exact_avg("india_aqi", 1).alias("mean"), *[F.grouping(k).alias("_not_" + k) for k in KINDS]))
    kind = F.coalesce(*[F.when(F.col("_not_" + k) == 0, F.lit(k)) for k in KINDS])
    means = means.select("city", kind.alias("kind"), F.coalesce(*KINDS).alias("bucket"), "mean").filter("bucket is not null")
    picks = means.groupBy("city", "kind").agg(
        F.min_by("bucket", F.struct(-F.col("mean"), F.col("bucket"))).alias("worst"),
        F.min_by("bucket", F.struct(F.col("mean"), F.col("bucket"))).alias("best"))
    return means.join(picks, ["city", "kind"]).select(
        "city", "kind", "bucket", F.round("mean", 1).alias("avg_aqi"),
        (F.col("bucket") == F.col("worst")).alias("is_worst"), (F.col("bucket") == F.col("best")).alias("is_best"))


def pattern_maps(facts: DataFrame, as_of: Column, kind: str) -> DataFrame:
    """TRD-7: {bucket: mean (1 decimal)} per city, keys sorted."""
    p = pattern(facts, as_of, kind)
    entries = F.array_sort(F.collect_list(F.struct("bucket", "avg_aqi")))
    return p.groupBy("city").agg(F.map_from_entries(entries).alias("averages"))


def _pct_text(c: Column) -> Column:
    """Python's ``format(x, '.0f')``: ties to even."""
    return F.bround(c, 0).cast("long").cast("string")


def trend_narrative(facts: DataFrame, as_of: Column) -> DataFrame:
    """TRD-6: one sentence per city. Without a prior week the stable
    sentence is used (the original request failed there)."""
    per = period_averages(facts, as_of)
    tod = pattern(facts, as_of, "time_of_day").groupBy("city").agg(
        F.max_by("bucket", F.col("is_worst").cast("int")).alias("worst_tod"),
        F.max_by("bucket", F.col("is_best").cast("int")).alias("best_tod"))
    sea = pattern(facts, as_of, "season").filter("is_worst").select(
        "city", F.col("bucket").alias("worst_season"))
    d = per.join(tod, "city").join(sea, "city", "left")
    pct = _pct_text(F.abs(F.col("change_7d_pct")))
    sentence = (F.when(F.col("trend_direction") == "improving",
                       F.concat(F.lit("Air quality has improved by "), pct, F.lit("% over the last 7 days.")))
                .when(F.col("trend_direction") == "worsening",
                      F.concat(F.lit("Air quality has worsened by "), pct, F.lit("% over the last 7 days.")))
                .otherwise(F.lit("Air quality has been relatively stable over the last 7 days.")))
    text = F.concat(
        F.initcap("city"), F.lit(" — "), sentence,
        F.lit(" Avoid outdoor activity during "), F.regexp_replace("worst_tod", "_", " "),
        F.lit(" hours. Air is cleanest during "), F.regexp_replace("best_tod", "_", " "),
        F.lit(". Worst season historically: "),
        F.regexp_replace(F.coalesce(F.col("worst_season"), F.lit("unknown")), "_", " "), F.lit("."))
    return d.select("city", "trend_direction", text.alias("narrative"))
