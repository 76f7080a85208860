"""Personal exposure risk (RSK-*), for every user at once.

Users are joined to their home city's AQI with an equi-join on city id.
The per-city AQI table has one row per city and goes under Spark's
size-checked broadcast; the daily log join (users x days of their city)
is a plain equi-join that AQE's skew-join handling splits when one city
holds most users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import risk as R

PROFILE_FLAGS = ["respiratory_disease", "heart_disease", "diabetes", "kidney_disease", "is_smoker",
                 "is_pregnant"]


def exposure_risk(df: DataFrame, aqi: str = "aqi", hours: str = "exposure_hours",
                  activity: str = "activity_level", with_text: bool = False) -> DataFrame:
    """RSK-7: risk score = min(100, product of factors * 100), 1 decimal;
    factors rounded to 3 decimals; category; optionally advice and text."""
    base = R.base_score(aqi)
    age_m = R.age_multiplier("age")
    cond_m = R.condition_multiplier()
    act_m = R.activity_multiplier(activity)
    dur_m = R.duration_multiplier(hours)
    sens_m = R.sensitivity_multiplier(F.coalesce(F.col("sensitivity_level"), F.lit("moderate")))
    raw = base * age_m * cond_m * act_m * dur_m * sens_m
    out = df.withColumns({
        "risk_score": F.bround(F.least(F.lit(100.0), raw * 100), 1),
        "aqi_contribution": F.bround(base, 3),
        "age_contribution": F.bround(age_m, 3),
        "condition_contribution": F.bround(cond_m, 3),
        "activity_contribution": F.bround(act_m, 3),
        "duration_contribution": F.bround(dur_m, 3),
        "sensitivity_contribution": F.bround(sens_m, 3),
    }).withColumn("risk_category", R.risk_category("risk_score"))
    if with_text:
        out = out.withColumns({
            "recommendations": R.recommendations("risk_category"),
            "explanation": R.explanation("risk_score", "risk_category", aqi, "condition_contribution",
                                         "activity_contribution", "duration_contribution"),
        })
    return out


def factors_struct() -> Column:
    """The six factors as one struct (the stored JSON document)."""
    return F.struct(*[F.col(c) for c in R.FACTOR_NAMES])


def score_users(profiles: DataFrame, city_aqi: DataFrame, with_text: bool = False) -> DataFrame:
    """RSK-11: each profile scored with its home city's newest non-null
    AQI (``city_aqi``: city_id, aqi). Users whose city has no AQI drop out."""
    j = profiles.join(city_aqi.withColumnRenamed("city_id", "home_city_id"), "home_city_id")
    return exposure_risk(j, "aqi", "exposure_hours", "activity_level", with_text)


def city_snapshot(cities: DataFrame, city_aqi: DataFrame, age: int = 30, exposure_hours: float = 2.0,
                  activity_level: str = "light", respiratory: bool = False,
                  heart_disease: bool = False) -> DataFrame:
    """RSK-13: one reference profile scored in every active city with an
    AQI (the sink orders by score, descending)."""
    if not 1 <= age <= 100 or not 0 <= exposure_hours <= 24:
        raise ValueError("age must be 1..100 and exposure_hours 0..24")
    c = cities.filter("is_active").join(city_aqi, "city_id")
    prof = c.withColumns({
        "age": F.lit(age), "respiratory_disease": F.lit(respiratory), "heart_disease": F.lit(heart_disease),
        "diabetes": F.lit(False), "kidney_disease": F.lit(False), "is_smoker": F.lit(False),
        "is_pregnant": F.lit(False), "sensitivity_level": F.lit("moderate"),
        "exposure_hours": F.lit(float(exposure_hours)), "activity_level": F.lit(activity_level)})
    s = exposure_risk(prof, "aqi")
    return s.select(F.col("name").alias("city"), "state", "latitude", "longitude",
                    F.col("aqi").alias("current_aqi"), "risk_score", "risk_category")


def daily_risk_log(profiles: DataFrame, daily_aqi: DataFrame) -> DataFrame:
    """Risk log rows: each user scored once per day of their home city's
    daily AQI (``daily_aqi``: city_id, day, aqi)."""
    j = profiles.join(daily_aqi.withColumnRenamed("city_id", "home_city_id"), "home_city_id")
    s = exposure_risk(j, "aqi")
    return s.select("user_id", F.col("home_city_id").alias("city_id"),
                    F.col("day").cast("timestamp_ntz").alias("created_at"),
                    F.col("aqi").alias("aqi_used"), "risk_score", "risk_category", *R.FACTOR_NAMES)


def risk_history(logs: DataFrame, cities: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """RSK-14: logs of the last ``days`` days (>= bound), city name by left
    join, with the per-user count."""
    if not 1 <= days <= 365:
        raise ValueError("days must be within 1..365")
    recent = logs.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    counts = recent.groupBy("user_id").agg(F.count("*").alias("count"))
    names = cities.select("city_id", F.col("name").alias("city"))
    return (recent.join(names, "city_id", "left").join(counts, "user_id")
            .select("user_id", "created_at", "city", "aqi_used", "risk_score", "risk_category", "count"))


def factor_breakdown(scores: DataFrame) -> DataFrame:
    """RSK-15: factors as rows with impact vs 1.0 and dominance rank by
    |value - 1| (ties keep factor order). One user has six rows, so the
    per-user window is bounded."""
    pos = {n: i for i, n in enumerate(R.FACTOR_NAMES)}
    stack = F.explode(F.array(*[
        F.struct(F.lit(pos[n]).alias("position"), F.lit(n).alias("factor"),
                 F.lit(R.FACTOR_LABELS[pos[n]]).alias("label"), F.col(n).alias("value"))
        for n in R.FACTOR_NAMES]))
    rows = scores.select("user_id", "risk_score", "risk_category", stack.alias("f")).select(
        "user_id", "risk_score", "risk_category", "f.*")
    w = W.partitionBy("user_id").orderBy(F.abs(F.col("value") - 1.0).desc(), F.col("position"))
    return rows.withColumns({
        "impact": F.when(F.col("value") == 1.0, "neutral")
                   .when(F.col("value") > 1.0, "increases_risk").otherwise("decreases_risk"),
        "dominance_rank": F.row_number().over(w)})


def factor_narrative(breakdown: DataFrame) -> DataFrame:
    """RSK-15 text: names the top two dominant factors that differ from 1."""
    top = breakdown.filter((F.col("dominance_rank") <= 2) & (F.col("value") != 1.0))
    labels = (breakdown.select("user_id", "risk_score", "risk_category").distinct()
              .join(top.groupBy("user_id").agg(
                  F.array_sort(F.collect_list(F.struct("dominance_rank", "label"))).alias("l")),
                    "user_id", "left"))
    head = F.concat(F.lit("Your risk score of "), F.bround("risk_score", 0).cast("long").cast("string"),
                    F.lit("/100 ("), F.col("risk_category"), F.lit(") "))
    text = F.when(F.col("l").isNotNull(),
                  F.concat(head, F.lit("was most influenced by: "),
                           F.array_join(F.transform("l", lambda s: s["label"]), ", "), F.lit(".")))
    text = text.otherwise(F.concat(head, F.lit("is primarily driven by the current AQI level.")))
    return labels.select("user_id", text.alias("narrative"))
