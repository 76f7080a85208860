"""Serving queries (QRY-*), set-wise: every city at once.

Skew note: "latest row per station" is computed with a partial
``groupBy(station).max(datetime)`` (map-side combine, so a station holding
a third of all rows is reduced before the shuffle) and an equi-join back
on (station, datetime). The per-station table has one row per station and
is joined under Spark's size-checked broadcast threshold; no window
partitioned by station is used, so no single task ever sorts a hot
station's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stats import exact_avg
from ..session import cut_lineage

CURRENT_COLUMNS = ["city", "state", "latitude", "longitude", "datetime", "india_aqi",
                   "india_aqi_category", "us_aqi", "pm2_5_ugm3", "pm10_ugm3", "no2_ugm3",
                   "so2_ugm3", "co_ugm3", "o3_ugm3", "temperature_c", "wind_speed_kmh",
                   "humidity_percent", "season", "time_of_day"]


def list_cities(cities: DataFrame) -> DataFrame:
    """QRY-1: active cities (the sink orders by name)."""
    return cities.filter(F.col("is_active")).select(
        F.col("city_id").alias("id"), "name", "state", "latitude", "longitude")


def latest_rows(facts: DataFrame, key: str = "station_id", ts: str = "datetime") -> DataFrame:
    """Rows at the newest timestamp of each key; ties are all kept."""
    newest = facts.groupBy(F.col(key).alias("_key")).agg(F.max(ts).alias("_max_ts"))
    cond = (F.col(key) == F.col("_key")) & (F.col(ts) == F.col("_max_ts"))
    return facts.join(newest, cond, "left_semi")


def latest_per_city(facts: DataFrame) -> DataFrame:
    """QRY-2: newest fact row of every station, with city attributes."""
    return latest_rows(facts).select("city_id", *CURRENT_COLUMNS)


def rank_order(aqi: str = "india_aqi", order: str = "desc") -> list[Column]:
    """PostgreSQL order: NULL first when descending, last when ascending;
    city name breaks ties so ranks are deterministic."""
    c = F.col(aqi)
    primary = c.desc_nulls_first() if order == "desc" else c.asc_nulls_last()
    return [primary, F.col("city").asc()]


def rankings(latest: DataFrame, order: str = "desc") -> DataFrame:
    """QRY-3: rank = position in the ordered latest set.

    The rows are range-partitioned by the order and sorted within partitions;
    a row's rank is its place in its partition plus the rows of the partitions
    before, so no task sees all rows. Only the partitions' row counts meet.
    """
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    by = rank_order("india_aqi", order)
    placed = latest.repartitionByRange(*by).sortWithinPartitions(*by)
    # the low 33 bits number the rows of a partition; written once, as sampling the ranges anew could move their bounds
    placed = cut_lineage(placed.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_part", "n"))).scalar()
    part = F.col("_part")
    before = F.aggregate(F.filter("_sizes", lambda s: s["_part"] < part), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return (placed.withColumn("_sizes", sizes).withColumn("rank", (before + F.col("_nth") + 1).cast("int"))
            .drop("_part", "_nth", "_sizes"))


def dataset_stats(facts: DataFrame, cities: DataFrame) -> DataFrame:
    """QRY-4: one row; average AQI rounded to 1 decimal, NULL when 0/none."""
    avg = exact_avg("india_aqi", 1)
    stats = facts.agg(F.count("*").alias("total_records"),
                      F.min("datetime").alias("date_from"),
                      F.max("datetime").alias("date_to"),
                      avg.alias("_avg"))
    n_cities = cities.agg(F.count("*")).scalar()
    return stats.select("total_records", n_cities.alias("cities"), "date_from", "date_to",
                        F.when(F.col("_avg") != 0, F.round("_avg", 1)).alias("avg_india_aqi"))


def category_distribution(facts: DataFrame, category: str = "india_aqi_category") -> DataFrame:
    """QRY-5: rows per non-null category."""
    return (facts.filter(F.col(category).isNotNull())
            .groupBy(F.col(category).alias("category")).agg(F.count("*").alias("rows")))


def city_current(facts: DataFrame, city_name: str | None = None) -> DataFrame:
    """QRY-6: newest row of a city, matched case-insensitively. Without a
    name, the newest row of every city (one per city, no ties)."""
    f = facts if city_name is None else facts.filter(F.lower("city") == city_name.lower())
    row = F.struct(*[F.col(c) for c in CURRENT_COLUMNS if c != "city"])
    return (f.groupBy("city").agg(F.max_by(row, F.col("datetime")).alias("r"))
            .select("city", "r.*"))


def city_history(facts: DataFrame, as_of: Column, days: int = 7,
                 city_name: str | None = None) -> DataFrame:
    """QRY-7: rows with datetime >= as_of - days (1..90), with the per-city
    row count. ``as_of`` is explicit, never the wall clock."""
    if not 1 <= days <= 90:
        raise ValueError("days must be within 1..90")
    f = facts if city_name is None else facts.filter(F.lower("city") == city_name.lower())
    f = f.filter(F.col("datetime") >= as_of - F.make_dt_interval(F.lit(days)))
    counts = f.groupBy("city").agg(F.count("*").alias("count"))
    return f.join(counts, "city").select("city", "datetime", "india_aqi", "india_aqi_category",
                                         "pm2_5_ugm3", "pm10_ugm3", "count")


def latest_nonnull_aqi(facts: DataFrame, key: str = "city_id") -> DataFrame:
    """QRY-8: newest non-null AQI per key (partial aggregate, skew-safe)."""
    return (facts.filter(F.col("india_aqi").isNotNull())
            .groupBy(key).agg(F.max_by("india_aqi", "datetime").alias("aqi"),
                              F.max("datetime").alias("aqi_at")))


def daily_mean_chart(facts: DataFrame) -> DataFrame:
    """QRY-9: per city and calendar day, mean AQI rounded half up to an
    integer (nulls skipped, days without a value absent); with the chart's
    min, max and axis max = max(200, ceil(max/50)*50 + 50) per city."""
    daily = (facts.filter(F.col("india_aqi").isNotNull())
             .groupBy("city", F.to_date("datetime").alias("day"))
             .agg(F.floor(exact_avg("india_aqi", 1) + 0.5).cast("long").alias("aqi")))
    bounds = daily.groupBy("city").agg(F.min("aqi").alias("chart_min"),
                                       F.max("aqi").alias("chart_max"))
    bounds = bounds.withColumn(
        "axis_max", F.greatest(F.lit(K.CHART_AXIS_FLOOR).cast("long"),
                               F.ceil(F.col("chart_max") / 50) * 50 + 50))
    return daily.join(bounds, "city")


def best_worst_city(ranked: DataFrame) -> DataFrame:
    """QRY-10: worst = rank 1 of the descending ranking; best = lowest AQI
    with NULL counted as 0, earliest rank first on ties."""
    best_key = F.struct(F.coalesce(F.col("india_aqi"), F.lit(0.0)), F.col("rank"))
    return ranked.agg(
        F.min_by("city", best_key).alias("best_city"),
        F.min_by("india_aqi", best_key).alias("best_aqi"),
        F.min_by("city", F.col("rank")).alias("worst_city"),
        F.min_by("india_aqi", F.col("rank")).alias("worst_aqi"))


def search_cities(ranked: DataFrame, text: str, limit: int = K.SEARCH_SUGGESTIONS) -> DataFrame:
    """QRY-11: substring match on city or state, first ``limit`` in
    ranking order (the limit is the feature: a suggestion list)."""
    t = text.lower()
    hit = F.lower("city").contains(t) | F.lower("state").contains(t)
    return ranked.filter(hit).orderBy("rank").limit(limit).select("rank", "city", "state", "india_aqi")


def advisory_table(spark) -> DataFrame:
    rows = [(i, None if hi is None else float(hi), rng, cat, who, sens, prec)
            for i, (hi, rng, cat, who, sens, prec) in enumerate(K.AQI_ADVISORY)]
    return spark.createDataFrame(
        rows, "band int, upper double, range string, category string, who string, "
              "sensitive string, precautions array<string>")


def advisory_band(aqi) -> Column:
    """Index of the advisory band; NULL for 0 or NULL (no advisory)."""
    a = F.col(aqi) if isinstance(aqi, str) else aqi
    expr = F.when(a.isNull() | (a == 0), F.lit(None).cast("int"))
    for i, (hi, *_rest) in enumerate(K.AQI_ADVISORY):
        if hi is not None:
            expr = expr.when(a <= hi, F.lit(i))
    return expr.otherwise(F.lit(len(K.AQI_ADVISORY) - 1))


def advisory_for(df: DataFrame, aqi: str = "india_aqi") -> DataFrame:
    """QRY-12: band lookup as an equi-join on a computed band index against
    the six-row advisory table (a literal of fixed size)."""
    adv = advisory_table(df.sparkSession).drop("upper")
    return df.withColumn("band", advisory_band(aqi)).join(F.broadcast(adv), "band", "left")
