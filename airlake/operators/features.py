"""Model features (FEA-*).

Lags and rolling statistics are row windows over one station's (or
city's) hourly series, sharing one ``Window`` spec so Spark sorts once.
The hourly fact table holds at most one row per (station, hour), so one
key's series is bounded by the hours in the covered period (about 8,800 a
year), whatever the table size: a per-key window never holds more than
that, and keys spread over all tasks.

Rolling sums use DECIMAL on the 1-decimal AQI, so means and the sample
standard deviation (from exact n, sum and sum of squares) do not depend
on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import constants as K

# FIXED VALUES - full (v2) feature list, in model order
FEATURE_COLS = [
    "hour", "day_of_week", "month", "day_of_year", "week_of_year", "is_weekend", "season_enc",
    "lag_24h", "lag_48h", "lag_72h", "lag_168h", "lag_336h",
    "rolling_24h_mean", "rolling_3d_mean", "rolling_7d_mean", "rolling_14d_mean",
    "rolling_7d_std", "rolling_3d_std",
    "temperature_c", "wind_speed_kmh", "humidity_percent", "pressure_msl_hpa", "wind_gusts_kmh",
    "precipitation_mm", "is_raining", "festival_period", "crop_burning_season",
]
# FIXED VALUES - compact (v1) feature list and the labels shown for it
FEATURE_COLS_V1 = ["hour", "day_of_week", "month", "is_weekend", "lag_24h", "lag_48h", "lag_168h",
                   "rolling_24h_mean", "rolling_7d_mean", "rolling_7d_std", "temperature_c", "wind_speed_kmh"]
FEATURE_LABELS = {
    "hour": "Hour of day", "day_of_week": "Day of week", "month": "Month", "is_weekend": "Weekend effect",
    "lag_24h": "AQI 24 h ago", "lag_48h": "AQI 48 h ago", "lag_168h": "AQI 7 days ago",
    "rolling_24h_mean": "24-hour rolling average", "rolling_7d_mean": "7-day rolling average",
    "rolling_7d_std": "AQI variability (7-day std)", "temperature_c": "Temperature (°C)",
    "wind_speed_kmh": "Wind speed (km/h)",
}
ROLLING_NAMES = {24: "rolling_24h", 72: "rolling_3d", 168: "rolling_7d", 336: "rolling_14d"}
TARGET = "india_aqi"


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL in any of ``columns``. One condition per column, as a
    condition over all of them (``dropna``) has the optimizer try every
    combination of columns and their later aliases."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def series_window(key: str = "city", ts: str = "datetime"):
    return W.partitionBy(key).orderBy(ts)


def hourly_series(facts: DataFrame, key: str = "city", ts: str = "datetime", target: str = TARGET) -> DataFrame:
    """Model input: one row per hour of each city's period: hours without a row, and NULL
    targets, take the last known values. A city's series is bounded by the
    hours of the period."""
    span = facts.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    spine = span.select(key, F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 1 HOUR"))).alias(ts))
    w = W.partitionBy(key).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    j = spine.join(facts, [key, ts], "left")
    return j.select(key, ts, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in facts.columns if c not in (key, ts)]
                    ).filter(F.col(target).isNotNull())


def time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """FEA-1: hour, weekday (Mon=0), month, day of year, ISO week,
    weekend 0/1, season code."""
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t),
        "day_of_year": F.dayofyear(t), "week_of_year": F.weekofyear(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"), "season_enc": C.season_code(F.month(t)),
    })


def lags(df: DataFrame, lag_hours=tuple(K.LAG_HOURS), key: str = "city", ts: str = "datetime",
         target: str = TARGET) -> DataFrame:
    """FEA-2: row shifts per key (not time shifts: gaps shift the meaning)."""
    w = series_window(key, ts)
    return df.withColumns({f"lag_{n}h": F.lag(target, n).over(w) for n in lag_hours})


def _rolling(value: Column, n: int, key: str, ts: str) -> Column:
    """Sum over the previous n rows, as the difference of two running sums:
    both frames only grow, so a series takes linear time whatever n is. The
    values must add up exactly (counts, decimals)."""
    w = series_window(key, ts)
    until = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -n - 1))
    return until - F.coalesce(before, F.lit(0))


def rolling_mean(target: str, n: int, min_n: int, key: str, ts: str, scale: int = 1) -> Column:
    """Mean of the previous n rows (current row excluded); NULL when fewer
    than ``min_n`` non-null values."""
    x = F.coalesce(F.col(target).cast(f"decimal(18,{scale})"), F.lit(0).cast(f"decimal(18,{scale})"))
    cnt = _rolling(F.col(target).isNotNull().cast("long"), n, key, ts)
    s = _rolling(x, n, key, ts).cast("double")
    return F.when(cnt >= min_n, s / cnt)


def rolling_std(target: str, n: int, min_n: int, key: str, ts: str, scale: int = 1) -> Column:
    """Sample standard deviation over the same frame, from exact sums."""
    x = F.coalesce(F.col(target).cast(f"decimal(18,{scale})"), F.lit(0).cast(f"decimal(18,{scale})"))
    cnt = _rolling(F.col(target).isNotNull().cast("long"), n, key, ts)
    s = _rolling(x, n, key, ts).cast(f"decimal(28,{scale})")
    ss = _rolling(x * x, n, key, ts).cast(f"decimal(38,{2 * scale})")
    var = (cnt * ss - s * s).cast("double") / (cnt * (cnt - 1))
    return F.when((cnt >= min_n) & (cnt > 1), F.sqrt(var))


def rollings(df: DataFrame, means=tuple(K.ROLLING_MEAN_WINDOWS), stds=tuple(K.ROLLING_STD_WINDOWS),
             key: str = "city", ts: str = "datetime", target: str = TARGET) -> DataFrame:
    """FEA-3 + FEA-4."""
    cols = {f"{ROLLING_NAMES[n]}_mean": rolling_mean(target, n, m, key, ts) for n, m in means}
    cols.update({f"{ROLLING_NAMES[n]}_std": rolling_std(target, n, m, key, ts) for n, m in stds})
    return df.withColumns(cols)


def fill_weather(df: DataFrame, defaults: dict = K.WEATHER_DEFAULTS, key: str = "city",
                 ts: str = "datetime") -> DataFrame:
    """FEA-5: forward then backward fill per key, then the default; an
    absent column becomes the default."""
    back = series_window(key, ts).rowsBetween(W.unboundedPreceding, 0)
    # read backwards, so that this frame grows by one row as well and is not summed up anew for each row
    fwd = W.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, 0)
    cols = {}
    for c, d in defaults.items():
        if c in df.columns:
            cols[c] = F.coalesce(F.last(c, True).over(back), F.last(c, True).over(fwd), F.lit(float(d)))
        else:
            cols[c] = F.lit(float(d))
    return df.withColumns(cols)


def bool_features(df: DataFrame, month: str = "month") -> DataFrame:
    """FEA-6: booleans as 0/1, NULL as 0; absent context flags from the
    month proxy (Oct, Nov)."""
    cols = {"is_raining": (F.coalesce(F.col("is_raining").cast("int"), F.lit(0))
                           if "is_raining" in df.columns else F.lit(0))}
    for c in ("festival_period", "crop_burning_season"):
        cols[c] = (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in df.columns
                   else C.festival_proxy(F.col(month)).cast("int"))
    return df.withColumns(cols)


def feature_frame(df: DataFrame, key: str = "city", ts: str = "datetime") -> DataFrame:
    """FEA-1..7 (v2): all 27 features; rows with any feature or the target
    missing are dropped."""
    f = df.filter(F.col(TARGET).isNotNull())
    f = time_features(f, ts).transform(lags, tuple(K.LAG_HOURS), key, ts).transform(
        rollings, tuple(K.ROLLING_MEAN_WINDOWS), tuple(K.ROLLING_STD_WINDOWS), key, ts)
    f = fill_weather(f, K.WEATHER_DEFAULTS, key, ts).transform(bool_features)
    return complete(f, FEATURE_COLS + [TARGET])


def feature_frame_v1(df: DataFrame, key: str = "city", ts: str = "datetime",
                     min_24: int = 12, min_168: int = 72) -> DataFrame:
    """FEA-8 (and FEA-9 with min counts 8/24): the 12-feature set; weather
    filled forward/backward, then 0.0."""
    f = df.filter(F.col(TARGET).isNotNull())
    f = time_features(f, ts).transform(lags, (24, 48, 168), key, ts)
    f = f.withColumns({
        "rolling_24h_mean": rolling_mean(TARGET, 24, min_24, key, ts),
        "rolling_7d_mean": rolling_mean(TARGET, 168, min_168, key, ts),
        "rolling_7d_std": rolling_std(TARGET, 168, min_168, key, ts),
    })
    f = fill_weather(f, {"temperature_c": 0.0, "wind_speed_kmh": 0.0}, key, ts)
    return complete(f, FEATURE_COLS_V1 + [TARGET])


def last_rows(df: DataFrame, n: int, key: str = "city", ts: str = "datetime") -> DataFrame:
    """The newest ``n`` rows of each key (bounded per key by ``n``)."""
    w = W.partitionBy(key).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def feature_frame_explain(df: DataFrame, key: str = "city", ts: str = "datetime") -> DataFrame:
    """FEA-9: v1 features on the newest 200 non-null rows (weather default
    20 / 5 when missing), min counts 8 and 24."""
    f = last_rows(df.filter(F.col(TARGET).isNotNull()), 200, key, ts)
    f = f.withColumns({"temperature_c": F.coalesce("temperature_c", F.lit(20.0)),
                       "wind_speed_kmh": F.coalesce("wind_speed_kmh", F.lit(5.0))})
    return feature_frame_v1(f, key, ts, 8, 24)


def forecast_input(df: DataFrame, days: int = 14, key: str = "city", ts: str = "datetime") -> DataFrame:
    """FEA-10: rows of the last ``days`` days from each key's own newest
    time, with a non-null AQI; weather defaults only on NULL."""
    newest = df.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_max"))
    f = (df.join(newest, F.col(key) == F.col("_k"))
         .filter((F.col(ts) >= F.col("_max") - F.make_dt_interval(F.lit(days))) & F.col(TARGET).isNotNull())
         .drop("_k", "_max"))
    return f.withColumns({c: F.coalesce(F.col(c), F.lit(float(d))) if c in f.columns else F.lit(float(d))
                          for c, d in K.WEATHER_DEFAULTS.items()})


TOLERANCE_ORDER = [(0, 0), (1, -1), (2, 1), (3, -2), (4, 2)]  # (priority, hour offset)


def tolerant_lag(targets: DataFrame, history: DataFrame, hours: int, key: str = "city",
                 ts: str = "target_dt", hist_ts: str = "datetime", value: str = TARGET) -> DataFrame:
    """FEA-11: value at target - hours, else at -1h, +1h, -2h, +2h around
    it in that order, else the key's mean. An equi-join on five candidate
    timestamps (no range join)."""
    lag_ts = F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))
    cand = targets.select(key, ts, F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), (lag_ts + F.make_dt_interval(F.lit(0), F.lit(o))).alias("t"))
        for p, o in TOLERANCE_ORDER])).alias("c")).select(key, ts, "c.p", F.col("c.t").alias("_ct"))
    h = history.select(F.col(key).alias("_hk"), F.col(hist_ts).alias("_ht"), F.col(value).alias("_v"))
    hit = (cand.join(h, (F.col(key) == F.col("_hk")) & (F.col("_ct") == F.col("_ht")))
           .groupBy(key, ts).agg(F.min_by("_v", "p").alias("_hit")))
    means = history.groupBy(F.col(key).alias("_mk")).agg(F.avg(value).alias("_mean"))
    out = (targets.join(hit, [key, ts], "left").join(means, F.col(key) == F.col("_mk"), "left")
           .withColumn(f"lag_{hours}h", F.coalesce("_hit", "_mean")).drop("_hit", "_mk", "_mean"))
    return out


def dedupe_history(df: DataFrame, key: str = "city", ts: str = "datetime", seq: str = "seq") -> DataFrame:
    """FEA-12: one row per (key, time); the last arrival (highest ``seq``)
    wins. A partial aggregate, so repeated keys combine map-side."""
    others = [c for c in df.columns if c not in (key, ts)]
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(key, ts).agg(F.max_by(row, F.col(seq)).alias("_r")).select(key, ts, "_r.*")


def last_known_weather(df: DataFrame, key: str = "city", ts: str = "datetime",
                       defaults: dict = K.WEATHER_DEFAULTS) -> DataFrame:
    """FEA-13: newest non-null value of each weather column per key
    (default when the key never had one)."""
    aggs = []
    for c, d in defaults.items():
        if c in df.columns:
            aggs.append(F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))),
                                   F.lit(float(d))).alias(c))
        else:
            aggs.append(F.lit(float(d)).alias(c))
    return df.groupBy(key).agg(*aggs)


def daily_target(df: DataFrame, min_days: int = 60, key: str = "city", ts: str = "datetime") -> DataFrame:
    """FEA-14: mean AQI per date (NULLs dropped); keys with fewer than
    ``min_days`` days are left out."""
    from ..functions.stats import exact_avg
    d = (df.filter(F.col(TARGET).isNotNull()).groupBy(key, F.to_date(ts).alias("ds"))
         .agg(exact_avg(TARGET, 1).alias("y")))
    n = d.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return d.join(n, F.col(key) == F.col("_k")).filter(F.col("_n") >= min_days).drop("_k", "_n")
