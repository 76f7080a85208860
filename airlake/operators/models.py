"""Per-city linear models (MOD-*) fitted from distributed sufficient statistics.

A linear (ridge) model needs only n, sum(x), sum(x x^T), sum(x y) and
sum(y^2) per city. Each task multiplies its batches and adds up what it has of
a city, so a city holding a third of all rows is summed where its rows are, and
the small per-city systems (k x k, k = number of features) are then solved with
numpy over one row per city. No task ever holds a city's raw rows.

Boosted trees, the original's hourly model, are in ``boosted``. The ridge model
on the same features serves the recursive forecast, and the daily model is a
ridge regression on trend + Fourier seasonality. Metrics (MAE, RMSE) are
computed the same way for all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K

MODEL_VERSION = "ridge_v1"


def time_split(df: DataFrame, test_days: int = K.TEST_DAYS, key: str = "city",
               ts: str = "datetime") -> DataFrame:
    """MOD-1: per key, train = up to max - test_days (inclusive), test after."""
    newest = df.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_max"))
    j = df.join(newest, F.col(key) == F.col("_k"))
    split = F.col("_max") - F.make_dt_interval(F.lit(test_days))
    return j.withColumn("is_test", F.col(ts) > split).drop("_k", "_max")


#: Keys whose sums a task holds before it passes them on.
KEYS_HELD = 1_000


def gram(df: DataFrame, features: list[str], target: str, key: str) -> DataFrame:
    """key, i, v: per key the products of (1, features, target) with each other,
    summed over its rows without NULLs; ``i`` counts along the upper triangle.

    Each task multiplies whole Arrow batches and adds up what it has of a key;
    only these sums are shuffled, as one row per key, product and task."""
    k = len(features) + 2
    up = np.triu_indices(k)
    rows = df.select(key, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                     F.col(target).cast("double").alias("y"))
    key_type = df.schema[key].dataType.simpleString()

    def products(batches):
        held: dict = {}

        def flushed():
            got = pd.DataFrame({key: list(held), "g": [g[up] for g in held.values()]})
            held.clear()
            return got

        for b in batches:
            for value, part in b.dropna().groupby(key, sort=False):
                z = np.column_stack([np.ones(len(part)), part.drop(columns=key).to_numpy(np.float64)])
                held[value] = held.get(value, 0.0) + z.T @ z
                if len(held) >= KEYS_HELD:
                    yield flushed()
        if held:
            yield flushed()

    parts = rows.mapInPandas(products, f"`{key}` {key_type}, g array<double>")
    return parts.select(key, F.posexplode("g").alias("i", "v")).groupBy(key, "i").agg(F.sum("v").alias("v"))


def fit_ridge(df: DataFrame, features: list[str], target: str, key: str = "city",
              l2: float = 1e-3, min_rows: int = K.MIN_TRAIN_ROWS) -> DataFrame:
    """MOD-2 (ridge form): per key coefficients; keys with fewer than
    ``min_rows`` rows are skipped. Returns key, n, intercept, coef_<f>, mean_<f>."""
    k = len(features)
    up = np.triu_indices(k + 2)
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("n", T.LongType()),
                           T.StructField("intercept", T.DoubleType())]
                          + [T.StructField(f"coef_{f}", T.DoubleType()) for f in features]
                          + [T.StructField(f"mean_{f}", T.DoubleType()) for f in features])

    def solve(name: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((k + 2, k + 2))
        full[up] = sums.sort_values("i")["v"].to_numpy()
        full += np.triu(full, 1).T
        n = full[0, 0]
        if n < min_rows:
            return pd.DataFrame(columns=[s.name for s in schema])
        mean = full[0] / n
        mx, my = mean[1:-1], mean[-1]
        cov = full[1:-1, 1:-1] / n - np.outer(mx, mx)
        cxy = full[1:-1, -1] / n - mx * my
        # what is left of a constant column's variance is rounding: its coefficient is 0
        flat = np.diag(cov) <= 1e-10 * np.maximum(np.diag(full)[1:-1] / n, 1e-12)
        cov[flat, :] = cov[:, flat] = cxy[flat] = 0.0
        scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, np.diag(cov))))
        beta = np.linalg.solve(cov / np.outer(scale, scale) + l2 * np.eye(k), cxy / scale) / scale
        row = [name[0], int(n), float(my - beta @ mx), *beta.tolist(), *mx.tolist()]
        return pd.DataFrame([row], columns=[s.name for s in schema])

    # one group is the products of one key: their number follows the features alone
    return gram(df, features, target, key).groupBy(key).applyInPandas(solve, schema)


def predict(df: DataFrame, model: DataFrame, features: list[str], key: str = "city",
            out: str = "prediction", clip: bool = True) -> DataFrame:
    """Linear prediction as a plain column expression (codegen); the model
    has one row per key. Clipped to 0..500 like the original."""
    j = df.join(model.select(key, "intercept", *[f"coef_{f}" for f in features]), key)
    p = F.col("intercept")
    for f in features:
        p = p + F.col(f"coef_{f}") * F.col(f).cast("double")
    if clip:
        p = F.when(p.isNotNull(), F.greatest(F.lit(K.FORECAST_CLIP_MIN), F.least(F.lit(K.FORECAST_CLIP_MAX), p)))
    return j.withColumn(out, p).drop("intercept", *[f"coef_{f}" for f in features])


def evaluate(pred: DataFrame, target: str = "india_aqi", prediction: str = "prediction",
             key: str = "city", test_col: str | None = "is_test") -> DataFrame:
    """MOD-4: MAE and RMSE per key on test rows, 2 decimals."""
    p = pred.filter(F.col(test_col)) if test_col else pred
    err = F.col(prediction) - F.col(target)
    return p.groupBy(key).agg(F.round(F.avg(F.abs(err)), 2).alias("mae"),
                              F.round(F.sqrt(F.avg(err * err)), 2).alias("rmse"),
                              F.count("*").alias("test_rows"))


def train_and_evaluate(features_df: DataFrame, features: list[str], key: str = "city",
                       version: str = MODEL_VERSION, trained_at: Column | None = None):
    """MOD-1 + 2 + 4 + 5: split, fit on train, score test; returns (model,
    metrics) where metrics has one row per trained key."""
    s = time_split(features_df, K.TEST_DAYS, key)
    model = fit_ridge(s.filter(~F.col("is_test")), features, "india_aqi", key)
    ev = evaluate(predict(s.filter("is_test"), model, features, key), key=key)
    train_rows = s.filter(~F.col("is_test")).groupBy(key).agg(F.count("*").alias("train_rows"))
    metrics = (model.select(key).join(ev, key, "left").join(train_rows, key, "left")
               .withColumn("model_version", F.lit(version)))
    if trained_at is not None:
        metrics = metrics.withColumn("trained_at", trained_at)
    return model, metrics


def cities_to_train(metrics: DataFrame, cities: DataFrame, version: str = MODEL_VERSION,
                    key: str = "city") -> DataFrame:
    """MOD-6: keys without a model of the current version."""
    done = metrics.filter(F.col("model_version") == version).select(key)
    return cities.join(done, key, "left_anti")


# -- daily trend model (MOD-3) ---------------------------------------------------

def trend_features(ds: Column, origin: str = "2000-01-01", yearly: int = 3, weekly: int = 2) -> dict:
    """Trend (days since origin) and Fourier terms of yearly and weekly
    seasonality."""
    t = F.datediff(ds, F.lit(origin).cast("date")).cast("double")
    cols = {"trend_t": t}
    for k in range(1, yearly + 1):
        cols[f"yr_sin{k}"] = F.sin(t * (2 * math.pi * k / 365.25))
        cols[f"yr_cos{k}"] = F.cos(t * (2 * math.pi * k / 365.25))
    for k in range(1, weekly + 1):
        cols[f"wk_sin{k}"] = F.sin(t * (2 * math.pi * k / 7))
        cols[f"wk_cos{k}"] = F.cos(t * (2 * math.pi * k / 7))
    return cols


TREND_FEATURES = (["trend_t"] + [f"yr_{fn}{k}" for k in range(1, 4) for fn in ("sin", "cos")]
                  + [f"wk_{fn}{k}" for k in range(1, 3) for fn in ("sin", "cos")])
Z80 = 1.2815515655446004


def train_daily_trend(daily: DataFrame, key: str = "city", test_days: int = K.TEST_DAYS,
                      min_rows: int = 14) -> tuple[DataFrame, DataFrame]:
    """MOD-3: daily target (FEA-14: key, ds, y) fitted on trend + yearly +
    weekly terms with a 30-day hold-out; the interval half-width is the
    80 % normal quantile x residual std on the training days."""
    d = daily.withColumns(trend_features(F.col("ds")))
    newest = d.groupBy(F.col(key).alias("_k")).agg(F.max("ds").alias("_max"))
    d = d.join(newest, F.col(key) == F.col("_k")).withColumn(
        "is_test", F.col("ds") > F.date_sub("_max", test_days)).drop("_k", "_max")
    model = fit_ridge(d.filter(~F.col("is_test")), TREND_FEATURES, "y", key, 1e-3, min_rows)
    pred = predict(d, model, TREND_FEATURES, key, "yhat", clip=False)
    resid = pred.filter(~F.col("is_test")).groupBy(key).agg(
        F.stddev_samp(F.col("y") - F.col("yhat")).alias("resid_std"))
    ev = evaluate(pred.withColumnRenamed("y", "india_aqi"), prediction="yhat", key=key)
    return model.join(resid, key, "left"), ev


def predict_daily_trend(model: DataFrame, days: DataFrame, key: str = "city") -> DataFrame:
    """Daily trend forecast with an 80 % interval for (key, ds) rows."""
    d = days.withColumns(trend_features(F.col("ds")))
    p = predict(d, model.drop("resid_std"), TREND_FEATURES, key, "yhat", clip=False)
    p = p.join(model.select(key, "resid_std"), key, "left")
    half = F.coalesce(F.col("resid_std"), F.lit(0.0)) * Z80
    return p.select(key, "ds", "yhat", (F.col("yhat") - half).alias("yhat_lower"),
                    (F.col("yhat") + half).alias("yhat_upper"))
