"""Forecast explanations (EXP-*) for the linear model.

For a linear model the exact additive attribution of a prediction is
coef_i x (x_i - mean_i) over the training means, with the mean
prediction as base value - the quantity tree explainers approximate. It
is computed with an unpivot and column arithmetic, per city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import FEATURE_LABELS

TOP_K = 5


def contributions(rows: DataFrame, model: DataFrame, features: list[str], key: str = "city") -> DataFrame:
    """EXP-1: one row per (key, feature) of each key's newest feature row:
    value (3 decimals), contribution (3 decimals), direction, label, and
    the base value."""
    newest = rows.groupBy(key).agg(F.max("datetime").alias("_t"))
    last = rows.join(newest, (rows[key] == newest[key]) & (rows["datetime"] == newest["_t"]), "left_semi")
    j = last.join(model, key)
    base = F.col("intercept")
    for f in features:
        base = base + F.col(f"coef_{f}") * F.col(f"mean_{f}")
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                               F.lit(FEATURE_LABELS.get(f, f)).alias("label"),
                               F.col(f).cast("double").alias("value"),
                               (F.col(f"coef_{f}") * (F.col(f).cast("double") - F.col(f"mean_{f}")))
                               .alias("contribution")) for i, f in enumerate(features)])
    x = j.select(key, base.alias("base_value"), F.explode(items).alias("c")).select(key, "base_value", "c.*")
    return x.select(key, "position", "feature", "label", F.round("value", 3).alias("feature_value"),
                    F.round("contribution", 3).alias("shap_value"),
                    F.when(F.col("contribution") > 0, "increases_aqi").otherwise("decreases_aqi").alias("direction"),
                    "base_value")


def top_k_features(contrib: DataFrame, k: int = TOP_K, key: str = "city") -> DataFrame:
    """EXP-2: the k largest |contribution| per key (features per key are
    a fixed small number, so the window is bounded)."""
    w = W.partitionBy(key).orderBy(F.abs("shap_value").desc(), F.col("position"))
    return contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def driver_narrative(top: DataFrame, key: str = "city") -> DataFrame:
    """EXP-3: two strongest raising and lowering labels among the top k."""
    def labels(sign):
        cond = F.col("shap_value") > 0 if sign > 0 else F.col("shap_value") < 0
        arr = F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "label"))))
        return F.slice(F.transform(arr, lambda s: s["label"]), 1, 2)
    g = top.groupBy(key).agg(labels(1).alias("_pos"), labels(-1).alias("_neg"))

    def text(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("none"))
    return g.select(key, F.concat(F.lit("For "), F.initcap(key), F.lit(", the main factors driving AQI higher are: "),
                                  text(F.col("_pos")), F.lit(". Factors helping keep AQI lower: "),
                                  text(F.col("_neg")), F.lit(".")).alias("narrative"))
