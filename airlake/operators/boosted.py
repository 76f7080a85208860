"""Boosted regression trees (MOD-2, MOD-4, MOD-5) and their contributions (EXP-1).

One ensemble of Spark's gradient-boosted trees is fitted on the rows of all
cities. A city's level is a feature of its own, the mean of its training rows:
regression trees order a categorical by that mean anyway, and a number stays
one column whatever the number of cities. Spark builds every level of a tree
from partial histograms, so a city that holds a third of the rows is no group
of its own; the hold-out rows stop the boosting (``validationIndicatorCol``).

The fitted ensemble is stored in the shared folder, and its nodes are read back
as a table (``nodes``). Contributions are computed from the nodes on the tasks
that hold the rows to explain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import checkpoint_dir
from .features import FEATURE_LABELS, complete
from .models import evaluate

MODEL_VERSION = "boosted_v1"
CITY_LEVEL = "city_level"
NODES = ("tree int, node int, feature int, threshold double, left int, right int, value double, cover double, weight double")


@dataclass
class Boosted:
    """A fitted ensemble: ``levels`` has one row per trained city (key,
    city_level, train_rows)."""

    model: GBTRegressionModel
    features: list[str]
    levels: DataFrame
    key: str

    @property
    def columns(self) -> list[str]:
        """Model inputs in order."""
        return [*self.features, CITY_LEVEL]


def city_levels(train: DataFrame, target: str, key: str, min_rows: int) -> DataFrame:
    """Mean target and rows of the training part of every city that has
    ``min_rows``; the others get no model."""
    g = train.groupBy(key).agg(F.avg(F.col(target).cast("double")).alias(CITY_LEVEL), F.count(F.lit(1)).alias("train_rows"))
    return g.filter(F.col("train_rows") >= min_rows)


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    doubles = df.withColumns({f"_x_{i}": F.col(c).cast("double") for i, c in enumerate(columns)})
    made = VectorAssembler(inputCols=[f"_x_{i}" for i in range(len(columns))], outputCol="_x", handleInvalid="keep").transform(doubles)
    return made.drop(*[f"_x_{i}" for i in range(len(columns))])


def fit_boosted(split: DataFrame, features: list[str], target: str = "india_aqi", key: str = "city",
                min_rows: int = K.MIN_TRAIN_ROWS, rounds: int = K.BOOST_ROUNDS, depth: int = K.BOOST_DEPTH,
                rate: float = K.BOOST_RATE, least_gain: float = 0.0, seed: int = K.BOOST_SEED) -> Boosted | None:
    """MOD-2: fits on the rows of ``split`` (MOD-1: with ``is_test``) whose
    target and features are all present.

    Boosting ends after ``rounds`` trees, or as soon as a further tree improves
    the hold-out's squared error by less than ``least_gain`` of it; the trees up
    to the best stay. Cities with fewer than ``min_rows`` training rows are
    skipped; None when that leaves no rows.
    """
    rows = complete(split, [target, *features])
    levels = city_levels(rows.filter(~F.col("is_test")), target, key, min_rows)
    rows = _assembled(rows.join(levels, key), [*features, CITY_LEVEL])
    rows = rows.select("_x", F.col(target).cast("double").alias("_y"), F.col("is_test").alias("_held"))
    if rows.filter(~F.col("_held")).isEmpty():
        return None
    held = not rows.filter("_held").isEmpty()
    stop = {"validationIndicatorCol": "_held", "validationTol": least_gain} if held else {}
    booster = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=rate,
                           subsamplingRate=K.BOOST_SUBSAMPLE, featureSubsetStrategy=str(K.BOOST_COLUMNS),
                           minInstancesPerNode=K.BOOST_LEAF_ROWS, minInfoGain=K.BOOST_SPLIT_GAIN, seed=seed, **stop)
    checkpoint_dir(split.sparkSession)
    return Boosted(booster.fit(rows), list(features), levels, key)


def predict_boosted(df: DataFrame, fitted: Boosted, out: str = "prediction", clip: bool = True) -> DataFrame:
    """Rows of the trained cities with their prediction, clipped to 0..500;
    NULL where a feature is missing."""
    j = df.join(fitted.levels.select(fitted.key, CITY_LEVEL), fitted.key)
    whole = F.lit(True)
    for c in fitted.columns:
        whole = whole & F.col(c).isNotNull()
    p = fitted.model.setFeaturesCol("_x").setPredictionCol("_p").transform(_assembled(j, fitted.columns))
    y = F.greatest(F.lit(K.FORECAST_CLIP_MIN), F.least(F.lit(K.FORECAST_CLIP_MAX), F.col("_p"))) if clip else F.col("_p")
    return p.withColumn(out, F.when(whole, y)).drop("_x", "_p", CITY_LEVEL)


def boosted_metrics(split: DataFrame, fitted: Boosted, target: str = "india_aqi") -> DataFrame:
    """MOD-4 and MOD-5: per trained city the hold-out's MAE and RMSE (2
    decimals), train and test rows, trees and the model's version."""
    test = complete(split.filter("is_test"), [target, *fitted.features])
    ev = evaluate(predict_boosted(test, fitted), target, key=fitted.key)
    return (fitted.levels.select(fitted.key, "train_rows").join(ev, fitted.key, "left")
            .withColumns({"trees": F.lit(fitted.model.getNumTrees), "model_version": F.lit(MODEL_VERSION)}))


# -- the nodes as a table ------------------------------------------------------

def store_model(fitted: Boosted, path: str) -> None:
    fitted.model.write().overwrite().save(path)


def nodes(spark, path: str) -> DataFrame:
    """The nodes of a stored ensemble: leaves have feature -1; ``cover`` is the
    training rows that reach a node, ``weight`` the tree's factor."""
    n = spark.read.parquet(path.rstrip("/") + "/data")
    weights = spark.read.parquet(path.rstrip("/") + "/treesMetadata").toDF("tree", "_about", "weight").drop("_about")
    d = F.col("nodeData")
    inner = d["leftChild"] >= 0
    flat = n.select(F.col("treeID").alias("tree"), d["id"].alias("node"),
                    F.when(inner, d["split"]["featureIndex"]).otherwise(-1).alias("feature"),
                    F.when(inner, d["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
                    d["leftChild"].alias("left"), d["rightChild"].alias("right"), d["prediction"].alias("value"),
                    d["impurityStats"][0].alias("cover"))
    return flat.join(weights, "tree").select(*[c.split()[0] for c in NODES.split(", ")])


def leaves_of(rows: list[tuple]) -> list[tuple[float, list[int], list[tuple[float, float]], np.ndarray]]:
    """Per leaf of an ensemble: value (weighted), the features on its path, the
    interval (low, high] that each must lie in, and the share of training rows
    that each one's splits let pass. ``rows`` are those of ``nodes``."""
    at = {(r[0], r[1]): r for r in rows}
    out = []
    for tree in sorted({r[0] for r in rows}):
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            _, _, feature, threshold, left, right, value, cover, weight = at[tree, node]
            if feature < 0:
                fs = sorted(path)
                out.append((value * weight, fs, [path[f][:2] for f in fs], np.array([path[f][2] for f in fs])))
                continue
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, piece in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                todo.append((child, path | {feature: (*piece, share * at[tree, child][7] / cover)}))
    return out


def attribute(leaves: list[tuple], x: np.ndarray) -> tuple[float, np.ndarray]:
    """Base value and contributions (rows x features) by path-dependent Shapley
    values: with the features of a subset known, a split on any other one lets
    its share of the training rows pass.

    A leaf's value is then a product of one factor per feature on its path: 1
    or 0 for a known feature, its share for an unknown one. A feature's Shapley
    value is its own (factor - share) times a weighted sum over subsets of the
    others, which are the coefficients of the product of (share + factor t)."""
    base, out = 0.0, np.zeros(x.shape)
    for value, fs, pieces, share in leaves:
        base += value * float(share.prod())
        m = len(fs)
        if not m:
            continue
        known = np.stack([((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high) in zip(fs, pieces)])
        # k known ones of the m - 1 others: k! (m - 1 - k)! / m!
        weight = np.ones(m) / m
        for k in range(1, m):
            weight[k] = weight[k - 1] * k / (m - k)
        for i, f in enumerate(fs):
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for n, j in enumerate(j for j in range(m) if j != i):
                grown = poly[:n + 2] * share[j]
                grown[1:] += poly[:n + 1] * known[j]
                poly[:n + 2] = grown
            out[:, f] += value * (known[i] - share[i]) * (weight @ poly)
    return base, out


def tree_contributions(rows: DataFrame, fitted: Boosted, node_table: DataFrame, key: str = "city", ts: str = "datetime") -> DataFrame:
    """EXP-1: of each trained city's newest row with all features, one row per
    feature: feature_value and shap_value (3 decimals), direction, label, the
    base value and the predicted AQI (1 decimal), and ``exact_value``, unrounded.
    Base plus contributions is the unclipped prediction.

    The node table is bounded by the ensemble's trees and depth, not by the data."""
    whole = complete(rows, fitted.features)
    newest = whole.groupBy(key).agg(F.max_by(F.struct(*fitted.features), ts).alias("_row"), F.max(ts).alias(ts))
    j = newest.select(key, ts, "_row.*").join(fitted.levels.select(key, CITY_LEVEL), key)
    columns = fitted.columns
    leaves = leaves_of([tuple(r) for r in node_table.collect()])
    inputs = j.select(key, ts, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    schema = inputs.select(key, ts).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_numpy())
            base, phi = attribute(leaves, x)
            yield pd.DataFrame({key: b[key], ts: b[ts], "base": base, "x": list(x), "phi": list(phi)})

    made = inputs.mapInPandas(run, f"{schema}, base double, x array<double>, phi array<double>")
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    named = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                               F.lit(FEATURE_LABELS.get(c, "City level" if c == CITY_LEVEL else c)).alias("label"))
                      for i, c in enumerate(columns)])
    long = made.withColumns({"predicted": total, "about": named}).select(
        key, ts, "base", "predicted", F.explode(F.arrays_zip("about", "x", "phi")).alias("c"))
    phi = F.col("c.phi")
    return long.select(key, ts, "c.about.position", "c.about.feature", "c.about.label",
                       F.round("c.x", 3).alias("feature_value"), F.round(phi, 3).alias("shap_value"),
                       F.when(phi > 0, "increases_aqi").otherwise("decreases_aqi").alias("direction"),
                       F.round("base", 1).alias("base_value"), F.round("predicted", 1).alias("predicted_aqi"),
                       phi.alias("exact_value"), F.col("base").alias("exact_base"))
