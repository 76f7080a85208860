"""Boosted trees, their contributions, and linear rolling windows."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.operators import boosted as BO
from airlake.operators import features as FE
from airlake.operators import models as MD


@pytest.fixture(scope="module")
def split(spark):
    """Two long cities, one with too few rows, and NULLs here and there."""
    n = spark.range(1400).select(
        F.when(F.col("id") < 700, "a").when(F.col("id") < 1300, "b").otherwise("short").alias("city"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int),0,0)").alias("datetime"),
        (F.rand(1) * 10).alias("x0"), F.when(F.col("id") % 97 != 0, F.floor(F.rand(2) * 5)).alias("x1"), (F.rand(3) * 3).alias("x2"))
    y = F.col("x0") * 12 + F.when(F.col("x1") > 2, 80).otherwise(0) + F.when(F.col("city") == "a", 100).otherwise(0)
    return n.withColumns({"india_aqi": y, "is_test": F.hour("datetime") % 5 == 0}).cache()


XS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def fitted(split):
    return BO.fit_boosted(split, XS, min_rows=200, rounds=25, depth=3, rate=0.3)


def test_boosted_skips_short_cities_and_learns(split, fitted):
    assert {r["city"] for r in fitted.levels.collect()} == {"a", "b"}
    m = {r["city"]: r for r in BO.boosted_metrics(split, fitted).collect()}
    assert set(m) == {"a", "b"} and all(r["mae"] < 12 and r["rmse"] >= r["mae"] and 0 < r["trees"] <= 25 for r in m.values())
    assert BO.fit_boosted(split, XS, min_rows=10_000, rounds=2, depth=2) is None


def test_boosting_stops_on_the_hold_out(split):
    noise = split.withColumn("india_aqi", F.rand(11) * 100)
    assert BO.fit_boosted(noise, XS, min_rows=200, rounds=40, depth=5, rate=0.5, least_gain=0.01).model.getNumTrees < 40


def test_boosted_prediction_is_clipped_and_null_without_features(split, fitted):
    p = BO.predict_boosted(split, fitted)
    assert p.filter("prediction < 0 or prediction > 500").isEmpty()
    assert p.filter("(x1 is null) != (prediction is null)").isEmpty()
    assert p.select("city").distinct().count() == 2


def shapley_by_subsets(rows, x, n_features):
    """Shapley values by walking the trees once per subset of known features."""
    at = {(r[0], r[1]): r for r in rows}

    def value(tree, node, known):
        _, _, f, threshold, left, right, v, cover, w = at[tree, node]
        if f < 0:
            return v * w
        if f in known:
            return value(tree, left if x[f] <= threshold else right, known)
        return sum(value(tree, c, known) * at[tree, c][7] / cover for c in (left, right))

    def whole(known):
        return sum(value(t, 0, known) for t in {r[0] for r in rows})

    out = np.zeros(n_features)
    fact = [1, 1, 2, 6, 24, 120]
    for i in range(n_features):
        others = [j for j in range(n_features) if j != i]
        for k in range(n_features):
            for s in itertools.combinations(others, k):
                out[i] += fact[k] * fact[n_features - 1 - k] / fact[n_features] * (whole({*s, i}) - whole({*s}))
    return whole(set()), out


def test_contributions_equal_subset_enumeration_and_add_up(spark, split, fitted, tmp_path):
    BO.store_model(fitted, str(tmp_path / "m"))
    table = BO.nodes(spark, str(tmp_path / "m"))
    rows = [tuple(r) for r in table.collect()]
    leaves = BO.leaves_of(rows)
    x = np.random.default_rng(3).uniform(0, 1, (6, 4)) * [10, 5, 3, 150]
    base, phi = BO.attribute(leaves, x)
    for i in range(len(x)):
        want_base, want = shapley_by_subsets(rows, x[i], 4)
        assert base == pytest.approx(want_base) and phi[i] == pytest.approx(want, abs=1e-9)
    c = BO.tree_contributions(split, fitted, table)
    total = {r["city"]: r for r in c.groupBy("city", "datetime").agg(
        (F.sum("exact_value") + F.first("exact_base")).alias("t"), F.count("*").alias("n")).collect()}
    p = {(r["city"], r["datetime"]): r["prediction"] for r in BO.predict_boosted(split, fitted, clip=False).collect()}
    assert set(total) == {"a", "b"} and all(r["n"] == 4 and r["t"] == pytest.approx(p[r["city"], r["datetime"]]) for r in total.values())


def test_ridge_from_batch_products(split):
    m = {r["city"]: r for r in MD.fit_ridge(split, XS, "india_aqi", "city", 0.0, 200).collect()}
    d = split.toPandas().dropna()
    for city in ("a", "b"):
        part = d[d.city == city]
        z = np.column_stack([np.ones(len(part)), part[XS].to_numpy(float)])
        want = np.linalg.lstsq(z, part.india_aqi.to_numpy(float), rcond=None)[0]
        assert [m[city]["intercept"], *(m[city][f"coef_{f}"] for f in XS)] == pytest.approx(want, rel=1e-6)
        assert m[city]["n"] == len(part)


def test_rolling_windows_take_linear_time(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit("c").alias("city"), F.expr(
            "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int),0,0)").alias("datetime"),
            F.round(F.rand(5) * 300, 1).alias("india_aqi"))
        t = time.time()
        FE.rollings(df).write.format("noop").mode("overwrite").save()
        return time.time() - t

    seconds(1_000)
    small, large = min(seconds(10_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large <= 4 * small + 1


def test_hourly_series_fills_gaps(spark):
    f = spark.createDataFrame([("a", "2024-01-01 00:00", 10.0, 1.0), ("a", "2024-01-01 03:00", None, 2.0), ("a", "2024-01-01 04:00", 7.0, None),
                               ("b", "2024-01-01 00:00", None, 5.0)], "city string, t string, india_aqi double, wind double")
    f = f.select("city", F.col("t").cast("timestamp_ntz").alias("datetime"), "india_aqi", "wind")
    got = [(r["city"], r["datetime"].hour, r["india_aqi"], r["wind"]) for r in FE.hourly_series(f).orderBy("datetime").collect()]
    assert got == [("a", 0, 10.0, 1.0), ("a", 1, 10.0, 1.0), ("a", 2, 10.0, 1.0), ("a", 3, 10.0, 2.0), ("a", 4, 7.0, 2.0)]
