"""Faults of the third review that were left: route steps that were interpreted, stored or joined to themselves."""

import random

from pyspark.sql import functions as F

from airlake.functions import geo as G
from airlake.operators import routes as RT


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_stage_is_compiled(spark, monkeypatch):
    """A fold in the stage kept Spark from compiling it, though it was never taken."""
    r = random.Random(4)
    places = [(i, r.uniform(10, 20), r.uniform(70, 80), float(i % 7)) for i in range(60)] + [(90, 15.0, 74.0, 1.0), (91, 15.0, 76.0, 2.0), (92, None, 76.0, 3.0)]
    pts = [(i, r.uniform(9, 21), r.uniform(69, 81)) for i in range(400)] + [(500, 15.0, 75.0), (501, None, 75.0), (502, 95.0, 75.0), (503, float("nan"), 75.0)]
    points = spark.createDataFrame(pts, "i int, lat double, lon double")
    default = RT.BOX_CELLS, RT.FLAT_CANDIDATES
    for n, tried in ((0, [default]), (12, [default]), (63, [default, (-1, 0)])):
        cands = spark.createDataFrame(places[len(places) - n:], "city_id int, latitude double, longitude double, v double")
        known = [F.struct(F.lit(p[0]).cast("long").alias("id"), F.lit(p[1]).alias("lat"), F.lit(p[2]).alias("lon"), F.lit(p[3]).alias("value"))
                 for p in places[len(places) - n:] if p[1] is not None]
        want = {x.i: None for x in points.collect()}
        if known:
            want |= {x.i: (x.b.id, x.b.dist, x.b.value) for x in points.filter("i < 501").select(
                "i", G._folded(F.array(*known), F.col("lat"), F.col("lon"), "double").alias("b")).collect()}
        for box, flat in tried:
            monkeypatch.setattr(RT, "BOX_CELLS", box)
            monkeypatch.setattr(RT, "FLAT_CANDIDATES", flat)
            near = RT.with_nearest(points, cands, value="v")
            rows = near.collect()
            assert {x.i: x._best and (x._best.id, x._best.dist, x._best.value) for x in rows} == want
            assert {x.i: x._value for x in rows} == {i: b and b[2] for i, b in want.items()}
            if n == 12:
                assert "aggregate(" not in _plan(near)


def test_choices_neither_store_nor_join_the_routes(spark):
    """The scored routes were written out and met themselves in two joins."""
    r = random.Random(6)
    rows = [(q, i, r.choice([60.0, 60.0, 90.0, 200.0]), r.choice([50.0, 50.0, 80.5, None])) for q in range(40) for i in range(q % 6 + 1)]
    rows += [(7, 0, 60.0, 50.0), (None, 0, 1.0, 1.0), (50, None, 1.0, 1.0), (50, 1, 2.0, 2.0), (51, 0, None, 3.0), (51, 1, 5.0, 1.0)]
    scored = spark.createDataFrame(rows, "request_id long, route_idx int, duration_s double, avg_aqi double")

    def by_joins(scored):
        t, a, idx = F.col("duration_s"), F.col("avg_aqi"), F.col("route_idx")
        st = scored.groupBy("request_id").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.min(a).alias("a0"), F.max(a).alias("a1"))
        j = scored.join(st, "request_id")
        bal = (F.lit(0.4) * F.when(F.col("t1") > F.col("t0"), (t - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
               + F.lit(0.6) * F.when(F.col("a1") > F.col("a0"), (a - F.col("a0")) / (F.col("a1") - F.col("a0"))).otherwise(0.0))
        p = j.withColumn("b", bal).groupBy("request_id").agg(
            F.min_by(idx, F.struct(t, idx)).alias("fastest"), F.min_by(idx, F.struct(a, idx)).alias("clean"),
            F.min_by(idx, F.struct("b", idx)).alias("balanced"), F.min_by(a, F.struct(t, idx)).alias("fastest_aqi"))
        p = p.unpivot(["request_id", "fastest_aqi"], ["fastest", "clean", "balanced"], "route_type", "route_idx")
        return p.join(scored, ["request_id", "route_idx"])

    got = RT.classify_routes(scored)
    cols = ["request_id", "route_idx", "route_type", "fastest_aqi", "duration_s", "avg_aqi"]
    assert got.columns == cols and "Join" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, by_joins(scored).select(cols).collect()))


def test_points_are_taken_by_position(spark, sf):
    """whole geometries were built by an interpreted expression for one point or every stride-th."""
    from airlake.plans import q_routes as Q
    d = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 2, 59, 60, 199, 200, 399, 400, 401, 599, 600, 1001])], "request_id long, n int").withColumn("route_idx", F.lit(0))
    lat, lon = (lambda i: F.col("n") + i * 0.5), (lambda i: F.col("request_id") - i * 0.25)
    rule = G.Path(F.col("n"), lat, lon)
    g = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), rule.point)).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    stored = d.withColumn("geometry", g)
    rows = lambda x: sorted(map(str, x.collect()))
    by_rule = RT.sample_waypoints(d, geometry=rule)
    assert rows(by_rule) == rows(RT.sample_waypoints(stored)) and "lambda" not in _plan(by_rule)
    old = stored.select("request_id", "route_idx", F.expr("greatest(1, n div 30)").alias("s"), F.posexplode("geometry").alias("pos", "p"))
    assert rows(by_rule) == rows(old.filter("pos % s = 0").select("request_id", "route_idx", "pos", "p.lat", "p.lon"))
    maps = {x.request_id: x.map_waypoints for x in RT.map_polyline(stored).collect()}
    assert maps == {x.request_id: x.map_waypoints for x in RT.map_polyline(d, rule).collect()}
    for x in stored.collect():
        pts, s = x.geometry, max(1, x.n // 200)
        assert maps[x.request_id] == [p for i, p in enumerate(pts) if i % s == 0 or i == x.n - 1]
    assert "transform(" not in _plan(Q.geo_sample_waypoints(spark, sf)) + _plan(Q.geo_nearest_city(spark, sf))


def test_saved_routes_are_scored_once(spark, sf, monkeypatch):
    """The newest start was found by classifying the routes a second time."""
    from airlake.plans import q_alerts as A
    from airlake.plans import q_routes as Q
    for df in (A.alr_upcoming_routes(spark, sf), Q.geo_route_history(spark, sf)):
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() >= 0


def test_points_carry_only_the_columns_asked_for(spark, sf):
    """Every column of a route was a key of the aggregate over its points, whatever the query needs."""
    from airlake.plans import q_routes as Q
    routes = Q.scored(spark, sf, "user_id")
    assert set(routes.columns) >= {"request_id", "route_idx", "user_id", "distance_km", "time_min", "avg_aqi"}
    by_points = [x for x in _plan(routes).splitlines() if "Aggregate [request_id" in x]
    assert by_points and not any(c in x for x in by_points for c in ("planned_start", "src_lat", "city_id"))
