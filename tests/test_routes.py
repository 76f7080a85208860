"""Route operators against brute force on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from airlake.operators import routes as RT


def _similar(a, b, tol=0.08):
    return abs(a[0] - b[0]) / max(a[0], 1.0) < tol and abs(a[1] - b[1]) / max(a[1], 1.0) < tol


def _greedy(cands, cap=5):
    kept = []
    for idx, d, t in cands:
        if len(kept) >= cap:
            break
        if not any(_similar((d, t), (kd, kt)) for _, kd, kt in kept):
            kept.append((idx, d, t))
    return [k[0] for k in kept]


@pytest.fixture(scope="module")
def routes(spark):
    rnd = random.Random(7)
    rows = []
    for req in range(40):
        for idx in range(rnd.randint(1, 12)):
            base = 10000.0 + rnd.choice([0, 0, 300, 900, 4000])
            rows.append((req, idx, base * (1 + rnd.uniform(-0.1, 0.1)), base / 10 * (1 + rnd.uniform(-0.1, 0.1))))
    return spark.createDataFrame(rows, "request_id long, route_idx int, distance_m double, duration_s double"), rows


def test_dedupe_matches_greedy(spark, routes):
    df, rows = routes
    got = {(r.request_id, r.route_idx) for r in RT.dedupe_routes(df).collect()}
    want = set()
    for req in {r[0] for r in rows}:
        cands = sorted([(r[1], r[2], r[3]) for r in rows if r[0] == req])
        want |= {(req, i) for i in _greedy(cands)}
    assert got == want


def test_similar_pairs_match_brute_force(spark, routes):
    df, rows = routes
    got = {(r.request_id, r.a_idx, r.b_idx) for r in RT.similar_pairs(df).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows
            if a[0] == b[0] and a[1] != b[1] and _similar((a[2], a[3]), (b[2], b[3]))}
    assert got == want


def _km(la1, lo1, la2, lo2):
    p1, p2 = math.radians(la1), math.radians(la2)
    a = (math.sin(math.radians(la2 - la1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lo2 - lo1) / 2) ** 2)
    return 2 * 6371 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@pytest.mark.parametrize("n,spread", [(0, 1.0), (1, 1.0), (10, 1.0), (300, 1.0), (3000, 1.0), (300, 0.02)])
@pytest.mark.parametrize("bound", [0, 200_000])
def test_nearest_is_brute_force_at_every_size(spark, monkeypatch, n, spread, bound):
    """One strategy for every candidate count, broadcast or shuffled, with
    missing coordinates, candidates at one place and points across the globe."""
    monkeypatch.setattr(RT, "BROADCAST_CANDIDATES", bound)
    rnd = random.Random(n)
    cands = [(i, rnd.uniform(-90, 90) * spread, rnd.uniform(-180, 180) * spread, float(i)) for i in range(n)]
    cands += [(n + i, c[1], c[2], -1.0) for i, c in enumerate(cands[:5])]
    nulls = [(10**6, None, 75.0, 1.0), (10**6 + 1, 20.0, None, 1.0)]
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)]
    pts += [(100 + i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(40)]
    lost = [(1000, None, 1.0), (1001, 1.0, None), (1002, 95.0, 1.0)]
    cdf = spark.createDataFrame(cands + nulls, "city_id long, latitude double, longitude double, aqi double")
    pdf = spark.createDataFrame(pts + lost, "pid long, lat double, lon double")
    got = {r.pid: (r.nearest_id, r.nearest_value) for r in RT.nearest(pdf, ["pid"], cdf, value="aqi").collect()}
    best = {i: min(((_km(la, lo, c[1], c[2]), c[0], c[3]) for c in cands), default=(0, None, None)) for i, la, lo in pts}
    assert got == {i: b[1:] for i, b in best.items()} | {i: (None, None) for i, _, _ in lost}


def test_classify_first_wins_ties(spark):
    df = spark.createDataFrame([(1, 0, 100.0, 50.0), (1, 1, 100.0, 40.0), (1, 2, 200.0, 40.0)],
                               "request_id long, route_idx int, duration_s double, avg_aqi double")
    got = {r.route_type: r.route_idx for r in RT.classify_routes(df).collect()}
    assert got == {"fastest": 0, "clean": 1, "balanced": 1}


def test_route_exposure_empty_city_table_gives_zero(spark):
    g = spark.createDataFrame([(1, 0, [(10.0, 75.0), (11.0, 76.0)])],
                              "request_id long, route_idx int, geometry array<struct<lat:double,lon:double>>")
    cities = spark.createDataFrame([], "city_id long, latitude double, longitude double, aqi double")
    assert RT.route_exposure(g, cities).first()["avg_aqi_raw"] == 0.0


def test_map_polyline_keeps_last_point(spark):
    pts = [(float(i), 0.0) for i in range(450)]
    g = spark.createDataFrame([(1, pts)], "request_id long, geometry array<struct<lat:double,lon:double>>")
    m = RT.map_polyline(g).first()["map_waypoints"]
    assert m[0]["lat"] == 0.0 and m[-1]["lat"] == 449.0 and len(m) == 225 + 1
    assert F is not None


def test_geometry_path_equals_point_path(spark, sf):
    from airlake.plans import q_routes as Q
    from airlake.sources import fixtures as X
    ca = Q.city_aqi(spark, sf)
    a = {(r.request_id, r.route_idx): r.avg_aqi_raw
         for r in RT.route_exposure(X.route_geometry(spark, sf), ca).collect()}
    b = {(r.request_id, r.route_idx): r.avg_aqi_raw
         for r in RT.exposure_from_points(X.route_sample_points(spark, sf), ca).collect()}
    assert a == b and len(a) > 1000


def _pool(rows, cap=5, cap_via=3):
    """The pool rule row by row for one request: (idx, d, t, kind) in order."""
    vias = [r for r in rows if r[3] == "via"]
    natural = [r for r in rows if r[3] == "natural"]
    if vias:
        pool = [vias[0]]
        for r in natural:
            if len(pool) < cap_via and not _similar(r[1:3], vias[0][1:3]):
                pool.append(r)
        return {r[0] for r in pool}
    pool = list(natural)
    if len(pool) < 3:
        for r in rows:
            if r[3] == "synthetic" and len(pool) < cap and not any(_similar(r[1:3], k[1:3]) for k in pool):
                pool.append(r)
    return {r[0] for r in pool}


@pytest.mark.parametrize("fold", [64, 3])
def test_route_pool_matches_rule(spark, monkeypatch, fold):
    monkeypatch.setattr(RT, "FOLD_CANDIDATES", fold)
    rnd = random.Random(11)
    rows = []
    for req in range(120):
        mode = req % 4
        for idx in range(rnd.randint(1, 14)):
            base = 10000.0 + rnd.choice([0, 0, 300, 900, 4000])
            kind = "via" if mode == 0 and idx in (0, 5) else "natural" if rnd.random() < (0.5, 0.15, 0.4, 0)[mode] else "synthetic"
            rows.append((req, idx, base * (1 + rnd.uniform(-0.1, 0.1)), base / 10 * (1 + rnd.uniform(-0.1, 0.1)), kind))
    df = spark.createDataFrame(rows, "request_id long, route_idx int, distance_m double, duration_s double, kind string")
    got = {(r.request_id, r.route_idx) for r in RT.route_pool(df).collect()}
    want = {(q, i) for q in range(120) for i in _pool([r[1:] for r in rows if r[0] == q])}
    assert got == want


def test_route_pool_empty(spark):
    df = spark.createDataFrame([], "request_id long, route_idx int, distance_m double, duration_s double, kind string")
    assert RT.route_pool(df).count() == 0


def test_city_sensors(spark):
    from airlake.operators.merge import city_sensors
    cities = spark.createDataFrame([("a", 10.0, 70.0), ("far", 40.0, 100.0), ("odd", 20.0, 80.0)], "name string, latitude double, longitude double")
    locations = spark.createDataFrame([
        (7, "near", 10.1, 70.0, [(1, "pm2.5"), (2, "PM10"), (3, "PM2.5"), (4, "humidity")]),
        (5, "nearer, no place", None, None, [(9, "no2")]), (8, "too far", 10.4, 70.0, [(5, "no2")]),
        (6, "nothing wanted", 20.0, 80.1, [(6, "humidity")]), (9, "no list", 20.0, 80.2, None)],
        "loc_id long, loc_name string, latitude double, longitude double, sensors array<struct<id:long,parameter:string>>")
    got = [tuple(r) for r in city_sensors(cities, locations).collect()]
    assert got == [("a", 7, "near", 11.1, {"pm2_5_ugm3": 3, "pm10_ugm3": 2})]


def test_rank_has_no_single_task_window(spark):
    from airlake.operators import serving as S
    rnd = random.Random(3)
    rows = [(f"c{i:04d}", rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "city string, india_aqi double")
    for order in ("desc", "asc"):
        got = S.rankings(df, order)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        ranks = {r.city: r["rank"] for r in got.collect()}
        head = {"desc": lambda v: (v is not None, -(v or 0)), "asc": lambda v: (v is None, v or 0)}[order]
        want = sorted(rows, key=lambda r: (*head(r[1]), r[0]))
        assert ranks == {c: i + 1 for i, (c, _) in enumerate(want)}
