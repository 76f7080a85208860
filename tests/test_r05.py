"""Faults of the fourth review: plans that filled the driver, and steps that took too long on large tables."""

import random

from pyspark.sql import functions as F

from airlake.operators import routes as RT


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_the_nearest_are_not_copied_down(spark):
    """a join or filter on the nearest city went down through every step of its search, and the driver ran out of memory."""
    r = random.Random(8)
    cities = spark.createDataFrame([(i, 10 + r.random(), 75 + r.random()) for i in range(6)], "city_id int, latitude double, longitude double")
    points = spark.createDataFrame([(i, 10 + r.random(), 75 + r.random()) for i in range(50)] + [(50, None, 75.0)], "k int, lat double, lon double")
    near = RT.nearest(points, ["k"], cities)
    want = {x.k: x.nearest_id for x in near.collect()}
    some = near.filter("nearest_id > 2")
    assert not [x for x in _plan(some).splitlines() if "Filter" in x and "ATAN2" in x.upper()]
    assert {x.k for x in some.collect()} == {k for k, i in want.items() if i is not None and i > 2}
    names = spark.createDataFrame([(i, f"c{i}") for i in range(6)], "nearest_id long, name string")
    assert {x.k: x.name for x in near.join(names, "nearest_id").collect()} == {k: f"c{i}" for k, i in want.items() if i is not None}
    assert want[50] is None and len(want) == 51


def test_near_duplicates_broadcast_only_what_was_counted(spark, monkeypatch):
    """Spark took exploded buckets and shingles, and pairs in compressed files, for small, and the driver could not build them."""
    from airlake.llm import common
    from airlake.llm import near_dedup as ND
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [[r.choice(words) for _ in range(40)] for _ in range(30)]
    docs = []
    for i, t in enumerate(texts * 4):
        t = [*t]
        if i >= 30:
            t[r.randrange(40)] = "other"
        docs.append((i, " ".join(t)))
    d = spark.createDataFrame([*docs, (500, None), (501, ""), (502, docs[3][1]), (None, docs[3][1])], "doc_id long, text string")
    rows = lambda: sorted(map(str, ND.near_components(d, words_per_shingle=3, percent=85).collect()))
    want = rows()
    plans = {}

    def saved(df, name, store=ND.saved):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(ND, "saved", saved)
    monkeypatch.setattr(ND, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    assert rows() == want
    seen = [p for name in ("near-buckets", "near-prefixes", "near-candidates") for p in plans[name]]
    assert len(seen) > 4 and any("SortMergeJoin" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)
    assert any("kept=True" in x for x in want) and any("kept=False" in x for x in want)


def test_the_near_duplicate_stage_merges_what_is_not_small(spark, sf, monkeypatch):
    """the stage's own joins left the choice to Spark beyond the counted limit."""
    import corpus_pipeline as C
    from airlake.llm import common
    r = random.Random(10)
    text = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(30)) for _ in range(12)]
    once = [(i, text[i % 12] + (" more" if i > 11 else "")) for i in range(24)] + [(90, None), (91, "")]
    plans = []
    for docs in (once, [*once, *once, (None, text[0]), (7, "of its own text")]):
        d = spark.createDataFrame(docs, "doc_id long, text string")
        rows = lambda: sorted(map(str, C.near_duplicates(spark, d, sf).collect()))  # noqa: B023, E731
        with monkeypatch.context() as m:
            want = rows()
            m.setattr(C, "BROADCAST_KEYS", 0)
            m.setattr(common, "SMALL_ROWS", 0)
            assert rows() == want
            plans.append(C.near_duplicates(spark, d, sf)._jdf.queryExecution().executedPlan().toString())
        assert 12 <= len(want) < len(docs)
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_via_options_build_only_the_points_they_take(spark, sf):
    """whole geometries were built twice a route by interpreted code, and every column of a route went through the pool."""
    from airlake.functions import geo as G
    from airlake.plans import q_routes as Q
    rows = [(q, i, 10.0, 70.0, 20.0, 80.0, n) for q, ns in ((1, [1, 2, 50, 51]), (2, [99, 100, 101, 350, 7]), (3, [5, 5, 5]), (4, [4, 0, 9, None, 8]))
            for i, n in enumerate(ns)]
    d = spark.createDataFrame(rows, "request_id long, route_idx int, src_lat double, src_lon double, dst_lat double, dst_lon double, n int")
    rule = G.Path(F.col("n"), lambda i: F.col("src_lat") + i * 0.5, lambda i: F.col("src_lon") + i * F.col("route_idx"))
    stored = d.withColumn("geometry", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), rule.point))
                          .when(F.col("n") == 0, F.array().cast("array<struct<lat:double,lon:double>>")))
    cols = ["request_id", "route_idx", "via_lat", "via_lon", "label", "preview_waypoints"]
    by_rule = RT.via_options(d, rule).select(*cols)
    got = {(x.request_id, x.route_idx): x for x in by_rule.collect()}
    assert got == {(x.request_id, x.route_idx): x for x in RT.via_options(stored).select(*cols).collect()}
    assert set(got) == {(q, i) for q, i, *_, n in rows if q != 3 and n}
    for (q, i), x in got.items():
        n = next(r[-1] for r in rows if r[:2] == (q, i))
        pts = [(10.0 + k * 0.5, 70.0 + k * i) for k in range(n)]
        assert (x.via_lat, x.via_lon) == pts[n // 2] and [tuple(p) for p in x.preview_waypoints] == pts[::max(1, n // 50)]
    plan = _plan(Q.geo_via_options(spark, sf))
    assert plan.count("transform(sequence(") == 1 and "filter(transform(" not in plan and "planned_start" not in plan


def test_waypoints_are_built_and_coded_in_batches(spark, sf):
    """geometries were built point by point by interpreted code, written out as structs, and coded a byte in eight."""
    import numpy as np
    import pyarrow as pa
    from airlake.operators import polyline as PL
    from airlake.plans import q_routes as Q
    from airlake.sources import fixtures as X
    r = X.route_geometry(spark, sf).withColumn("by_rule", X.geometry_expr())
    assert r.filter("not (geometry <=> by_rule)").isEmpty() and not r.isEmpty()
    plan = _plan(Q.geo_waypoints(spark, sf))
    assert "transform(" not in plan and "_encode_udf(_geometries(" in plan
    rnd = random.Random(11)
    for size in (1.0, 90.0, 1e5, 4e12):
        lines = [None if k % 7 == 0 else [{"lat": rnd.uniform(-size, size), "lon": rnd.uniform(-size, size)} for _ in range(k % 5)] for k in range(40)]
        coded = PL._encode_batch(pa.array(lines, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))))
        assert coded.to_pylist() == [x if x is None else PL._encode(x) for x in lines]
        for some in (coded, coded.slice(3), coded.slice(40)):
            counts, lat, lon = PL._decode_batch(some)
            want = [PL._decode(x) if x else [] for x in some.to_pylist()]
            assert counts.tolist() == [len(x) for x in want]
            assert np.array_equal(np.stack([lat, lon], 1), np.array([p for x in want for p in x], float).reshape(-1, 2))


def test_candidates_are_made_where_their_users_are(spark, sf, monkeypatch):
    """one task made the candidates of all users, which were then shuffled; each value went to Python as an object, two of them timestamps."""
    from airlake.plans import q_streaming as QS
    from airlake.streaming import operators as ST

    def landed():
        paths.append(QS._land_candidates(spark, sf))
        return spark.read.parquet(paths[-1]).withColumn("file", F.input_file_name())

    paths = []
    new = landed()
    assert new.groupBy("user_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").isEmpty()
    monkeypatch.setattr(QS, "BROADCAST_HOURS", 0)
    old = landed()
    rows = lambda d: sorted(map(str, d.drop("file").collect()))
    assert rows(new) == rows(old) and new.select("file").distinct().count() > 1
    s = spark.readStream.schema(new.drop("file").schema).parquet(paths[0])
    sent = ST.stream_alerts_with_timers(s)._jdf.queryExecution().analyzed().toString()
    assert "unix_micros(_event_ts" in sent


def test_the_queries_load_without_a_session():
    """a column type given as text is parsed by a session, which a caller may not have yet."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=repo, check=True)


def test_anchors_of_a_pack_are_those_of_its_texts(monkeypatch):
    """op2 found the anchors text by text, mostly in overhead, and sent a frame for each bucket and shard of a pack."""
    import numpy as np
    from airlake.llm import suffix_dedup as SD
    r = random.Random(12)
    for chunk in (1 << 20, 256):
        monkeypatch.setattr(SD, "CHUNK", chunk)
        for _ in range(40):
            texts = [bytes(r.choice(b"ab c") for _ in range(r.choice([0, 49, 50, 51, 60, 200, 700]))) for _ in range(r.randint(0, 12))]
            got = sorted((d, h, p) for d, h, f, z in zip(*(x.tolist() for x in SD.pack_anchors(texts))) for p in range(f, z + 1))
            assert got == sorted((d, h, p) for d, x in enumerate(texts)
                                 for h, f, z in zip(*(y.tolist() for y in SD.anchors(np.frombuffer(x, np.uint8)))) for p in range(f, z + 1))
