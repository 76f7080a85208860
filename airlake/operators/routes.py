"""Route scoring (GEO-*), over a whole table of route requests at once.

Plan shape, for scale:

* Nearest city per waypoint: points and candidates meet on grid cells. The
  cells that hold points are refined in steps; each keeps only candidates
  that can be the nearest of some point in it, so one strategy is exact at
  every size and no point meets all candidates. Sampled points are exploded
  and averaged by a partial aggregate.
* Per-request choices (fastest / clean / balanced) are marked by windows over
  the request, so scored routes are neither stored nor joined to themselves.
  Dedupe and similarity use ``groupBy`` aggregates and equi-joins; similarity
  is a band join on log-distance buckets, so only near pairs
  are ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo as G
from ..functions.aqi import india_category
from ..functions.calendar import hours_between
from ..session import cut_lineage
from . import risk as RISK

#: Cell sizes in degrees, coarse to fine; each divides the one before.
GRID_DEGREES = (16.0, 2.0, 0.25)
#: Cell candidates (about 40 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_CANDIDATES = 200_000
#: Candidates of a cell up to which they are plain columns; more are an array.
FLAT_CANDIDATES = 6
#: Finest cells of the points' bounding box up to which all of them get candidates; beyond, those that hold points.
BOX_CELLS = 20_000
DEDUPE_POOL_CAP = 5
DEDUPE_POOL_CAP_WITH_VIA = 3


# -- nearest candidate -------------------------------------------------------

def _in_range(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90.0) & (F.abs(lon) <= 360.0)


def _cell(lat: Column, lon: Column, size: float) -> dict[str, Column]:
    ok = _in_range(lat, lon)
    return {"_y": F.when(ok, F.floor(lat / size)), "_x": F.when(ok, F.floor(lon / size))}


def _cell_key(y, x) -> Column:
    """A cell of at most +-360 degrees in one number, which a broadcast table finds faster than two."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    return y * (1 << 20) + x


def _nearer(pairs: DataFrame, size: float) -> DataFrame:
    """Drops (cell, candidate) pairs whose candidate is too far from the
    cell's centre to be the nearest of any point in it: a point lies within
    ``reach`` of the centre, so its nearest candidate lies at most
    2 * ``reach`` farther out than the candidate closest to the centre."""
    reach = 0.75 * size * math.pi / 180 * K.EARTH_RADIUS_KM  # half the diagonal is below 0.72 sizes
    d = pairs.withColumn("_d", G.haversine_km((F.col("_y") + 0.5) * size, (F.col("_x") + 0.5) * size,
                                              F.col("_c.lat"), F.col("_c.lon")))
    least = d.groupBy("_y", "_x").agg(F.min("_d").alias("_least"))
    return d.join(least, ["_y", "_x"]).filter(F.col("_d") <= F.col("_least") + 2 * reach).select("_y", "_x", "_c")


def _cells_with_points(points: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """Cells (_y, _x) that include all that hold points: those of the points'
    bounding box where it is small (four numbers of one aggregate without
    keys, no distinct over all points), else just the ones with points."""
    la, lo = F.col(lat), F.col(lon)
    ok = _in_range(la, lo)
    y0, y1, x0, x1 = points.agg(*[F.floor(f(F.when(ok, c)) / size) for c in (la, lo) for f in (F.min, F.max)]).first()
    wide = 0 if y0 is None else x1 - x0 + 1
    n = wide and wide * (y1 - y0 + 1)
    if n <= BOX_CELLS:
        i = F.col("id")
        return points.sparkSession.range(n).select((F.lit(y0) + F.floor(i / F.lit(wide or 1))).cast("long").alias("_y"),
                                                   (F.lit(x0) + i % F.lit(wide or 1)).cast("long").alias("_x"))
    at = _cell(la, lo, size)
    return cut_lineage(points.select(at["_y"].alias("_y"), at["_x"].alias("_x")).dropna().distinct())


def cell_candidates(points: DataFrame, cands: DataFrame, id_col: str, lat: str, lon: str,
                    value: str | None, point_lat: str, point_lon: str, value_type: str = "double") -> DataFrame:
    """Per finest cell that holds points (_y, _x), the array of candidates
    that can be nearest there. Of candidates at the same place the one with
    the smallest id counts; those without coordinates are left out."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    val = (F.col(value) if value else F.lit(None)).cast(value_type)
    c = (cands.filter(_in_range(la, lo)).groupBy(la.alias("lat"), lo.alias("lon"))
         .agg(F.min(F.struct(F.col(id_col).cast("long").alias("id"), val.alias("value"))).alias("m"))
         .select(F.struct("m.id", "lat", "lon", "m.value").alias("_c")))
    fine = GRID_DEGREES[-1]
    held = _cells_with_points(points, point_lat, point_lon, fine)
    top = GRID_DEGREES[0]
    rows, cols = math.ceil(90 / top), math.ceil(360 / top)
    pairs = (c.withColumn("_y", F.explode(F.sequence(F.lit(-rows).cast("long"), F.lit(rows).cast("long"))))
             .withColumn("_x", F.explode(F.sequence(F.lit(-cols).cast("long"), F.lit(cols).cast("long")))))
    for i, size in enumerate(GRID_DEGREES):
        k = size / fine
        cells = held.select(F.floor(F.col("_y") / k).alias("_y"), F.floor(F.col("_x") / k).alias("_x")).distinct()
        if i == 0:
            pairs = pairs.join(cells, ["_y", "_x"])
        else:
            up = GRID_DEGREES[i - 1] / size
            cells = cells.select("_y", "_x", F.floor(F.col("_y") / up).alias("_py"),
                                 F.floor(F.col("_x") / up).alias("_px"))
            pairs = (pairs.select(F.col("_y").alias("_py"), F.col("_x").alias("_px"), "_c")
                     .join(cells, ["_py", "_px"]).select("_y", "_x", "_c"))
        pairs = _nearer(pairs, size)
    return pairs.groupBy("_y", "_x").agg(F.collect_list("_c").alias("_cands"))


def with_nearest(points: DataFrame, cands: DataFrame, id_col: str = "city_id", lat: str = "latitude",
                 lon: str = "longitude", value: str | None = None, point_lat: str = "lat",
                 point_lon: str = "lon", value_type: str = "double") -> DataFrame:
    """``points`` with ``_best`` = struct(dist, id, value) of the nearest
    candidate (ties: smaller id) and ``_value``, its value without the distance; NULL for points without coordinates or
    outside latitude +-90 and longitude +-360, and without candidates."""
    cells = cut_lineage(cell_candidates(points, cands, id_col, lat, lon, value, point_lat, point_lon, value_type))
    n, most = (x or 0 for x in cells.agg(F.sum(F.size("_cands")), F.max(F.size("_cands"))).first())
    cells = cells.select(_cell_key("_y", "_x").alias("_k"), "_cands")
    flat = most <= FLAT_CANDIDATES
    if flat:
        cells = cells.select("_k", F.size("_cands").alias("_n"), F.array_sort("_cands").alias("_cands"))
        of = [F.get("_cands", F.lit(i)) for i in range(max(most, 1))]
        cells = cells.select("_k", "_n", *[c[x].alias(f"_{x}{i}") for i, c in enumerate(of) for x in ("id", "lat", "lon", "value")],
                             *[F.cos(F.radians(c["lat"])).alias(f"_cos{i}") for i, c in enumerate(of)])
    side = F.broadcast(cells) if n <= BROADCAST_CANDIDATES else cells
    at = _cell(F.col(point_lat), F.col(point_lon), GRID_DEGREES[-1])
    p = points.withColumn("_k", _cell_key(at["_y"], at["_x"]))
    if flat:
        return _nearest_of_columns(p.join(side, "_k", "left"), max(most, 1), point_lat, point_lon, points.columns)
    best = G.nearest_of(F.col("_cands"), F.col(point_lat), F.col(point_lon), value_type)
    value = F.when(F.size("_cands") == 1, F.col("_cands")[0]["value"]).otherwise(best["value"])
    return p.join(side, "_k", "left").withColumns({"_best": best, "_value": value}).drop("_k", "_cands")


def _nearest_of_columns(j: DataFrame, most: int, lat: str, lon: str, keep: list[str]) -> DataFrame:
    """``G.nearest_of`` for candidates in columns, in order of id, by the parts
    of ``G.haversine_km``: small steps without arrays or folds, so that the
    whole stage is compiled, and in methods below the 8,000 bytes beyond which
    the JVM only interprets them. A cell's only candidate needs no distance."""
    def known(c):  # not nullable, so no checks follow; NaN is farther than any distance
        return F.coalesce(F.col(c), F.lit(math.nan))

    def met(i, c):  # of the candidates there are, where there is a choice
        return F.when(F.col("_n") > max(i, 1), c).otherwise(math.nan)

    each, col = range(most), F.col
    j = j.withColumns({"_la": known(lat), "_lo": known(lon)} | {f"_{c}{i}": known(f"_{c}{i}") for i in each for c in ("lat", "lon", "cos")})
    j = j.withColumns({"_cos": met(0, F.cos(F.radians("_la")))}
                      | {f"_s{i}": met(i, F.sin(F.radians(col(f"_lat{i}") - col("_la")) / 2)) for i in each}
                      | {f"_t{i}": met(i, F.sin(F.radians(col(f"_lon{i}") - col("_lo")) / 2)) for i in each})
    j = j.withColumns({f"_a{i}": col(f"_s{i}") * col(f"_s{i}") + col("_cos") * col(f"_cos{i}") * col(f"_t{i}") * col(f"_t{i}") for i in each})
    j = j.withColumns({f"_d{i}": met(i, F.lit(K.EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(f"_a{i}"), F.sqrt(F.lit(1.0) - col(f"_a{i}")))) for i in each})
    for i in each[1:]:
        nearer = col(f"_d{i}") < col("_d0")
        j = j.withColumns({c: F.when(nearer, col(f"{c[:-1]}{i}")).otherwise(col(c)) for c in ("_id0", "_value0")}
                          | {"_d0": F.least("_d0", f"_d{i}")})
    only = G.haversine_km("_la", "_lo", "_lat0", "_lon0")
    best = F.struct(F.when(col("_n") > 1, col("_d0")).otherwise(only).alias("dist"), col("_id0").alias("id"), col("_value0").alias("value"))
    return j.select(*keep, F.when(col("_n") > 0, best).alias("_best"), col("_value0").alias("_value"))


def nearest(points: DataFrame, keys: list[str], cands: DataFrame, id_col: str = "city_id",
            lat: str = "latitude", lon: str = "longitude", value: str | None = None,
            point_lat: str = "lat", point_lon: str = "lon") -> DataFrame:
    """GEO-2: nearest candidate of every point, as keys + nearest_id,
    nearest_km, nearest_value (NULL where ``with_nearest`` gives none)."""
    j = with_nearest(points, cands, id_col, lat, lon, value, point_lat, point_lon)
    # a condition on the result stays above: copied down through the steps, its variants (a power of two of them) fill the driver
    here = F.monotonically_increasing_id() >= 0
    j = j.select(*keys, F.when(here, F.col("_best")).alias("_best"))
    return j.select(*keys, F.col("_best.id").alias("nearest_id"),
                    F.when(F.col("_best.id").isNotNull(), F.col("_best.dist")).alias("nearest_km"),
                    F.col("_best.value").alias("nearest_value"))


def match_station(cities: DataFrame, stations: DataFrame, max_km: float = 50.0) -> DataFrame:
    """GEO-3: nearest station of every city within ``max_km``, else NULL."""
    pts = cities.select("city_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    m = nearest(pts, ["city_id"], stations, "station_id")
    ok = m["nearest_km"] <= max_km
    return m.select("city_id", F.when(ok, F.col("nearest_id")).alias("station_id"),
                    F.when(ok, F.round("nearest_km", 1)).alias("distance_km"))


# -- city AQI map and exposure -----------------------------------------------

def city_aqi_map(latest: DataFrame) -> DataFrame:
    """AQI per city for route scoring: the newest row of each station; a
    NULL or zero AQI counts as 100."""
    return latest.select("city_id", "latitude", "longitude",
                         F.coalesce(F.when(F.col("india_aqi") != 0, F.col("india_aqi")),
                                    F.lit(K.ROUTE_NULL_AQI)).alias("aqi"))


def sample_stride(n_points: Column) -> Column:
    """GEO-6: stride = max(1, n div 30), from index 0."""
    return F.greatest(F.lit(1), (n_points / K.ROUTE_SAMPLE_TARGET).cast("int"))


def sampled(geometry: str = "geometry") -> Column:
    g = F.col(geometry)
    stride = sample_stride(F.size(g))
    return F.filter(g, lambda p, i: i % stride == 0)


def sample_positions(n_points: Column) -> Column:
    """GEO-6: positions 0, stride, 2*stride, .. of a route with ``n_points``."""
    return F.when(n_points > 0, F.sequence(F.lit(0), n_points - 1, sample_stride(n_points))).otherwise(
        F.array().cast("array<int>"))


def sample_waypoints(routes: DataFrame, keys=("request_id", "route_idx"),
                     geometry: str | G.Path = "geometry") -> DataFrame:
    """GEO-6 as rows: sampled points with their original position. Only their
    positions are exploded; with a ``Path`` no geometry is built."""
    p = G.path(geometry)
    pos = F.col("pos")
    return (routes.withColumn("pos", F.explode(sample_positions(p.size)))
            .select(*keys, "pos", p.lat(pos).alias("lat"), p.lon(pos).alias("lon")))


def sampled_points(routes: DataFrame, keys=("request_id", "route_idx"), geometry: str = "geometry",
                   carry: bool = True) -> DataFrame:
    """GEO-6 positions 0, stride, 2*stride, .. of each route's geometry as
    rows (pos, lat, lon), carrying the route's other columns; a route
    without points gives one row with NULL pos."""
    g = F.col(geometry)
    keys = list(keys)
    others = [c for c in routes.columns if c not in keys and c != geometry] if carry else []
    pts = routes.select(*keys, *others, F.explode_outer(sample_positions(F.size(g))).alias("pos"), g.alias("_g"))
    p = F.element_at("_g", F.col("pos") + 1)
    return pts.select(*keys, *others, "pos", p["lat"].alias("lat"), p["lon"].alias("lon"))


def exposure_from_points(points: DataFrame, city_aqi: DataFrame, keys=("request_id", "route_idx")) -> DataFrame:
    """GEO-7 on sampled point rows (keys, pos, lat, lon, other route
    columns): per route, the mean AQI of the nearest city over its points
    with coordinates; 0 without such points or without cities. The route's
    other columns (no maps) depend on the key and are grouped by with it, so
    no wide row is joined back. AQI is rounded to six decimals once a city
    and summed in whole millionths, so the sums do not depend on the
    partitioning, and stay plain buffers of a hash aggregate, which adds most
    points before any shuffle."""
    millionths = (F.col("aqi").cast("decimal(18,6)") * 1_000_000).cast("long")
    near = with_nearest(points, city_aqi.withColumn("aqi", millionths), "city_id", "latitude", "longitude", "aqi",
                        value_type="long")
    others = [c for c in points.columns if c not in (*keys, "pos", "lat", "lon")]
    agg = near.groupBy(*keys, *others).agg((F.sum("_value") / 1_000_000 / F.count("_value")).alias("avg_aqi_raw"))
    return agg.withColumn("avg_aqi_raw", F.coalesce(F.col("avg_aqi_raw"), F.lit(0.0)))


def route_exposure(routes: DataFrame, city_aqi: DataFrame, keys=("request_id", "route_idx"),
                   geometry: str = "geometry") -> DataFrame:
    """GEO-7 on routes with a geometry array: only the sampled positions
    are exploded (``sequence`` with the stride), then
    ``exposure_from_points``. Adds ``avg_aqi_raw``; the geometry column
    is not carried into the result."""
    return exposure_from_points(sampled_points(routes, keys, geometry), city_aqi, keys)


def route_measures(scored: DataFrame) -> DataFrame:
    """GEO-8: km (2 decimals), minutes (1 decimal), AQI (1 decimal)."""
    return scored.withColumns({
        "distance_km": F.bround(F.col("distance_m") / 1000, 2),
        "time_min": F.bround(F.col("duration_s") / 60, 1),
        "avg_aqi": F.bround("avg_aqi_raw", 1),
    })


# -- per-request choices -----------------------------------------------------

LABELS = ["fastest", "clean", "balanced"]


def classify_routes(scored: DataFrame) -> DataFrame:
    """GEO-9: per request, fastest = min time, clean = min AQI, balanced =
    min 0.4*norm(time) + 0.6*norm(AQI) (norm 0 when constant); the first
    route (smallest index) wins ties. One row per (request, label).

    Choices are marked on the routes by windows over the request, so the
    scored routes are read once, and need no further shuffle where they lie by
    request; routes without request or index are left out."""
    t, a = F.col("duration_s"), F.col("avg_aqi")
    w = W.partitionBy("request_id")
    j = scored.filter(F.col("request_id").isNotNull()).withColumns({
        "_tmin": F.min(t).over(w), "_tmax": F.max(t).over(w), "_amin": F.min(a).over(w), "_amax": F.max(a).over(w)})
    nt = F.when(F.col("_tmax") > F.col("_tmin"),
                (t - F.col("_tmin")) / (F.col("_tmax") - F.col("_tmin"))).otherwise(0.0)
    na = F.when(F.col("_amax") > F.col("_amin"),
                (a - F.col("_amin")) / (F.col("_amax") - F.col("_amin"))).otherwise(0.0)
    j = j.withColumn("_bal", F.lit(K.BALANCED_TIME_WEIGHT) * nt + F.lit(K.BALANCED_AQI_WEIGHT) * na)
    idx = F.col("route_idx")
    j = j.withColumns({"fastest": F.min_by(idx, F.struct(t, idx)).over(w), "clean": F.min_by(idx, F.struct(a, idx)).over(w),
                       "balanced": F.min_by(idx, F.struct(F.col("_bal"), idx)).over(w),
                       "fastest_aqi": F.min_by(a, F.struct(t, idx)).over(w)})
    j = j.filter(idx.isin(*[F.col(lb) for lb in LABELS])).withColumn("_x", F.explode(F.array(*[
        F.struct(F.lit(lb).alias("route_type"), F.col(lb).alias("route_idx")) for lb in LABELS])))
    return j.filter(idx == F.col("_x.route_idx")).select(
        "request_id", "route_idx", "_x.route_type", "fastest_aqi",
        *[c for c in scored.columns if c not in ("request_id", "route_idx")])


def exposure_reduction(classified: DataFrame) -> DataFrame:
    """GEO-10: (fastest - this) / fastest * 100, 1 decimal; NULL for the
    fastest route itself and when the fastest AQI is not positive."""
    if "fastest_aqi" in classified.columns:  # carried by classify_routes, no self-join
        j = classified.withColumn("_fast_aqi", F.col("fastest_aqi")).drop("fastest_aqi")
    else:
        fast = classified.filter(F.col("route_type") == "fastest").select(
            "request_id", F.col("avg_aqi").alias("_fast_aqi"))
        j = classified.join(fast, "request_id")
    red = F.bround((F.col("_fast_aqi") - F.col("avg_aqi")) / F.col("_fast_aqi") * 100, 1)
    ok = (F.col("route_type") != "fastest") & (F.col("_fast_aqi") > 0)
    return j.withColumn("exposure_reduction_pct", F.when(ok, red)).drop("_fast_aqi")


def route_explanation(cards: DataFrame) -> DataFrame:
    """GEO-18: text per route card."""
    cat = india_category("avg_aqi", null_label=K.UNKNOWN_CATEGORY)
    base = F.format_string("%s route: %.1f km, ~%d min. Avg AQI exposure %d (%s).",
                           F.initcap("route_type"), F.bround("distance_km", 1),
                           F.bround("time_min", 0).cast("long"), F.bround("avg_aqi", 0).cast("long"), cat)
    red = F.col("exposure_reduction_pct")
    extra = (F.when((F.col("route_type") == "clean") & red.isNotNull() & (red > 0),
                    F.format_string(" %d%% less pollution exposure than the fastest route.",
                                    F.bround(red, 0).cast("long")))
             .when(F.col("route_type") == "balanced", F.lit(" Optimised balance of travel time and air quality."))
             .otherwise(F.lit("")))
    return cards.withColumn("explanation", F.concat(base, extra))


def single_path(cards: DataFrame) -> DataFrame:
    """GEO-17: one distinct route index behind all three labels, and tip."""
    g = cards.groupBy("request_id").agg(F.countDistinct("route_idx").alias("_n"))
    one = F.col("_n") == 1
    tip = F.when(one, F.lit("All three route types follow the same road — "
                            "no distinct alternative paths were found for this journey.")).otherwise(
        F.lit("The 'clean' route minimises your AQI exposure. "
              "The 'balanced' route offers the best time-vs-pollution trade-off."))
    return g.select("request_id", one.alias("single_path"), tip.alias("tip"))


def map_polyline(routes: DataFrame, geometry: str | G.Path = "geometry") -> DataFrame:
    """GEO-16: every (n div 200)-th point (at least every point), and the
    last point appended when the stride skipped it and it differs from the last
    one taken. Each point taken is evaluated once."""
    p = G.path(geometry)
    n = p.size
    stride = F.greatest(F.lit(1), (n / 200).cast("int"))
    pts = p.every(stride)
    skipped = (n > 0) & ((n - 1) % stride != 0)
    last = p.point(n - 1)
    poly = F.when(F.when(skipped, p.point(n - 1 - (n - 1) % stride) != last),
                  F.concat(pts, F.array(last))).otherwise(pts)
    return routes.withColumn("map_waypoints", poly)


# -- similarity and dedupe ---------------------------------------------------

def _similar(d1: Column, t1: Column, d2: Column, t2: Column, tol: float) -> Column:
    """Both relative differences below ``tol``, relative to route 1."""
    d_rel = F.abs(d1 - d2) / F.greatest(d1, F.lit(1.0))
    t_rel = F.abs(t1 - t2) / F.greatest(t1, F.lit(1.0))
    return (d_rel < tol) & (t_rel < tol)


def similar_pairs(routes: DataFrame, tol: float = K.ROUTE_SIMILAR_TOL) -> DataFrame:
    """GEO-11: ordered pairs (a, b), a != b, of the same request whose
    distance and duration differ by less than ``tol`` relative to a.

    Band join: distances are bucketed on a log scale with width
    -log(1 - tol); a similar partner is always in the same or a
    neighbouring bucket, so only near pairs are generated."""
    width = -math.log(1.0 - tol)
    bucket = F.floor(F.log(F.greatest(F.col("distance_m"), F.lit(1.0))) / width).cast("long")
    base = routes.select("request_id", "route_idx", "distance_m", "duration_s", bucket.alias("_b"))
    a = base.select("request_id", F.col("route_idx").alias("a_idx"), F.col("distance_m").alias("a_d"),
                    F.col("duration_s").alias("a_t"),
                    F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    b = base.select("request_id", F.col("route_idx").alias("b_idx"), F.col("distance_m").alias("b_d"),
                    F.col("duration_s").alias("b_t"), "_b")
    j = a.join(b, ["request_id", "_b"]).filter(F.col("a_idx") != F.col("b_idx"))
    j = j.filter(_similar(F.col("a_d"), F.col("a_t"), F.col("b_d"), F.col("b_t"), tol))
    return j.select("request_id", "a_idx", "b_idx")


def dedupe_routes(routes: DataFrame, cap: int = DEDUPE_POOL_CAP,
                  tol: float = K.ROUTE_SIMILAR_TOL) -> DataFrame:
    """GEO-12: greedy pool in arrival (route_idx) order: a candidate joins
    unless it is similar (relative to itself) to a route already kept, up
    to ``cap`` routes.

    The candidates of a request (rows of it, no maps) are folded in one row
    where they are at most ``FOLD_CANDIDATES``: one shuffle by request, and
    none where the routes already lie so. Requests with more are found by a
    count first and take rounds. A candidate whose similarity is unknown (NULL
    measures) only joins an empty pool; rows without request or index are left
    out."""
    cols = routes.columns
    routes = routes.filter(F.col("request_id").isNotNull() & F.col("route_idx").isNotNull())
    large = cut_lineage(routes.groupBy(F.col("request_id").alias("_r")).count().filter(F.col("count") > FOLD_CANDIDATES).select("_r"))
    if large.isEmpty():
        return _folded_pool(routes, cap, tol)
    many = F.col("request_id") == F.col("_r")
    return _folded_pool(routes.join(large, many, "left_anti"), cap, tol).unionByName(
        _pool_by_rounds(routes.join(large, many, "left_semi"), cap, tol)).select(*cols)


def _folded_pool(routes: DataFrame, cap: int, tol: float) -> DataFrame:
    cols = routes.columns
    others = [c for c in cols if c not in ("request_id", "route_idx", "distance_m", "duration_s")]
    listed = routes.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(
        "route_idx", "distance_m", "duration_s", *[F.col(f"`{c}`") for c in others]))).alias("_c"))

    def alike(r, c):
        return _similar(c["distance_m"], c["duration_s"], r["distance_m"], r["duration_s"], tol)

    pool = F.aggregate("_c", F.slice("_c", 1, 0), lambda kept, c: F.when(
        (F.size(kept) < cap) & ~F.exists(kept, lambda r: alike(r, c)), F.concat(kept, F.array(c))).otherwise(kept))
    return listed.select("request_id", F.explode(pool).alias("_c")).select("request_id", "_c.*").select(*cols)


def _pool_by_rounds(routes: DataFrame, cap: int, tol: float) -> DataFrame:
    """Exact set form of the greedy scan: round k keeps the first remaining
    candidate of each request and drops the remaining candidates similar
    to it. At most ``cap`` rounds, each a partial ``groupBy`` + equi-join,
    so no request's candidate list is ever gathered in one place."""
    cols = routes.columns
    remaining = cut_lineage(routes)
    kept = None
    for _ in range(cap):
        first = remaining.groupBy(F.col("request_id").alias("_r")).agg(F.min("route_idx").alias("_k"))
        chosen = remaining.join(first, (F.col("request_id") == F.col("_r"))
                                & (F.col("route_idx") == F.col("_k")), "left_semi")
        kept = chosen if kept is None else kept.unionByName(chosen)
        ref = chosen.select("request_id", F.col("route_idx").alias("_k"),
                            F.col("distance_m").alias("_kd"), F.col("duration_s").alias("_kt"))
        j = remaining.join(ref, "request_id", "left")
        drop = (F.col("route_idx") == F.col("_k")) | _similar(
            F.col("distance_m"), F.col("duration_s"), F.col("_kd"), F.col("_kt"), tol)
        remaining = cut_lineage(j.filter(F.col("_k").isNull() | ~drop).select(*cols))
        if remaining.isEmpty():
            break
    return kept.select(*cols)


#: Synthetic candidates of a request up to which they are folded in one row; more take rounds.
FOLD_CANDIDATES = 64
#: Natural routes that make synthetic ones needless.
ENOUGH_NATURAL = 3


def route_pool(routes: DataFrame, cap: int = DEDUPE_POOL_CAP, cap_via: int = DEDUPE_POOL_CAP_WITH_VIA,
               tol: float = K.ROUTE_SIMILAR_TOL) -> DataFrame:
    """GEO-12: the routes of each request that go on, all columns, from rows
    with ``kind`` (``natural``, ``synthetic`` or ``via``) in route_idx order.

    * A request with a ``via`` route (the first one counts) keeps it and the
      first natural routes that are not similar to it, ``cap_via`` in all. They
      may be similar to one another.
    * Otherwise all natural routes stay, similar or not. Where they are fewer
      than ``ENOUGH_NATURAL``, synthetic ones join in order while the pool holds
      fewer than ``cap``, unless similar to a route in it.

    Similarity is relative to the joining route. Natural routes are judged where
    they are; only the synthetic candidates of a request without enough natural
    routes are folded in order, in one row if they are few, else in rounds of
    joins. Rows with a NULL request or kind are left out.
    """
    counts = routes.groupBy(F.col("request_id").alias("_r")).agg(
        F.count(F.when(F.col("kind") == "natural", 1)).alias("_natural"),
        F.count(F.when(F.col("kind") == "synthetic", 1)).alias("_synthetic"),
        F.min(F.when(F.col("kind") == "via", F.struct("route_idx", F.col("distance_m").alias("d"), F.col("duration_s").alias("t")))).alias("_via"))
    j = routes.join(counts, F.col("request_id") == F.col("_r"))
    with_via, natural = F.col("_via").isNotNull(), F.col("kind") == "natural"
    d, t = F.col("distance_m"), F.col("duration_s")
    own = ["request_id", "route_idx"]

    def taken(df: DataFrame, most) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("request_id").orderBy("route_idx"))
        return df.withColumn("_nth", nth).filter(F.col("_nth") <= most).select(*own)

    via = j.filter(with_via & (F.col("kind") == "via") & (F.col("route_idx") == F.col("_via.route_idx"))).select(*own)
    beside = taken(j.filter(with_via & natural & ~_similar(d, t, F.col("_via.d"), F.col("_via.t"), tol)), cap_via - 1)
    plain = j.filter(~with_via & natural).select(*own)
    few = j.filter(~with_via & (F.col("_natural") < ENOUGH_NATURAL) & (F.col("_synthetic") > 0))

    route = F.struct(F.col("route_idx").alias("i"), d.alias("d"), t.alias("t"))
    folded = few.filter(F.col("_synthetic") <= FOLD_CANDIDATES).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(natural, route))).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "synthetic", route))).alias("_more"))
    pool = F.aggregate("_more", F.col("_first"), lambda kept, c: F.when(
        (F.size(kept) >= cap) | F.exists(kept, lambda r: _similar(c["d"], c["t"], r["d"], r["t"], tol)), kept)
        .otherwise(F.concat(kept, F.array(c))))
    added = (folded.select("request_id", F.explode(F.slice(pool, F.size("_first") + 1, cap)).alias("_c"))
             .select("request_id", F.col("_c.i").alias("route_idx")))

    many = cut_lineage(few.filter(F.col("_synthetic") > FOLD_CANDIDATES))
    if not many.isEmpty():
        # at most two natural routes a request stand in the way; the greedy pool of the rest is in order, so its first places count
        fixed = many.filter(natural).select("request_id", F.col("route_idx").alias("_fi"), d.alias("_fd"), t.alias("_ft"))
        free = many.filter(F.col("kind") == "synthetic").select(*own, "distance_m", "duration_s", "_natural")
        met = free.join(fixed, "request_id").filter(_similar(d, t, F.col("_fd"), F.col("_ft"), tol)).select(*own).distinct()
        kept = dedupe_routes(free.join(met, own, "left_anti"), cap, tol)
        added = added.unionByName(taken(kept, F.lit(cap) - F.col("_natural")))
    chosen = via.unionByName(beside).unionByName(plain).unionByName(added)
    return routes.join(chosen, own, "left_semi")


# -- via points ----------------------------------------------------------------

def via_points(requests: DataFrame) -> DataFrame:
    """GEO-13: eight via candidates perpendicular to the source-destination
    line; none for a degenerate line. Adds (via_no, via_lat, via_lon,
    label)."""
    s_lat, s_lon, d_lat, d_lon = (F.col(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon"))
    km = G.haversine_km(s_lat, s_lon, d_lat, d_lon)
    off = G.via_offset_km(km)
    dlat, dlon = d_lat - s_lat, d_lon - s_lon
    mag = F.sqrt(dlat * dlat + dlon * dlon)
    px, py = -dlon / mag, dlat / mag
    lon_km = F.lit(K.KM_PER_DEGREE) * F.greatest(F.lit(0.05), F.cos(F.radians((s_lat + d_lat) / 2)))
    cands = F.array(*[F.struct(F.lit(i).alias("via_no"), F.lit(t).alias("t"), F.lit(sg).alias("sign"),
                               F.lit(sc).alias("scale"))
                      for i, (t, sg, sc) in enumerate(K.VIA_CANDIDATES)])
    x = requests.filter(mag >= 1e-9).withColumns({"_off": off, "_px": px, "_py": py, "_lonkm": lon_km}) \
        .withColumn("_v", F.explode(cands))
    t, sg, sc = F.col("_v.t"), F.col("_v.sign"), F.col("_v.scale")
    via_lat = (s_lat + t * dlat) + sg * F.col("_px") * F.col("_off") * sc / F.lit(K.KM_PER_DEGREE)
    via_lon = (s_lon + t * dlon) + sg * F.col("_py") * F.col("_off") * sc / F.col("_lonkm")
    x = x.withColumns({"via_no": F.col("_v.via_no"), "via_lat": via_lat, "via_lon": via_lon})
    x = x.withColumn("label", G.direction_label(s_lat, s_lon, d_lat, d_lon, "via_lat", "via_lon"))
    return x.drop("_off", "_px", "_py", "_lonkm", "_v")


def via_options(pool: DataFrame, geometry: str | Column | G.Path = "geometry") -> DataFrame:
    """GEO-15: for requests whose pool has more than 3 routes, one option
    per route: the middle waypoint as via point, a direction label with
    suffix 2, 3, .. for repeats (in pool order), and a preview line of
    every (n div 50)-th point. The pool is capped (GEO-12), so the windows per
    request and per (request, label) are small. ``geometry`` may be an
    expression over the pool's columns: it is then evaluated before the windows
    for the via point and after them for the preview, so that no shuffle or
    sort carries geometries. With a ``Path`` only the points taken are built."""
    p = pool.withColumn("_pool", F.count("*").over(W.partitionBy("request_id"))).filter(F.col("_pool") > 3)
    by_rule = isinstance(geometry, G.Path)
    at = geometry if by_rule else G.ArrayPath("_g")

    def located(df: DataFrame) -> DataFrame:
        return df if by_rule else df.withColumn("_g", F.col(geometry) if isinstance(geometry, str) else geometry)

    # one element is taken at once: a NULL middle is a route without points, which gives no option
    mid = F.when(at.size > 0, at.point((at.size / 2).cast("int")))
    p = (located(p).withColumns({"_points": at.size, "_mid": mid}).drop("_g").filter(F.col("_points") > 0)
         .withColumns({"via_lat": F.col("_mid.lat"), "via_lon": F.col("_mid.lon")}).drop("_points", "_mid"))
    p = p.withColumn("_base", G.direction_label("src_lat", "src_lon", "dst_lat", "dst_lon",
                                                "via_lat", "via_lon"))
    rn = F.row_number().over(W.partitionBy("request_id", "_base").orderBy("route_idx"))
    p = p.withColumn("_rn", rn).withColumn(
        "label", F.when(F.col("_rn") == 1, F.col("_base")).otherwise(
            F.concat(F.col("_base"), F.lit(" "), F.col("_rn").cast("string"))))
    stride = F.greatest(F.lit(1), (at.size / 50).cast("int"))
    return located(p).withColumn("preview_waypoints", at.every(stride)).drop("_g", "_pool", "_base", "_rn")


# -- planned trips ---------------------------------------------------------------

def planned_route_risk(trips: DataFrame, profiles: DataFrame) -> DataFrame:
    """GEO-19: trips (user_id, planned_start, planned_end, avg_aqi,
    source_name, dest_name) scored with the user's profile: exposure hours
    = trip length clamped to 0.25..12; warning and message when the risk
    is High or Severe. Trips whose end does not follow the start are
    rejected (dropped)."""
    t = trips.filter(F.col("planned_end") > F.col("planned_start"))
    hours = hours_between("planned_start", "planned_end")
    t = t.withColumn("trip_hours", F.when(hours.isNotNull(), F.greatest(F.lit(0.25), F.least(F.lit(12.0), hours))))
    j = t.join(profiles.drop("exposure_hours"), "user_id")
    s = RISK.exposure_risk(j, "avg_aqi", "trip_hours", "activity_level", with_text=True)
    warn = F.col("risk_category").isin("High", "Severe")
    window = F.concat(F.date_format("planned_start", "MMM dd, HH:mm"), F.lit(" – "),
                      F.date_format("planned_end", "HH:mm"))
    msg = F.concat(F.lit("Route Health Alert ("), F.col("risk_category"), F.lit(" Risk): Your planned journey from "),
                   F.coalesce(F.col("source_name"), F.lit("origin")), F.lit(" to "),
                   F.coalesce(F.col("dest_name"), F.lit("destination")), F.lit(" on "), window,
                   F.lit(" has a personal risk score of "), F.bround("risk_score", 0).cast("long").cast("string"),
                   F.lit("/100 based on the route's avg AQI ("), F.bround("avg_aqi", 0).cast("long").cast("string"),
                   F.lit(") and your health profile. "), F.col("explanation"))
    return s.withColumns({"health_warning": warn, "warning_message": F.when(warn, msg)})


def route_history(saved: DataFrame, as_of: Column, days: int = 30,
                  route_type: str | None = None) -> DataFrame:
    """GEO-20: saved routes of the last ``days`` days, optionally of one
    type, with the per-user count (the sink orders newest first)."""
    s = saved.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    if route_type is not None:
        s = s.filter(F.col("route_type") == route_type)
    counts = s.groupBy("user_id").agg(F.count("*").alias("count"))
    return s.join(counts, "user_id")


def arrival_time(saved: DataFrame, override: str | None = None) -> DataFrame:
    """GEO-21: departure + the card's minutes; a manual arrival wins."""
    secs = (F.col("time_min") * 60).cast("decimal(18,6)")
    arr = F.col("planned_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
    if override is not None:
        arr = F.coalesce(F.col(override), arr)
    return saved.withColumn("arrival_at", arr)
