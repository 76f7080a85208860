"""Geographic expressions (GEO-1, GEO-13, GEO-14) and the nearest-candidate
fold used by the route operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """GEO-1: great-circle distance, R = 6371 km."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(phi1) * F.cos(phi2) * s2 * s2
    return F.lit(K.EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s1 = f"sin(radians({lat2} - {lat1}) / 2)"
    s2 = f"sin(radians({lon2} - {lon1}) / 2)"
    a = f"({s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * {s2} * {s2})"
    return f"({K.EARTH_RADIUS_KM * 2!r} * atan2(sqrt({a}), sqrt(1.0 - {a})))"


#: Candidates up to which ``nearest_of`` compares them in compiled code; more are folded, which Spark interprets.
UNROLLED = 4


class Path:
    """The ordered points of a route by their rule: their number and the
    coordinates at a 0-based position, so that only the points taken are
    evaluated, in compiled code."""

    def __init__(self, size: Column, lat, lon):
        self.size, self.lat, self.lon = size, lat, lon

    def point(self, i) -> Column:
        return F.struct(self.lat(i).alias("lat"), self.lon(i).alias("lon"))

    def every(self, stride: Column) -> Column:
        """Array of the points at 0, stride, 2 * stride, .."""
        return (F.when(self.size > 0, F.transform(F.sequence(F.lit(0), self.size - 1, stride), self.point))
                .when(self.size == 0, F.array().cast("array<struct<lat:double,lon:double>>")))


class ArrayPath(Path):
    """The points of an array<struct<lat, lon>> column."""

    def __init__(self, geometry):
        self.geometry = _c(geometry)
        super().__init__(F.size(self.geometry), lambda i: self.point(i)["lat"], lambda i: self.point(i)["lon"])

    def point(self, i) -> Column:
        return F.element_at(self.geometry, i + 1)

    def every(self, stride: Column) -> Column:
        return F.filter(self.geometry, lambda p, i: i % stride == 0)


def path(geometry) -> Path:
    """``geometry`` if it is a Path, else that of an array column."""
    return geometry if isinstance(geometry, Path) else ArrayPath(geometry)


def nearest_of(cands: Column, lat: Column, lon: Column, value_type: str = "double") -> Column:
    """The nearest of an array<struct<id, lat, lon, value>> of candidates as
    struct(dist, id, value); equal distances go to the smaller id (a total
    order, so the result does not depend on the array's order)."""
    def measured(c):
        return F.struct(haversine_km(lat, lon, c["lat"], c["lon"]).alias("dist"), c["id"].cast("long").alias("id"),
                        c["value"].cast(value_type).alias("value"))

    n, first = F.size(cands), measured(F.get(cands, F.lit(0)))
    some = F.least(first, *[F.when(n > i, measured(F.get(cands, F.lit(i)))) for i in range(1, UNROLLED)])  # skips NULL
    return (F.when(n == 1, first).when((n > 1) & (n <= UNROLLED), some)
            .when(n > UNROLLED, _folded(cands, lat, lon, value_type)))


def _folded(cands: Column, lat: Column, lon: Column, value_type: str) -> Column:
    init = F.struct(F.lit(float("inf")).alias("dist"), F.lit(None).cast("long").alias("id"),
                    F.lit(None).cast(value_type).alias("value"))

    def step(acc, c):
        d = haversine_km(lat, lon, c["lat"], c["lon"])
        better = (d < acc["dist"]) | ((d == acc["dist"]) & (c["id"] < acc["id"]))
        return F.when(better, F.struct(d.alias("dist"), c["id"].cast("long").alias("id"),
                                       c["value"].cast(value_type).alias("value"))).otherwise(acc)

    return F.aggregate(cands, init, step)


def via_offset_km(route_km) -> Column:
    """GEO-13 offset: clamp(0.15 * km, 8, 250)."""
    return F.greatest(F.lit(K.VIA_OFFSET_MIN_KM),
                      F.least(F.lit(K.VIA_OFFSET_MAX_KM), _c(route_km) * K.VIA_OFFSET_FACTOR))


def direction_label(src_lat, src_lon, dst_lat, dst_lon, via_lat, via_lon) -> Column:
    """GEO-14: the larger offset of the via point from the midpoint picks
    Northern/Southern (latitude, on ties) or Eastern/Western."""
    mid_lat = (_c(src_lat) + _c(dst_lat)) / 2
    mid_lon = (_c(src_lon) + _c(dst_lon)) / 2
    dlat = _c(via_lat) - mid_lat
    dlon = _c(via_lon) - mid_lon
    d = (F.when(F.abs(dlat) >= F.abs(dlon), F.when(dlat > 0, "Northern").otherwise("Southern"))
         .otherwise(F.when(dlon > 0, "Eastern").otherwise("Western")))
    return F.concat(d, F.lit(" Route"))


def direction_label_sql(src_lat, src_lon, dst_lat, dst_lon, via_lat, via_lon) -> str:
    dlat = f"({via_lat} - ({src_lat} + {dst_lat}) / 2)"
    dlon = f"({via_lon} - ({src_lon} + {dst_lon}) / 2)"
    return (f"(CASE WHEN abs({dlat}) >= abs({dlon}) THEN CASE WHEN {dlat} > 0 THEN 'Northern' "
            f"ELSE 'Southern' END ELSE CASE WHEN {dlon} > 0 THEN 'Eastern' ELSE 'Western' END END "
            f"|| ' Route')")
