"""Encoded polylines (GEO-5).

Whole Arrow batches are coded at once with numpy on the executors; Spark
partitions the routes. ``_decode`` and ``_encode`` code one line and define the
format. Tables that already carry lat/lon arrays skip this step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRECISION = 5


def _decode(encoded: str, precision: int = PRECISION) -> list[tuple[float, float]]:
    """Standard 5-bit chunked, zig-zag varint polyline decoding."""
    out: list[tuple[float, float]] = []
    factor = 10 ** precision
    i, lat, lon, n = 0, 0, 0, len(encoded)
    while i < n:
        vals = []
        for _ in range(2):
            shift = result = 0
            while True:
                b = ord(encoded[i]) - 63
                i += 1
                result |= (b & 0x1F) << shift
                shift += 5
                if b < 0x20:
                    break
            vals.append(~(result >> 1) if result & 1 else result >> 1)
        lat += vals[0]
        lon += vals[1]
        out.append((lat / factor, lon / factor))
    return out


def _encode_value(v: int) -> str:
    v = ~(v << 1) if v < 0 else v << 1
    chunks = []
    while v >= 0x20:
        chunks.append(chr((0x20 | (v & 0x1F)) + 63))
        v >>= 5
    chunks.append(chr(v + 63))
    return "".join(chunks)


def _encode(points, precision: int = PRECISION) -> str:
    factor = 10 ** precision
    plat = plon = 0
    parts = []
    for p in points:
        la, lo = round(p["lat"] * factor), round(p["lon"] * factor)
        parts.append(_encode_value(la - plat) + _encode_value(lo - plon))
        plat, plon = la, lo
    return "".join(parts)


def _bounds(a: pa.Array) -> np.ndarray:
    """Where each list's (string's) elements start among those of all, and the end; NULL ones have none."""
    size = (pa.compute.binary_length(a) if pa.types.is_string(a.type) else pa.compute.list_value_length(a)).fill_null(0)
    return np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)])


def _encode_batch(geoms: pa.Array, precision: int = PRECISION) -> pa.Array:
    """``_encode`` of every list of a batch, NULL for NULL."""
    at, points = _bounds(geoms), geoms.flatten()
    axes = dict(zip((f.name for f in points.type), points.flatten()))
    z = np.empty(2 * len(points), np.int64)
    for i, axis in enumerate(("lat", "lon")):
        v = axes[axis].to_numpy(zero_copy_only=False)
        if not np.isfinite(v).all():
            raise ValueError("a point without coordinates can't be encoded")
        v = np.rint(v * 10 ** precision).astype(np.int64)
        d = np.diff(v, prepend=0)
        first = at[:-1][at[:-1] < at[1:]]
        d[first] = v[first]
        z[i::2] = (d << 1) ^ (d >> 63)
    if z.max(initial=0) < 1 << 31:
        z = z.astype(np.int32)  # half the bytes for each of the steps below
    n = np.ones(len(z), np.uint8)
    for k in range(1, 13):
        if 5 * k > 8 * z.itemsize - 2 or not (more := z >= 1 << 5 * k).any():
            break
        n += more
    start = np.zeros(len(z) + 1, np.int64)
    np.cumsum(n, out=start[1:])
    out = np.empty(start[-1], np.uint8)
    w = start[:-1]  # where the next character of the values that are not done goes
    while len(z):
        more = z >= 0x20
        out[w] = (z & 0x1F | more * z.dtype.type(0x20)) + 63
        z, w = z[more] >> 5, w[more] + 1
    text = pa.LargeStringArray.from_buffers(len(geoms), pa.py_buffer(start[2 * at]), pa.py_buffer(out))
    return pa.compute.if_else(geoms.is_null(), None, text.cast(pa.string()))


def _decode_batch(lines: pa.Array, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points per line, and the latitudes and longitudes of all lines, as
    ``_decode`` gives them; NULL has no points."""
    at = _bounds(lines)
    text = lines.fill_null("") if lines.null_count else lines
    held = text.buffers()[2]
    begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset] if len(text) else 0
    b = (np.frombuffer(held, np.uint8)[begin:begin + at[-1]] if held and at[-1] else np.empty(0, np.uint8)) - np.uint8(63)
    last = np.flatnonzero(b < 0x20)  # of each value
    start = np.append(0, last[:-1] + 1) if len(last) else last
    size = last - start + 1
    values = np.diff(np.searchsorted(last, at))
    closed = b[at[1:][at[:-1] < at[1:]] - 1] < 0x20
    if len(b) and (b.max() > 0x3F or not closed.all() or (values % 2).any() or size.max() > 12):
        got = [_decode(x, precision) if x else [] for x in lines.to_pylist()]  # not of the usual form: one by one
        flat = np.array([p for g in got for p in g], float).reshape(-1, 2)
        return np.array([len(g) for g in got], np.int64), flat[:, 0], flat[:, 1]
    v = (b[start] & 0x1F).astype(np.int64)
    of = np.arange(len(v))
    for k in range(1, int(size.max(initial=0))):
        of = of[size[of] > k]
        v[of] |= (b[start[of] + k] & 0x1F).astype(np.int64) << 5 * k
    v = (v >> 1) ^ -(v & 1)
    counts = values // 2
    ends = np.cumsum(counts)
    axes = []
    for i in (0, 1):
        c = np.zeros(len(v) // 2 + 1, np.int64)
        np.cumsum(v[i::2], out=c[1:])
        axes.append((c[1:] - np.repeat(c[ends - counts], counts)) / 10 ** precision)
    return counts, *axes


@F.arrow_udf(T.StringType())
def _encode_udf(geoms: pa.Array) -> pa.Array:
    return _encode_batch(geoms)


#: Bytes of encoded lines that are decoded at a time; a point takes two at least.
DECODED_BYTES = 1 << 20


def encode_geometry(geometry: Column) -> Column:
    """array<struct<lat,lon>> -> encoded polyline string (Arrow batches)."""
    return _encode_udf(geometry)


def decode_waypoints(df: DataFrame, keys: list[str], polyline: str = "polyline") -> DataFrame:
    """One row per decoded point: keys + pos, lat, lon (in order)."""
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("pos", T.IntegerType()),
                                        T.StructField("lat", T.DoubleType()),
                                        T.StructField("lon", T.DoubleType())])

    def run(batches):
        for batch in batches:
            part = _bounds(batch.column(len(keys)).cast(pa.string()))[1:] // DECODED_BYTES
            for lo, hi in zip(cut := np.flatnonzero(np.diff(part, prepend=-1)), [*cut[1:], len(part)]):
                some = batch.slice(lo, hi - lo)
                counts, lat, lon = _decode_batch(some.column(len(keys)).cast(pa.string()))
                of = np.repeat(np.arange(len(counts)), counts)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(of)) for c in some.columns[:-1]), pa.array(pos.astype(np.int32)), pa.array(lat), pa.array(lon)],
                    names=[*keys, "pos", "lat", "lon"])

    return df.select(*keys, polyline).mapInArrow(run, schema)


def decode_geometry(df: DataFrame, keys: list[str], polyline: str = "polyline") -> DataFrame:
    """Decoded points regrouped as an ordered array<struct<lat,lon>> per row."""
    pts = decode_waypoints(df, keys, polyline)
    return (pts.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("_p"))
            .select(*keys, F.transform("_p", lambda p: F.struct(p["lat"].alias("lat"),
                                                                 p["lon"].alias("lon"))).alias("geometry")))
