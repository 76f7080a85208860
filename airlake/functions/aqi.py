"""Air-quality index expressions (ENR-1..9).

Each function returns a Spark ``Column`` (a ``CASE WHEN`` chain that stays
inside whole-stage codegen). The ``*_sql`` twins emit the same arithmetic
as DuckDB SQL text for the oracle check; both use the same slopes, written
as exact double literals, so results agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .stats import round_sql


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(x: float) -> str:
    return repr(float(x))


# -- ENR-1 sub-index ---------------------------------------------------------

def sub_index(c, bands) -> Column:
    """First band with c <= high; c clamped up to the band's low end; linear.
    Above the top band 500; NULL stays NULL; negatives clamp to 0."""
    c = _col(c).cast("double")
    expr = F.when(c.isNull(), F.lit(None).cast("double"))
    for cl, ch, il, ih in bands:
        slope = (ih - il) / (ch - cl)
        expr = expr.when(c <= F.lit(float(ch)),
                         F.lit(slope) * (F.greatest(c, F.lit(float(cl))) - F.lit(float(cl)))
                         + F.lit(float(il)))
    return expr.otherwise(F.lit(K.ABOVE_TOP_BAND))


def sub_index_sql(c: str, bands) -> str:
    parts = [f"CASE WHEN ({c}) IS NULL THEN CAST(NULL AS DOUBLE)"]
    for cl, ch, il, ih in bands:
        slope = (ih - il) / (ch - cl)
        parts.append(f"WHEN CAST({c} AS DOUBLE) <= {_lit(ch)} THEN {_lit(slope)} * "
                     f"(greatest(CAST({c} AS DOUBLE), {_lit(cl)}) - {_lit(cl)}) + {_lit(il)}")
    parts.append(f"ELSE {_lit(K.ABOVE_TOP_BAND)} END")
    return " ".join(parts)


_INDIA_INPUTS = [("pm2_5_ugm3", K.PM25_BANDS, 1.0), ("pm10_ugm3", K.PM10_BANDS, 1.0),
                 ("no2_ugm3", K.NO2_BANDS, 1.0), ("so2_ugm3", K.SO2_BANDS, 1.0),
                 ("o3_ugm3", K.O3_BANDS, 1.0), ("co_ugm3", K.CO_MG_BANDS, 1000.0)]


# -- ENR-3 India AQI ---------------------------------------------------------

def india_aqi(pm25="pm2_5_ugm3", pm10="pm10_ugm3", no2="no2_ugm3", so2="so2_ugm3",
              o3="o3_ugm3", co="co_ugm3") -> Column:
    """Max of the non-null sub-indices (CO in mg, i.e. ug/1000), 1 decimal."""
    cols = [pm25, pm10, no2, so2, o3, co]
    subs = []
    for (name, bands, div), c in zip(_INDIA_INPUTS, cols):
        x = _col(c).cast("double")
        if div != 1.0:
            x = x / F.lit(div)
        subs.append(sub_index(x, bands))
    return F.round(F.greatest(*subs), 1)


def india_aqi_sql(prefix: str = "") -> str:
    subs = []
    for name, bands, div in _INDIA_INPUTS:
        x = f"{prefix}{name}"
        if div != 1.0:
            x = f"(CAST({x} AS DOUBLE) / {_lit(div)})"
        subs.append(sub_index_sql(x, bands))
    return round_sql(f"greatest({', '.join(subs)})", 1)


# -- ENR-4 legacy India AQI --------------------------------------------------

_LEGACY_INPUTS = [("pm2_5_ugm3", K.LEGACY_PM25_BANDS), ("pm10_ugm3", K.LEGACY_PM10_BANDS),
                  ("no2_ugm3", K.LEGACY_NO2_BANDS), ("so2_ugm3", K.LEGACY_SO2_BANDS),
                  ("co_ugm3", K.LEGACY_CO_BANDS), ("o3_ugm3", K.LEGACY_O3_BANDS)]


def legacy_sub_index(c, bands) -> Column:
    """Training-set variant: negative or NULL -> NULL; first band with
    low <= c <= high (inclusive); beyond all bands 500."""
    c = _col(c).cast("double")
    expr = F.when(c.isNull() | (c < F.lit(0.0)), F.lit(None).cast("double"))
    for cl, ch, il, ih in bands:
        expr = expr.when((c >= F.lit(float(cl))) & (c <= F.lit(float(ch))),
                         F.lit(float(il)) + (c - F.lit(float(cl))) * F.lit(float(ih - il))
                         / F.lit(float(ch - cl)))
    return expr.otherwise(F.lit(K.ABOVE_TOP_BAND))


def legacy_sub_index_sql(c: str, bands) -> str:
    c = f"CAST({c} AS DOUBLE)"
    parts = [f"CASE WHEN {c} IS NULL OR {c} < 0.0 THEN CAST(NULL AS DOUBLE)"]
    for cl, ch, il, ih in bands:
        parts.append(f"WHEN {c} >= {_lit(cl)} AND {c} <= {_lit(ch)} THEN "
                     f"{_lit(il)} + ({c} - {_lit(cl)}) * {_lit(ih - il)} / {_lit(ch - cl)}")
    parts.append(f"ELSE {_lit(K.ABOVE_TOP_BAND)} END")
    return " ".join(parts)


def india_aqi_legacy() -> Column:
    return F.round(F.greatest(*[legacy_sub_index(c, b) for c, b in _LEGACY_INPUTS]), 1)


def india_aqi_legacy_sql(prefix: str = "") -> str:
    subs = [legacy_sub_index_sql(f"{prefix}{c}", b) for c, b in _LEGACY_INPUTS]
    return round_sql(f"greatest({', '.join(subs)})", 1)


# -- categories (ENR-5, 6, 8, 9) ---------------------------------------------

def _cuts(c, cuts, top, null_label=None) -> Column:
    c = _col(c)
    expr = F.when(c.isNull(), F.lit(null_label).cast("string"))
    for hi, label in cuts:
        expr = expr.when(c <= F.lit(hi), F.lit(label))
    return expr.otherwise(F.lit(top))


def _cuts_sql(c: str, cuts, top, null_label=None) -> str:
    nl = "CAST(NULL AS VARCHAR)" if null_label is None else f"'{null_label}'"
    parts = [f"CASE WHEN ({c}) IS NULL THEN {nl}"]
    for hi, label in cuts:
        parts.append(f"WHEN {c} <= {hi} THEN '{label}'")
    parts.append(f"ELSE '{top}' END")
    return " ".join(parts)


def india_category(c, null_label=None) -> Column:
    return _cuts(c, K.INDIA_CATEGORIES, K.INDIA_TOP_CATEGORY, null_label)


def india_category_sql(c: str, null_label=None) -> str:
    return _cuts_sql(c, K.INDIA_CATEGORIES, K.INDIA_TOP_CATEGORY, null_label)


def india_category_legacy(c) -> Column:
    """Integer-gap bands: a value between bands (e.g. 50.5) ends as Severe."""
    c = _col(c)
    expr = F.when(c.isNull(), F.lit(K.UNKNOWN_CATEGORY))
    for lo, hi, label in K.LEGACY_INDIA_CATEGORIES:
        expr = expr.when((c >= F.lit(lo)) & (c <= F.lit(hi)), F.lit(label))
    return expr.otherwise(F.lit(K.INDIA_TOP_CATEGORY))


def india_category_legacy_sql(c: str) -> str:
    parts = [f"CASE WHEN ({c}) IS NULL THEN '{K.UNKNOWN_CATEGORY}'"]
    for lo, hi, label in K.LEGACY_INDIA_CATEGORIES:
        parts.append(f"WHEN {c} >= {lo} AND {c} <= {hi} THEN '{label}'")
    parts.append(f"ELSE '{K.INDIA_TOP_CATEGORY}' END")
    return " ".join(parts)


def us_category(c) -> Column:
    return _cuts(c, K.US_CATEGORIES, K.US_TOP_CATEGORY)


def us_category_sql(c: str) -> str:
    return _cuts_sql(c, K.US_CATEGORIES, K.US_TOP_CATEGORY)


def pm25_category(c) -> Column:
    return _cuts(c, K.PM25_INDIA_CATEGORIES, K.PM25_INDIA_TOP_CATEGORY)


def pm25_category_sql(c: str) -> str:
    return _cuts_sql(c, K.PM25_INDIA_CATEGORIES, K.PM25_INDIA_TOP_CATEGORY)


# -- ENR-7 US AQI ------------------------------------------------------------

def us_aqi(pm25="pm2_5_ugm3") -> Column:
    """US PM2.5 index, 0 decimals, ties to even."""
    return F.bround(sub_index(pm25, K.US_PM25_BANDS), 0)


def us_aqi_sql(c: str = "pm2_5_ugm3") -> str:
    return f"round_even({sub_index_sql(c, K.US_PM25_BANDS)}, 0)"
