"""Calendar and weather-flag expressions (ENR-10..16, FEA-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_floor(ts) -> Column:
    """Truncate a zone-less timestamp to the hour without touching the
    session time zone (``date_trunc`` would go through TIMESTAMP)."""
    ts = _col(ts)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def season(month) -> Column:
    m = _col(month)
    expr = None
    for name, months in K.SEASONS[:-1]:
        expr = (F.when if expr is None else expr.when)(m.isin(*months), F.lit(name))
    return expr.otherwise(F.lit(K.SEASONS[-1][0]))


def season_sql(m: str) -> str:
    parts = ["CASE"]
    for name, months in K.SEASONS[:-1]:
        parts.append(f"WHEN {m} IN ({', '.join(map(str, months))}) THEN '{name}'")
    parts.append(f"ELSE '{K.SEASONS[-1][0]}' END")
    return " ".join(parts)


def season_code(month) -> Column:
    m = _col(month)
    expr = None
    for name, months in K.SEASONS[:-1]:
        expr = (F.when if expr is None else expr.when)(m.isin(*months), F.lit(K.SEASON_CODES[name]))
    return expr.otherwise(F.lit(K.SEASON_CODES[K.SEASONS[-1][0]]))


def season_code_sql(m: str) -> str:
    parts = ["CASE"]
    for name, months in K.SEASONS[:-1]:
        parts.append(f"WHEN {m} IN ({', '.join(map(str, months))}) THEN {K.SEASON_CODES[name]}")
    parts.append(f"ELSE {K.SEASON_CODES[K.SEASONS[-1][0]]} END")
    return " ".join(parts)


def time_of_day(hour) -> Column:
    h = _col(hour)
    expr = None
    for hi, name in K.TIME_OF_DAY:
        expr = (F.when if expr is None else expr.when)(h < F.lit(hi), F.lit(name))
    return expr.otherwise(F.lit(K.TIME_OF_DAY_LAST))


def time_of_day_sql(h: str) -> str:
    parts = ["CASE"]
    for hi, name in K.TIME_OF_DAY:
        parts.append(f"WHEN {h} < {hi} THEN '{name}'")
    parts.append(f"ELSE '{K.TIME_OF_DAY_LAST}' END")
    return " ".join(parts)


def day_name(ts) -> Column:
    """Lower-case English weekday name, independent of locale settings."""
    names = F.array(*[F.lit(n) for n in ("monday", "tuesday", "wednesday", "thursday",
                                          "friday", "saturday", "sunday")])
    return F.element_at(names, F.weekday(_col(ts)) + 1)


def day_name_sql(ts: str) -> str:
    return f"lower(dayname({ts}))"


def is_weekend(ts) -> Column:
    return F.weekday(_col(ts)) >= 5


def is_weekend_sql(ts: str) -> str:
    return f"(isodow({ts}) >= 6)"


def weekday_sql(ts: str) -> str:
    """Monday = 0, as Spark ``weekday`` and pandas ``dayofweek``."""
    return f"(isodow({ts}) - 1)"


def is_raining(precip) -> Column:
    return F.coalesce(_col(precip), F.lit(0.0)) > F.lit(0.0)


def heavy_rain(precip) -> Column:
    return F.coalesce(_col(precip), F.lit(0.0)) > F.lit(K.RAIN_HEAVY_MM)


def crop_burning(month, city, cities=K.CROP_BURNING_CITIES) -> Column:
    return _col(month).isin(*K.CROP_BURNING_MONTHS) & F.lower(_col(city)).isin(*cities)


def crop_burning_sql(m: str, city: str, cities=K.CROP_BURNING_CITIES) -> str:
    cs = ", ".join(f"'{c}'" for c in cities)
    return (f"({m} IN ({', '.join(map(str, K.CROP_BURNING_MONTHS))}) "
            f"AND lower({city}) IN ({cs}))")


def festival(ts, dates=K.FESTIVAL_DATES) -> Column:
    """Calendar membership. The set is a few dozen literal dates, so an
    ``IN`` list (hash set in codegen) beats a join."""
    return F.to_date(_col(ts)).isin(*[F.lit(d).cast("date") for d in dates])


def festival_sql(ts: str, dates=K.FESTIVAL_DATES) -> str:
    ds = ", ".join(f"DATE '{d}'" for d in dates)
    return f"(CAST({ts} AS DATE) IN ({ds}))"


def festival_proxy(month) -> Column:
    return _col(month).isin(*K.FESTIVAL_PROXY_MONTHS)


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-less timestamp, from
    calendar fields only (no session zone, so no daylight-saving gaps)."""
    t = _col(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.date_part(F.lit("SECOND"), t)
    return (days * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000
            + F.minute(t).cast("long") * 60_000_000 + (secs * 1_000_000).cast("long"))


def hours_between(start, end) -> Column:
    """Hours from ``start`` to ``end`` on zone-less timestamps."""
    return (epoch_micros(end) - epoch_micros(start)) / 3.6e9


def ntz_to_instant(c) -> Column:
    """The instant whose UTC wall time is the zone-less value (event-time
    columns for watermarks), independent of the session zone."""
    return F.timestamp_micros(epoch_micros(c))


def add_micros(ts, micros) -> Column:
    """``ts + micros`` on a zone-less timestamp using calendar arithmetic
    only (timestamp + interval goes through the session zone and can jump
    daylight-saving gaps)."""
    total = epoch_micros(ts) + micros
    day_us = F.lit(86_400_000_000)
    days = F.floor(total / day_us)
    rem = total - days * day_us
    d = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    hour = F.floor(rem / 3_600_000_000).cast("int")
    minute = F.floor((rem % 3_600_000_000) / 60_000_000).cast("int")
    sec = ((rem % 60_000_000) / 1e6).cast("decimal(8,6)")
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), hour, minute, sec)


def add_seconds(ts, seconds) -> Column:
    """``ts + seconds`` (fractional seconds kept to microseconds)."""
    s = _col(seconds) if isinstance(seconds, (str, Column)) else F.lit(seconds)
    return add_micros(ts, F.round(s.cast("double") * 1e6).cast("long"))


def instant_to_ntz(c) -> Column:
    """Inverse of ``ntz_to_instant``: the UTC wall time of an instant."""
    return add_micros(F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), F.unix_micros(_col(c)))
