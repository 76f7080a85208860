"""Exact aggregate helpers.

Values that carry a fixed number of decimals (AQI has 1, concentrations
have 2) are summed as DECIMAL, so the sum does not depend on the order in
which partitions are combined; one final division gives the mean. This
keeps results identical across partitionings, retries and engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c, scale: int = 1, cond: Column | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    if cond is not None:
        x = F.when(cond, x)
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(c, scale: int = 1, cond: Column | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    n = F.count(F.when(cond, x)) if cond is not None else F.count(x)
    return exact_sum(c, scale, cond) / n


def exact_mean(c: str) -> Column:
    """Mean of doubles with any number of decimals, summed to ten of them, so
    that it doesn't depend on the order of the rows either."""
    return F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count(c)


def exact_mean_sql(c: str) -> str:
    return f"(CAST(sum(CAST(CAST({c} AS VARCHAR) AS DECIMAL(28, 10))) AS DOUBLE) / count({c}))"


def exact_sum_sql(c: str, scale: int = 1, cond: str | None = None) -> str:
    x = f"CASE WHEN {cond} THEN {c} END" if cond else c
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def exact_avg_sql(c: str, scale: int = 1, cond: str | None = None) -> str:
    x = f"CASE WHEN {cond} THEN {c} END" if cond else c
    return f"({exact_sum_sql(c, scale, cond)} / COUNT({x}))"


def round_sql(x: str, n: int) -> str:
    """DuckDB text of Spark's ``round`` of a double: half up on the shortest
    decimal that stands for it. DuckDB's own ``round`` scales first, so that
    26.349999999999998 becomes 26.4 there."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {n}) AS DOUBLE)"


def bround_sql(x: str, n: int) -> str:
    """DuckDB text of Spark's ``bround`` of a double, as ``round_sql`` with ties to even."""
    unit, half = f"{10 ** -n:.{n}f}", f"{10 ** -n / 2:.{n + 1}f}"
    return (f"CAST(list_transform([CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20))], lambda d: CASE WHEN abs(round(d, {n}) - d) = {half} "
            f"AND CAST(round(d, {n}) * {10 ** n} AS BIGINT) % 2 <> 0 THEN round(d, {n}) - sign(d) * {unit} ELSE round(d, {n}) END)[1] AS DOUBLE)")
