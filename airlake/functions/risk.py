"""Personal exposure risk expressions (RSK-1..10) as Spark columns, with
DuckDB twins for the oracle.

Rounding: the original rounds with Python's ``round`` (ties to even on the
binary value). ``bround`` (ties to even) is the closest Spark builtin;
DuckDB's ``round_even`` agrees with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

FACTOR_NAMES = ["aqi_contribution", "age_contribution", "condition_contribution",
                "activity_contribution", "duration_contribution", "sensitivity_contribution"]

# FIXED VALUES - factor labels shown in the breakdown, in factor order
FACTOR_LABELS = ["Base AQI risk level", "Age-adjusted multiplier", "Health condition multiplier",
                 "Physical activity level", "Outdoor exposure duration", "Personal sensitivity level"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _r(x: float) -> str:
    return repr(float(x))


def base_score(aqi) -> Column:
    """RSK-1: AQI clamped to 0..500, contiguous piecewise linear."""
    given = _c(aqi).cast("double")
    a = F.greatest(F.lit(0.0), F.least(F.lit(500.0), given))
    expr = F.when(given.isNull(), F.lit(None).cast("double"))  # a clamp alone would turn NULL into the maximum
    for lo, hi, s_lo, s_hi in K.RISK_AQI_BANDS:
        v = F.lit(float(s_lo)) + F.lit(s_hi - s_lo) * (a - F.lit(float(lo))) / F.lit(float(hi - lo))
        cond = (a >= F.lit(float(lo))) & (a <= F.lit(float(hi)))
        expr = expr.when(cond, v)
    return expr.otherwise(F.lit(1.0))


def base_score_sql(aqi: str) -> str:
    a = f"greatest(0.0::DOUBLE, least(500.0::DOUBLE, CAST({aqi} AS DOUBLE)))"
    parts = [f"CASE WHEN {aqi} IS NULL THEN NULL"]
    for lo, hi, s_lo, s_hi in K.RISK_AQI_BANDS:
        parts.append(f"WHEN {a} >= {_r(lo)} AND {a} <= {_r(hi)} THEN "
                     f"{_r(s_lo)} + {_r(s_hi - s_lo)} * ({a} - {_r(lo)}) / {_r(hi - lo)}")
    parts.append("ELSE 1.0::DOUBLE END")
    return " ".join(parts)


def age_multiplier(age) -> Column:
    """RSK-2."""
    a = _c(age)
    expr = F.when(a.isNull(), F.lit(1.0))
    for below, m in K.RISK_AGE_STEPS:
        expr = expr.when(a < below, F.lit(m))
    return expr.otherwise(F.lit(K.RISK_AGE_ELDERLY))


def age_multiplier_sql(age: str) -> str:
    parts = [f"CASE WHEN {age} IS NULL THEN 1.0::DOUBLE"]
    for below, m in K.RISK_AGE_STEPS:
        parts.append(f"WHEN {age} < {below} THEN {_r(m)}")
    parts.append(f"ELSE {_r(K.RISK_AGE_ELDERLY)} END")
    return " ".join(parts)


def condition_multiplier(prefix: str = "") -> Column:
    """RSK-3: 1 + the weight of each active condition, added in order."""
    m = F.lit(1.0)
    for flag, w in K.RISK_CONDITIONS:
        m = m + F.when(F.coalesce(F.col(prefix + flag), F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    return m


def condition_multiplier_sql(prefix: str = "") -> str:
    m = "1.0::DOUBLE"
    for flag, w in K.RISK_CONDITIONS:
        m = f"({m} + CASE WHEN coalesce({prefix}{flag}, false) THEN {_r(w)} ELSE 0.0::DOUBLE END)"
    return m


def _lookup(level, table: dict) -> Column:
    lv = F.lower(_c(level).cast("string"))
    expr = None
    for k, v in table.items():
        expr = F.when(lv == k, F.lit(v)) if expr is None else expr.when(lv == k, F.lit(v))
    return expr.otherwise(F.lit(1.0))


def _lookup_sql(level: str, table: dict) -> str:
    parts = ["CASE"]
    for k, v in table.items():
        parts.append(f"WHEN lower({level}) = '{k}' THEN {_r(v)}")
    parts.append("ELSE 1.0::DOUBLE END")
    return " ".join(parts)


def activity_multiplier(level) -> Column:
    """RSK-4 (by the level's value; unknown -> 1.0)."""
    return _lookup(level, K.ACTIVITY_MULTIPLIERS)


def activity_multiplier_sql(level: str) -> str:
    return _lookup_sql(level, K.ACTIVITY_MULTIPLIERS)


def duration_multiplier(hours) -> Column:
    """RSK-5: hours / 8 clamped to 0.25..2."""
    h = _c(hours).cast("double")
    return F.when(h.isNotNull(), F.greatest(F.lit(0.25), F.least(F.lit(2.0), h / F.lit(8.0))))


def duration_multiplier_sql(hours: str) -> str:
    return f"CASE WHEN {hours} IS NOT NULL THEN greatest(0.25::DOUBLE, least(2.0::DOUBLE, CAST({hours} AS DOUBLE) / 8.0::DOUBLE)) END"


def sensitivity_multiplier(level) -> Column:
    """RSK-6."""
    return _lookup(level, K.SENSITIVITY_MULTIPLIERS)


def sensitivity_multiplier_sql(level: str) -> str:
    return _lookup_sql(level, K.SENSITIVITY_MULTIPLIERS)


def risk_category(score) -> Column:
    """RSK-8."""
    s = _c(score)
    expr = None
    for hi, name in K.RISK_CATEGORIES:
        expr = F.when(s <= hi, F.lit(name)) if expr is None else expr.when(s <= hi, F.lit(name))
    return expr.otherwise(F.lit(K.RISK_TOP_CATEGORY))


def risk_category_sql(score: str) -> str:
    parts = ["CASE"]
    for hi, name in K.RISK_CATEGORIES:
        parts.append(f"WHEN {score} <= {hi} THEN '{name}'")
    parts.append(f"ELSE '{K.RISK_TOP_CATEGORY}' END")
    return " ".join(parts)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def recommendations(category, prefix: str = "") -> Column:
    """RSK-9: advice of the category, then one line per active condition."""
    cat = _c(category)
    base = None
    for name, lines in K.RISK_RECOMMENDATIONS.items():
        arr = F.array(*[F.lit(x) for x in lines])
        base = F.when(cat == name, arr) if base is None else base.when(cat == name, arr)
    cond = F.array(*[F.when(F.coalesce(F.col(prefix + flag), F.lit(False)), F.lit(text))
                     for flag, text in K.CONDITION_RECOMMENDATIONS])
    return F.concat(base, F.filter(cond, lambda x: x.isNotNull()))


def recommendations_sql(category: str, prefix: str = "") -> str:
    parts = ["CASE"]
    for name, lines in K.RISK_RECOMMENDATIONS.items():
        parts.append(f"WHEN {category} = '{name}' THEN [{', '.join(_sq(x) for x in lines)}]")
    parts.append("END")
    cond = ", ".join(f"CASE WHEN coalesce({prefix}{flag}, false) THEN {_sq(text)} END"
                     for flag, text in K.CONDITION_RECOMMENDATIONS)
    return f"list_concat({' '.join(parts)}, list_filter([{cond}], lambda x: x IS NOT NULL))"


def _int_text(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def _int_text_sql(c: str) -> str:
    return f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR)"


def explanation(score, category, aqi, cond_f, act_f, dur_f, prefix: str = "") -> Column:
    """RSK-10: the explanation text; extra parts only when a factor > 1."""
    names = F.array(*[F.when(F.coalesce(F.col(prefix + flag), F.lit(False)), F.lit(flag.replace("_", " ")))
                      for flag, _t in K.CONDITION_RECOMMENDATIONS])
    active = F.filter(names, lambda x: x.isNotNull())
    head = F.concat(F.lit("Your personalised risk score is "), _int_text(_c(score)), F.lit("/100 ("),
                    _c(category), F.lit("). Current AQI is "), _int_text(_c(aqi)), F.lit("."))
    conds = F.when((_c(cond_f) > 1.0) & (F.size(active) > 0),
                   F.concat(F.lit("Your health conditions ("), F.array_join(active, ", "),
                            F.lit(") increase risk.")))
    act = F.when(_c(act_f) > 1.0, F.lit("Your activity level increases pollutant inhalation."))
    dur = F.when(_c(dur_f) > 1.0, F.lit("Extended outdoor exposure raises your risk."))
    return F.concat_ws(" ", head, conds, act, dur)


def explanation_sql(score: str, category: str, aqi: str, cond_f: str, act_f: str, dur_f: str,
                    prefix: str = "") -> str:
    names = ", ".join(f"CASE WHEN coalesce({prefix}{flag}, false) THEN '{flag.replace('_', ' ')}' END"
                      for flag, _t in K.CONDITION_RECOMMENDATIONS)
    active = f"list_filter([{names}], lambda x: x IS NOT NULL)"
    head = (f"'Your personalised risk score is ' || {_int_text_sql(score)} || '/100 (' || {category} || "
            f"'). Current AQI is ' || {_int_text_sql(aqi)} || '.'")
    conds = (f"CASE WHEN {cond_f} > 1.0 AND len({active}) > 0 THEN 'Your health conditions (' || "
             f"array_to_string({active}, ', ') || ') increase risk.' END")
    act = f"CASE WHEN {act_f} > 1.0 THEN 'Your activity level increases pollutant inhalation.' END"
    dur = f"CASE WHEN {dur_f} > 1.0 THEN 'Extended outdoor exposure raises your risk.' END"
    return f"concat_ws(' ', {head}, {conds}, {act}, {dur})"
