"""Date parts, flags, distances and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def date_parts(c: str, with_time: bool = False) -> dict[str, Column]:
    """year, month, day, dayofweek (Monday=0), dayofyear, quarter[, hour, minute]."""
    col = F.col(c)
    out = {
        f"{c}_year": F.year(col),
        f"{c}_month": F.month(col),
        f"{c}_day": F.dayofmonth(col),
        f"{c}_dayofweek": F.weekday(col),
        f"{c}_dayofyear": F.dayofyear(col),
        f"{c}_quarter": F.quarter(col),
    }
    if with_time:
        out[f"{c}_hour"] = F.hour(col)
        out[f"{c}_minute"] = F.minute(col)
    return out


def date_flags(c: str) -> dict[str, Column]:
    col = F.col(c)
    return {
        f"{c}_is_weekend": F.weekday(col) >= 5,
        f"{c}_is_month_end": F.to_date(col) == F.last_day(col),
    }


def _micros_since_sql(c: str, ref: str) -> str:
    """Microseconds from a wall-clock reference to ``c`` on wall-clock (timezone-free) time,
    so the result does not depend on the session time zone or daylight-saving shifts."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ref}', CAST(`{c}` AS TIMESTAMP_NTZ))"


def days_between(c: str, ref: str) -> Column:
    """Whole days from a reference timestamp, floored like a pandas timedelta's ``.days``."""
    return F.expr(f"CAST(floor({_micros_since_sql(c, ref)} / 86400000000) AS BIGINT)")


def days_from_epoch(c: str) -> Column:
    return days_between(c, "1970-01-01 00:00:00")


def cyclic(c: str, with_hour: bool = False) -> dict[str, Column]:
    """sin/cos of month (period 12, month not zero-based), weekday (7) and hour (24)."""
    col = F.col(c)
    two_pi = 2 * math.pi
    out = {
        f"{c}_month_sin": F.sin(two_pi * F.month(col) / 12),
        f"{c}_month_cos": F.cos(two_pi * F.month(col) / 12),
        f"{c}_dayofweek_sin": F.sin(two_pi * F.weekday(col) / 7),
        f"{c}_dayofweek_cos": F.cos(two_pi * F.weekday(col) / 7),
    }
    if with_hour:
        out[f"{c}_hour_sin"] = F.sin(two_pi * F.hour(col) / 24)
        out[f"{c}_hour_cos"] = F.cos(two_pi * F.hour(col) / 24)
    return out


# Calendar steps of the frequency codes produced by frequency inference (fixed values).
FREQ_STEP = {"S": "INTERVAL 1 SECOND", "T": "INTERVAL 1 MINUTE", "H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "B": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS",
             "MS": "INTERVAL 1 MONTH", "M": "INTERVAL 1 MONTH", "QS": "INTERVAL 3 MONTHS",
             "Q": "INTERVAL 3 MONTHS", "AS": "INTERVAL 1 YEAR", "A": "INTERVAL 1 YEAR"}

# Seasonal period per frequency code (fixed values): D/B -> 7, W -> 52, M/MS -> 12,
# Q/QS -> 4, H -> 24, anything else -> 1.
SEASONAL_PERIOD = {"D": 7, "B": 7, "W": 52, "M": 12, "MS": 12, "Q": 4, "QS": 4, "H": 24}


def future_dates(last: Column, freq: str, horizon: int) -> Column:
    """Array of the next ``horizon`` timestamps after ``last`` at calendar step ``freq``.

    A code may have a multiplier (``15T``). Business days skip weekends; ``M``, ``Q`` and ``A`` are month ends, the
    first being that of the current month if ``last`` is before it.
    """
    digits = freq[:len(freq) - len(freq.lstrip("0123456789"))]
    code, n = freq[len(digits):], int(digits or 1)
    step = F.expr(FREQ_STEP.get(code, "INTERVAL 1 DAY"))
    day = F.expr("INTERVAL 1 DAY")

    def at(i):
        i = i * F.lit(n)
        if code == "B":
            weekday = F.weekday(last)
            back = F.greatest(weekday - 4, F.lit(0))
            return last + day * (i + F.lit(2) * F.floor((F.least(weekday, F.lit(4)) + i) / F.lit(5)).cast("int") - back)
        if code in ("M", "Q", "A"):
            ended = F.last_day(last) == F.to_date(last)
            there = last + step * (i - F.when(ended, F.lit(0)).otherwise(F.lit(1)))
            return there + day * F.datediff(F.last_day(there), there)
        return last + step * i
    return F.transform(F.sequence(F.lit(1), F.lit(int(horizon))), at)


def datetime_feature_sql(c: str, with_time: bool, date_features: bool = True, cyclic_features: bool = True,
                         ref_dates: dict | None = None) -> dict[str, str]:
    """SQL form of the datetime feature set (persistable in a SQLTransformer stage)."""
    q = f"`{c}`"
    out = {}
    if date_features:
        out.update({f"{c}_year": f"CAST(year({q}) AS BIGINT)", f"{c}_month": f"CAST(month({q}) AS BIGINT)",
                    f"{c}_day": f"CAST(dayofmonth({q}) AS BIGINT)", f"{c}_dayofweek": f"CAST(weekday({q}) AS BIGINT)",
                    f"{c}_dayofyear": f"CAST(dayofyear({q}) AS BIGINT)", f"{c}_quarter": f"CAST(quarter({q}) AS BIGINT)"})
        if with_time:
            out[f"{c}_hour"] = f"CAST(hour({q}) AS BIGINT)"
            out[f"{c}_minute"] = f"CAST(minute({q}) AS BIGINT)"
        out[f"{c}_is_weekend"] = f"weekday({q}) >= 5"
        out[f"{c}_is_month_end"] = f"to_date({q}) = last_day({q})"
    if cyclic_features:
        out[f"{c}_month_sin"] = f"sin(2 * pi() * month({q}) / 12)"
        out[f"{c}_month_cos"] = f"cos(2 * pi() * month({q}) / 12)"
        out[f"{c}_dayofweek_sin"] = f"sin(2 * pi() * weekday({q}) / 7)"
        out[f"{c}_dayofweek_cos"] = f"cos(2 * pi() * weekday({q}) / 7)"
        if with_time:
            out[f"{c}_hour_sin"] = f"sin(2 * pi() * hour({q}) / 24)"
            out[f"{c}_hour_cos"] = f"cos(2 * pi() * hour({q}) / 24)"
    for name, ref in (ref_dates or {}).items():
        out[f"{c}_days_from_{name}"] = f"CAST(floor({_micros_since_sql(c, ref)} / 86400000000) AS BIGINT)"
    out[f"{c}_days_from_epoch"] = f"CAST(floor({_micros_since_sql(c, '1970-01-01 00:00:00')} / 86400000000) AS BIGINT)"
    return out
