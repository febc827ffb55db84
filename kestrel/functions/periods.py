"""Calendar periods: bucket starts, reference-style labels, differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQS = ("H", "D", "W", "M", "Q", "Y")
_ALIASES = {"A": "Y", "YE": "Y", "AS": "Y", "ME": "M", "MS": "M", "QE": "Q", "QS": "Q",
            "W-SUN": "W", "H": "H", "D": "D", "W": "W", "M": "M", "Q": "Q", "Y": "Y"}


def norm_freq(freq: str) -> str:
    f = _ALIASES.get(str(freq or "M").upper())
    if f is None:
        raise ValueError(f"unsupported frequency {freq!r}")
    return f


def period_start(ts: Column, freq: str) -> Column:
    """First instant of the period holding ``ts`` (timestamp_ntz; weeks
    start on Monday)."""
    unit = {"H": "HOUR", "D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}[norm_freq(freq)]
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def period_end_label(start: Column, freq: str) -> Column:
    """Resample label: period end day for W/M/Q/Y (Sunday for weeks),
    period start for D/H (pandas resample conventions)."""
    f = norm_freq(freq)
    d = start.cast("date")
    if f == "M":
        return F.last_day(d).cast("timestamp_ntz")
    if f == "Q":
        return F.last_day(F.add_months(d, 2)).cast("timestamp_ntz")
    if f == "Y":
        return F.make_date(F.year(d), F.lit(12), F.lit(31)).cast("timestamp_ntz")
    if f == "W":
        return F.date_add(d, 6).cast("timestamp_ntz")
    return start


def period_sequence(lo: Column, hi: Column, freq: str) -> Column:
    """Array of all period starts from ``lo`` to ``hi`` (both starts)."""
    f = norm_freq(freq)
    if f == "H":
        return F.transform(F.sequence(lo.cast("timestamp"), hi.cast("timestamp"),
                                      F.expr("INTERVAL 1 HOUR")), lambda x: x.cast("timestamp_ntz"))
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH",
            "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR"}[f]
    return F.transform(F.sequence(lo.cast("date"), hi.cast("date"), F.expr(step)),
                       lambda x: x.cast("timestamp_ntz"))


def period_label(start: Column, freq: str) -> Column:
    """pandas Period string: 2024-01, 2024Q1, 2024-01-15/2024-01-21,
    2024-01-15, 2024, 2024-01-15 10:00."""
    f = norm_freq(freq)
    if f == "M":
        return F.date_format(start, "yyyy-MM")
    if f == "Q":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    if f == "Y":
        return F.year(start).cast("string")
    if f == "W":
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(start.cast("date"), 6), "yyyy-MM-dd"))
    if f == "D":
        return F.date_format(start, "yyyy-MM-dd")
    return F.date_format(start, "yyyy-MM-dd HH:00")


def period_diff(later: Column, earlier: Column, freq: str) -> Column:
    """Whole periods between two period starts."""
    f = norm_freq(freq)
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    if f == "M":
        return months
    if f == "Q":
        return F.floor(months / 3).cast("int")
    if f == "Y":
        return F.year(later) - F.year(earlier)
    days = F.datediff(later.cast("date"), earlier.cast("date"))
    if f == "W":
        return F.floor(days / 7).cast("int")
    if f == "D":
        return days
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp")))
            / F.lit(3_600_000_000)).cast("long")
