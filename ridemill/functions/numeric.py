"""Arithmetic expressions whose rounding and division rules are spelled out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_round(c: Column, digits: int) -> Column:
    """ROUND(x, d) on doubles as scale, round half away from zero, unscale.

    Spark's own ``round`` works on the decimal text of the double and gives another
    answer on binary ties such as 1.005.
    """
    scale = float(10 ** digits)
    whole = F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)).cast("double")
    return F.signum(c) * whole / F.lit(scale)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``100 * part / whole`` in doubles, NULL on a zero denominator."""
    value = F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))
    return value if digits is None else sql_round(value, digits)


def month_number(ds: Column) -> Column:
    """Months since year 0; differences count month boundaries exactly."""
    return F.year(ds) * 12 + F.month(ds)


def month_floor(ds: Column) -> Column:
    return F.trunc(ds, "MM")


def window_flag(ds: Column, start: dt.date, end: dt.date) -> Column:
    """1 inside the closed date interval, else 0."""
    return ds.between(F.lit(start), F.lit(end)).cast("int")


def momentum(ds: Column, since: dt.date) -> Column:
    """log(1 + whole months since ``since``), 0 before it."""
    elapsed = month_number(ds) - F.lit(since.year * 12 + since.month)
    return F.log1p(F.greatest(elapsed, F.lit(0)).cast("double"))


def daily_average(total: Column, month_start: Column) -> Column:
    """A month's total spread over the days of that month, rounded to whole units."""
    return sql_round(total.cast("double") / F.dayofmonth(F.last_day(month_start)), 0)


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def chi2_tail_even(q: Column, df: int) -> Column:
    """Upper tail of chi-square for even degrees of freedom: a finite Poisson sum."""
    if df % 2:
        raise ValueError("closed form needs even degrees of freedom")
    half = q / F.lit(2.0)
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / F.lit(float(i))
        total = total + term
    return F.exp(-half) * total
