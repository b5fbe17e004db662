"""Grouped aggregates over the daily fact and the monthly rollup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions.numeric import month_floor, percent
from ridemill.operators.cleaning import MONTH, in_parts
from ridemill.session import stage


def trusted(daily: DataFrame, flag: str = "is_suspicious") -> DataFrame:
    return daily.filter(~F.col(flag))


def in_modes(df: DataFrame, modes: Sequence[str], modo: str = "modo") -> DataFrame:
    return df.filter(F.col(modo).isin(*modes))


def monthly_rollup(daily: DataFrame, ds: str = "fecha", key: str = "modo", value: str = "cantidad_usos") -> DataFrame:
    """Per month and mode. The mean is over rows, and the flag count is 0 because flagged
    rows are filtered first; both as in the source system."""
    return (
        trusted(daily)
        .groupBy(month_floor(F.col(ds)).alias("month_start"), "year", "month", key)
        .agg(
            F.sum(value).alias("total_usos"),
            F.avg(value).alias("avg_daily_usos"),
            F.countDistinct(ds).alias("days_with_data"),
            F.sum(F.col("is_suspicious").cast("int")).alias("suspicious_days"),
        )
    )


def monthly_by_province(daily: DataFrame, ds: str = "fecha", key: str = "modo", value: str = "cantidad_usos") -> DataFrame:
    return (
        trusted(daily)
        .groupBy(month_floor(F.col(ds)).alias("month_start"), "year", "month", key, "provincia", "amba")
        .agg(F.sum(value).alias("total_usos"), F.countDistinct(ds).alias("days_with_data"))
    )


def operator_totals(daily: DataFrame, operator: str = "nombre_empresa", key: str = "modo",
                    line: str = "linea", ds: str = "fecha", value: str = "cantidad_usos") -> DataFrame:
    return (
        trusted(daily).filter(F.col(operator) != "UNKNOWN")
        .groupBy(operator, key)
        .agg(F.sum(value).alias("total_usos"),
             F.countDistinct(ds).alias("active_days"),
             F.countDistinct(line).alias("num_lineas"))
    )


def month_parts(daily: DataFrame) -> DataFrame:
    """Trusted rows of a month, mode, operator, line and place as sums that all stored rollups share.

    ``days`` has a bit for each day of the month: parts merge by OR, and counts of days in
    different months add up, so no distinct count ever needs the daily rows again. One shuffle
    deals the rows by month, as parts are stored; in the fact a part has a row a day at most.
    """
    rows = trusted(daily)
    keys = ["modo", "nombre_empresa", "linea", "provincia", "amba"]
    counts = rows.groupBy(*MONTH).agg(F.count("*").alias("n")).collect()  # at most the months of the calendar
    return in_parts(rows.select(*MONTH, "fecha", *keys, "cantidad_usos"), keys, MONTH, counts).groupBy(*MONTH, "_part", *keys).agg(
        F.sum("cantidad_usos").alias("total"), F.count("*").alias("n"),
        F.bit_or(F.expr("shiftleft(1, dayofmonth(fecha) - 1)")).alias("days")).drop("_part")


def _days(days: str = "days"):
    return F.bit_count(F.bit_or(days)).cast("bigint")


def monthly_from_parts(parts: DataFrame) -> DataFrame:
    """:func:`monthly_rollup` from the months' parts."""
    return parts.groupBy("year", "month", "modo").agg(
        F.sum("total").alias("total_usos"), (F.sum("total").cast("double") / F.sum("n")).alias("avg_daily_usos"),
        _days().alias("days_with_data"), F.lit(0).cast("bigint").alias("suspicious_days")).withColumn(
        "month_start", F.make_date("year", "month", F.lit(1)))


def provinces_from_parts(parts: DataFrame) -> DataFrame:
    """:func:`monthly_by_province` from the months' parts."""
    return parts.groupBy("year", "month", "modo", "provincia", "amba").agg(
        F.sum("total").alias("total_usos"), _days().alias("days_with_data")).withColumn("month_start", F.make_date("year", "month", F.lit(1)))


def operators_from_parts(parts: DataFrame) -> DataFrame:
    """:func:`operator_totals` from the months' parts: lines by merging their rows, days by their bits."""
    keys = ["nombre_empresa", "modo"]
    known = parts.filter(F.col("nombre_empresa") != "UNKNOWN")
    zero = F.lit(0).cast("bigint")
    lines = known.groupBy(*keys, "linea").agg(F.sum("total").alias("total")).select(
        *keys, "total", zero.alias("days"), F.col("linea").isNotNull().cast("bigint").alias("lines"))
    days = known.groupBy(*keys, "year", "month").agg(_days().alias("days")).select(*keys, zero.alias("total"), "days", zero.alias("lines"))
    return lines.union(days).groupBy(*keys).agg(
        F.sum("total").alias("total_usos"), F.sum("days").alias("active_days"), F.sum("lines").alias("num_lineas"))


def total_daily(daily: DataFrame, ds: str = "fecha", value: str = "cantidad_usos") -> DataFrame:
    return (trusted(daily).groupBy(ds, "year", "month", "day_of_week")
            .agg(F.sum(value).alias("total_usos")))


def weekday_heatmap(daily: DataFrame, ds: str = "fecha", value: str = "cantidad_usos") -> DataFrame:
    return (trusted(daily).groupBy("day_of_week", "month")
            .agg(F.sum(value).alias("total_usos"), F.avg(value).alias("avg_usos"),
                 F.countDistinct(ds).alias("num_days")))


def daily_by_mode(daily: DataFrame, modes: Sequence[str], ds: str = "fecha", key: str = "modo",
                  value: str = "cantidad_usos") -> DataFrame:
    return (in_modes(trusted(daily), modes, key)
            .groupBy(ds, "year", "month", "day_of_week", key)
            .agg(F.sum(value).alias(value)))


def daily_series(daily: DataFrame, modes: Sequence[str], ds: str = "fecha", key: str = "modo",
                 value: str = "cantidad_usos") -> DataFrame:
    """One series per mode and the series ALL, from one scan: each daily sum counts for its mode and for ALL."""
    rows = in_modes(trusted(daily), modes, key).groupBy(ds, key).agg(F.sum(value).alias("y"))
    both = F.explode(F.array(F.col(key), F.lit("ALL"))).alias("series")
    return (rows.select(F.col(ds).alias("ds"), both, "y")
            .groupBy("series", "ds").agg(F.sum("y").alias("y")))


def region_by_mode(by_province: DataFrame, modes: Sequence[str], key: str = "modo") -> DataFrame:
    return (in_modes(by_province, modes, key).filter(F.col("amba").isin(*S.REGIONS))
            .groupBy("month_start", "amba", key).agg(F.sum("total_usos").alias("total")))


def region_totals(by_mode: DataFrame, modes: Sequence[str] | None = None, key: str = "modo") -> DataFrame:
    """Regrouping of :func:`region_by_mode` over chosen modes."""
    rows = by_mode if modes is None else in_modes(by_mode, modes, key)
    return rows.groupBy("month_start", "amba").agg(F.sum("total").alias("total"))


def province_totals(by_province: DataFrame, excluded: Sequence[str] = tuple(S.UNKNOWN_PROVINCES)) -> DataFrame:
    """All-time totals; unknown provinces, and UNKNOWN as loading writes it for missing text, are left out."""
    return (by_province.filter(F.col("provincia").isNotNull() & ~F.col("provincia").isin(*excluded))
            .groupBy("provincia").agg(F.sum("total_usos").alias("total")))


def modal_statistics(monthly: DataFrame, modes: Sequence[str], key: str = "modo") -> DataFrame:
    return (in_modes(monthly, modes, key).groupBy(key).agg(
        F.sum("total_usos").alias("total_all_time"),
        F.avg("avg_daily_usos").alias("avg_daily"),
        F.max("total_usos").alias("peak_monthly"),
        F.min(F.when(F.col("total_usos") > 0, F.col("total_usos"))).alias("min_monthly")))


def mode_totals(daily: DataFrame, key: str = "modo", value: str = "cantidad_usos") -> DataFrame:
    return daily.groupBy(key).agg(F.sum(value).alias("total"))


def heatmap_pivot(by_mode: DataFrame, modes: Sequence[str], start: dt.date | None = None, end: dt.date | None = None,
                  exclude: tuple[dt.date, dt.date] | None = None, ds: str = "fecha",
                  key: str = "modo", value: str = "cantidad_usos") -> DataFrame:
    """Mean of daily totals per weekday (rows) and month (columns m1..m12)."""
    rows = in_modes(by_mode, modes, key)
    if start is not None:
        rows = rows.filter(F.col(ds) >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col(ds) <= F.lit(end))
    if exclude is not None:
        rows = rows.filter(~F.col(ds).between(F.lit(exclude[0]), F.lit(exclude[1])))
    per_day = rows.groupBy(ds, "day_of_week", "month").agg(F.sum(value).alias("v"))
    cells = [F.avg(F.when(F.col("month") == m, F.col("v"))).alias(f"m{m}") for m in range(1, 13)]
    return per_day.groupBy("day_of_week").agg(*cells)


def kpis(by_mode: DataFrame, ds: str = "fecha", key: str = "modo", value: str = "cantidad_usos") -> DataFrame:
    """Grand total, peak day and its total, mean daily total, largest mode (ties: first)."""
    by_mode = stage(by_mode.select(ds, key, value), "by-mode")  # days × modes, read three times
    per_day = by_mode.groupBy(ds).agg(F.sum(value).alias("v"))
    days = per_day.agg(
        F.sum("v").alias("total"),
        F.max_by(ds, F.struct("v", -F.unix_date(ds))).alias("peak_day"),
        F.max("v").alias("peak_total"),
        F.avg("v").alias("mean_daily"),
    )
    per_mode = by_mode.groupBy(key).agg(F.sum(value).alias("v"))
    largest = per_mode.agg(F.max("v")).scalar()
    top = per_mode.filter(F.col("v") == largest).agg(F.min(key)).scalar()
    return days.withColumn("top_mode", top)


def latest_share(monthly: DataFrame, modes: Sequence[str], key: str = "modo") -> DataFrame:
    """Each mode's share of the last month's total, in percent."""
    rows = in_modes(monthly, modes, key)
    last = rows.filter(F.col("month_start") == rows.agg(F.max("month_start")).scalar())
    total = last.agg(F.sum("total_usos")).scalar()
    return last.select("month_start", key, percent(F.col("total_usos"), total, None).alias("share_pct"))


def profile(daily: DataFrame, ds: str = "fecha", key: str = "modo", file: str = "source_file") -> DataFrame:
    """Row, file and mode counts and the date range.

    Reduced to (file, mode) groups first, so that the two distinct counts do not multiply
    the rows of the fact.
    """
    groups = daily.groupBy(file, key).agg(F.count("*").alias("n"), F.min(ds).alias("a"), F.max(ds).alias("z"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.countDistinct(file).alias("n_files"),
        F.min("a").alias("first_day"), F.max("z").alias("last_day"),
        F.countDistinct(key).alias("n_modes"))


def profile_modes(daily: DataFrame, ds: str = "fecha", key: str = "modo") -> DataFrame:
    """The mode list of the profile, one row per mode."""
    return daily.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(ds).alias("first_day"),
                                  F.max(ds).alias("last_day"))


def seasonal_amplitude(totals: DataFrame, region: str = "amba", value: str = "total") -> DataFrame:
    """Peak month over trough month per region and year."""
    return (totals.groupBy(region, F.year("month_start").alias("year"))
            .agg(F.max(value).alias("peak"), F.min(value).alias("trough"))
            .withColumn("amplitude", F.try_divide(F.col("peak").cast("double"), F.col("trough").cast("double"))))


def top_operators(totals: DataFrame, modes: Sequence[str], n: int = 10, operator: str = "nombre_empresa",
                  key: str = "modo") -> DataFrame:
    """The ``n`` largest operators; equal totals are ordered by name and mode."""
    return (in_modes(totals, modes, key).select(operator, key, "total_usos")
            .orderBy(F.desc("total_usos"), operator, key).limit(n))


def labelled(df: DataFrame, labels: DataFrame, code: str, label: str, operator: str | None = None,
             width: int = 35) -> DataFrame:
    """Code translated by a label dimension; optionally the operator name cut to ``width``."""
    out = df.join(labels, code, "left").withColumn(label, F.coalesce(label, code))
    return out if operator is None else out.withColumn("empresa_short", F.substring(operator, 1, width))
