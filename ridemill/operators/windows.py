"""Window operators. They run on already aggregated series, so a window partition holds
at most one row per calendar day (or month) of one series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions.numeric import daily_average, month_number, percent, sql_round


def trailing_mean(value: str, order: str, rows: int, by: Sequence[str] = (), min_count: int = 1) -> Column:
    """Mean over the last ``rows`` rows; NULL while fewer than ``min_count`` values are in it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    mean = F.avg(value).over(w)
    return mean if min_count <= 1 else F.when(F.count(value).over(w) >= min_count, mean)


def rolling_stats(daily_totals: DataFrame, ds: str = "fecha", value: str = "total_usos", by: Sequence[str] = ()) -> DataFrame:
    """7- and 30-row trailing means. Without ``by`` the single series is one row per day."""
    return daily_totals.select(
        *by, ds, value,
        trailing_mean(value, ds, 7, by).alias("ma_7d"),
        trailing_mean(value, ds, 30, by).alias("ma_30d"))


def daily_selected(by_mode: DataFrame, modes: Sequence[str], start: dt.date, end: dt.date,
                   ds: str = "fecha", key: str = "modo") -> DataFrame:
    """Chosen modes and days, without any 1 January."""
    new_year = (F.month(ds) == 1) & (F.dayofmonth(ds) == 1)
    return by_mode.filter(
        F.col(key).isin(*modes) & F.col(ds).between(F.lit(start), F.lit(end)) & ~new_year)


def in_period(df: DataFrame, start: dt.date, end: dt.date, ds: str = "month_start") -> DataFrame:
    """Rows of a closed date range; on stored tables the range reaches the Parquet scan."""
    return df.filter(F.col(ds).between(F.lit(start), F.lit(end)))


def rolling_by_mode(selected: DataFrame, ds: str = "fecha", key: str = "modo",
                    value: str = "cantidad_usos", rows: int = 7) -> DataFrame:
    return selected.select(ds, key, value, trailing_mean(value, ds, rows, [key]).alias("ma"))


def rolling_min_periods(df: DataFrame, value: str, by: Sequence[str], ds: str = "month_start", rows: int = 12,
                        min_count: int = 6, out: str = "rolling_12") -> DataFrame:
    return df.withColumn(out, trailing_mean(value, ds, rows, by, min_count))


def yoy(monthly: DataFrame, key: str = "modo", value: str = "total_usos") -> DataFrame:
    """Change against the same month of the previous available year."""
    w = Window.partitionBy("month", key).orderBy("year")
    return (monthly.select("month_start", "year", "month", key, value,
                           F.lag(value).over(w).alias("prev_year_usos"))
            .withColumn("yoy_pct_change", percent(F.col(value) - F.col("prev_year_usos"), F.col("prev_year_usos"))))


def modal_split(monthly: DataFrame, key: str = "modo", value: str = "total_usos") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy("month_start"))
    return monthly.select("month_start", "year", "month", key, value,
                          percent(F.col(value), total).alias("mode_share_pct"))


def modal_share_full(combined: DataFrame, modes: Sequence[str], since: dt.date = S.TRAIN_START_DEFAULT,
                     key: str = "modo", value: str = "total_usos") -> DataFrame:
    """Share of each chosen mode in the month's total over the full series."""
    rows = combined.filter((F.col("month_start") >= F.lit(since)) & F.col(key).isin(*modes))
    total = F.sum(value).over(Window.partitionBy("month_start"))
    return (rows.withColumn("month_total", total)
            .withColumn("mode_share_pct", sql_round(
                F.try_divide(F.col(value).cast("double"), F.col("month_total").cast("double")) * 100, 2))
            .select("month_start", key, value, "month_total", "mode_share_pct"))


def amba_split(by_province: DataFrame, key: str = "modo") -> DataFrame:
    """Region shares over distinct (month, mode, region, total) rows: provinces with equal
    totals collapse, exactly as the original view does."""
    rows = (by_province.filter(F.col("amba").isin(*S.REGIONS))
            .select("month_start", "year", "month", key, "amba", "total_usos").distinct())
    total = F.sum("total_usos").over(Window.partitionBy("month_start", key))
    return rows.withColumn("share_pct", percent(F.col("total_usos"), total))


def amba_region_share(by_province: DataFrame, key: str = "modo") -> DataFrame:
    """The intended region share: one row per (month, mode, region)."""
    rows = (by_province.filter(F.col("amba").isin(*S.REGIONS))
            .groupBy("month_start", "year", "month", key, "amba").agg(F.sum("total_usos").alias("total_usos")))
    total = F.sum("total_usos").over(Window.partitionBy("month_start", key))
    return rows.withColumn("share_pct", percent(F.col("total_usos"), total))


def mom_pct(df: DataFrame, key: str = "modo", ds: str = "month_start", value: str = "total_usos") -> DataFrame:
    """Change against the previous row of the series; rows without one are dropped."""
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(ds)).cast("double")
    change = F.try_divide(F.col(value).cast("double") - previous, previous) * 100
    return df.withColumn("mom_pct", change).filter(F.col("mom_pct").isNotNull())


def series_gaps(df: DataFrame, key: str = "modo", ds: str = "month_start", more_than: int = 2) -> DataFrame:
    """Pairs of consecutive months of a series lying more than ``more_than`` months apart."""
    w = Window.partitionBy(key).orderBy(ds)
    return (df.select(key, ds, F.lag(ds).over(w).alias("prev"))
            .withColumn("gap_months", month_number(F.col(ds)) - month_number(F.col("prev")))
            .filter(F.col("gap_months") > more_than))


def with_daily_average(combined: DataFrame, before: dt.date, start: dt.date | None = None,
                       ds: str = "month_start", value: str = "total_usos") -> DataFrame:
    """Monthly totals before a date as averages per day of their month."""
    rows = combined.filter(F.col(ds) < F.lit(before))
    if start is not None:
        rows = rows.filter(F.col(ds) >= F.lit(start))
    return rows.withColumn("avg_daily", daily_average(F.col(value), F.col(ds)))


def series_junction(averages: DataFrame, by_mode: DataFrame, first_day: dt.date, key: str = "modo",
                    value: str = "cantidad_usos", ds: str = "fecha") -> DataFrame:
    """Per mode: the last monthly average and the first daily point after it.

    The daily point is the fixed date if present, else the earliest day.
    """
    left = averages.groupBy(key).agg(
        F.max("month_start").alias("x0"), F.max_by("avg_daily", "month_start").alias("y0"))
    fixed = F.col(ds) == F.lit(first_day)
    right = by_mode.groupBy(key).agg(
        F.coalesce(F.min(F.when(fixed, F.col(ds))), F.min(ds)).alias("x1"),
        F.coalesce(F.max(F.when(fixed, F.col(value))), F.min_by(value, ds)).cast("double").alias("y1"))
    return left.join(right, key)


def union_monthly(historical: DataFrame | None, monthly: DataFrame, modes: Sequence[str], key: str = "modo",
                  value: str = "total_usos") -> DataFrame:
    """Historical rows followed by current ones; without a historical table current only."""
    columns = ["month_start", key, value]
    current = monthly.filter(F.col(key).isin(*modes)).select(*columns)
    if historical is None:
        return current
    return historical.filter(F.col(key).isin(*modes)).select(*columns).unionByName(current)
