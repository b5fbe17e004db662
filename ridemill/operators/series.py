"""Daily series: gap filling, seasonal decomposition, anomaly flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill.operators.calendars import label_holidays

WEEK = 7


def gap_fill(df: DataFrame, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """A regular daily series: missing days (and NULLs) repeat the last known value.

    Every row is stretched up to the next row's date, so no calendar is built or joined.
    """
    w = Window.partitionBy(series).orderBy(ds)
    known = F.last(y, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    until = F.coalesce(F.date_sub(F.lead(ds).over(w), 1), F.col(ds))
    days = F.expr("sequence(_from, _until, interval 1 day)")
    return (df.select(series, F.col(ds).alias("_from"), known.alias(y), until.alias("_until"))
            .select(series, "_from", y, F.explode(days).alias(ds))
            .select(series, ds, y, (F.col(ds) != F.col("_from")).alias("is_filled")))


def _window_mean(total: Column, i: Column, n: Column, before: int, after: int, w, whole: Column) -> Column:
    """Mean of rows i-before .. i+after, cut at the ends, from the running total."""
    upper = F.coalesce(F.lead(total, after).over(w), whole) if after else total
    lower = F.coalesce(F.lag(total, before + 1).over(w), F.lit(0))
    count = F.least(i + after, n) - F.greatest(i - before, F.lit(1)) + 1
    return (upper - lower).cast("double") / count


def _centred_mean(period: int, *args) -> Column:
    if period % 2:
        half = (period - 1) // 2
        return _window_mean(*args[:3], half, half, *args[3:])
    half = period // 2
    left = _window_mean(*args[:3], half, half - 1, *args[3:])
    right = _window_mean(*args[:3], half - 1, half, *args[3:])
    return (left + right) / 2


def decompose(filled: DataFrame, period: int = 365, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """Classical additive decomposition per series; short series (n < 2·period) use 7 days.

    The trend is a centred mean taken from running totals, so a row costs the same
    whatever the period. original = trend + seasonal + residual.
    """
    w = Window.partitionBy(series).orderBy(ds)
    whole = Window.partitionBy(series)
    base = filled.select(
        series, ds, F.col(y).alias("original"),
        F.row_number().over(w).alias("_i"),
        F.count("*").over(whole).alias("_n"),
        F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
        F.sum(y).over(whole).alias("_all"))
    args = (F.col("_cum"), F.col("_i"), F.col("_n"), w, F.col("_all"))
    short = F.col("_n") < 2 * period
    trended = base.select(
        series, ds, "original", "_n",
        F.when(short, _centred_mean(WEEK, *args)).otherwise(_centred_mean(period, *args)).alias("trend"),
        F.when(short, WEEK).otherwise(period).alias("period"), "_i")
    phased = trended.withColumn("_phase", (F.col("_i") - 1) % F.col("period"))
    cycle = Window.partitionBy(series, "_phase")
    gap = F.col("original").cast("double") - F.col("trend")
    raw = phased.withColumns({"_s": F.avg(gap).over(cycle), "_m": F.count("*").over(cycle)})
    level = F.sum(F.col("_s") / F.col("_m")).over(whole) / F.least(F.col("period"), F.col("_n"))
    return (raw.withColumn("seasonal", F.col("_s") - level)
            .withColumn("residual", F.col("original") - F.col("trend") - F.col("seasonal"))
            .select(series, ds, "period", "original", "trend", "seasonal", "residual"))


def anomalies(df: DataFrame, threshold: float = 3.0, events: DataFrame | None = None, holidays: DataFrame | None = None,
              lang: str = "es", series: str = "series", ds: str = "ds", residual: str = "residual") -> DataFrame:
    """z-score of the residual within its series, strict threshold, a calendar label on every row."""
    whole = Window.partitionBy(series)
    z = F.try_divide(F.col(residual) - F.avg(residual).over(whole), F.stddev_samp(residual).over(whole))
    out = (df.select(series, ds, residual, z.alias("z_score"))
           .withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))))
    if events is None:
        return out
    return label_holidays(out, events, holidays, ds, lang)


def split_explained(flagged: DataFrame, label: str = "event_label") -> DataFrame:
    """The anomalies with a flag telling whether a calendar label explains them."""
    named = F.coalesce(F.col(label) != "", F.lit(False))
    return flagged.filter("is_anomaly").withColumn("explained", named)


def anomaly_counts(flagged: DataFrame, series: str = "series", label: str = "event_label") -> DataFrame:
    named = F.coalesce(F.col(label) != "", F.lit(False))
    return flagged.groupBy(series).agg(
        F.count_if("is_anomaly").alias("n_anomalies"),
        F.count_if(F.col("is_anomaly") & named).alias("n_explained"),
        F.count_if(F.col("is_anomaly") & ~named).alias("n_unexplained"))


def anomaly_table(flagged: DataFrame, only_unexplained: bool = False, series: str = "series", ds: str = "ds") -> DataFrame:
    """Anomalies, most extreme first."""
    rows = split_explained(flagged)
    if only_unexplained:
        rows = rows.filter(~F.col("explained"))
    return (rows.select(series, ds, "z_score", "event_label")
            .orderBy(F.abs("z_score").desc(), series, ds))
