"""Fit diagnostics per series: error measures, residual autocorrelation, verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions.numeric import chi2_tail_even, sql_round
from ridemill.session import stage


def _ape(actual: Column, predicted: Column) -> Column:
    return F.abs(F.try_divide(actual - predicted, actual)) * 100


def forecast_errors(df: DataFrame, series: str = "series", actual: str = "actual", predicted: str = "yhat") -> DataFrame:
    """MAPE (zero actuals skipped), RMSE and MAE per series."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return (df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(series).agg(
        F.avg(_ape(a, p)).alias("mape"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae")))


def errors_by_period(df: DataFrame, start: dt.date = S.COVID_START, end: dt.date = S.COVID_END, series: str = "series",
                     ds: str = "ds", actual: str = "actual", predicted: str = "yhat") -> DataFrame:
    """MAPE before, inside and after the special period."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    before, after = F.col(ds) < F.lit(start), F.col(ds) > F.lit(end)
    row = _ape(a, p)
    return df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(series).agg(
        F.avg(F.when(before, row)).alias("mape_pre"),
        F.avg(F.when(~before & ~after, row)).alias("mape_covid"),
        F.avg(F.when(after, row)).alias("mape_post"))


def ljung_box(df: DataFrame, residual: str = "residual", lags: int = 12, series: str = "series", ds: str = "ds") -> DataFrame:
    """Portmanteau statistic over ``lags`` (even) autocorrelations, its p-value and flag."""
    whole, ordered = Window.partitionBy(series), Window.partitionBy(series).orderBy(ds)
    rows = df.filter(F.col(residual).isNotNull())
    centred = rows.select(series, ds, (F.col(residual) - F.avg(residual).over(whole)).alias("_e"))
    e = F.col("_e")
    lagged = centred.select(series, "_e", *[F.lag(e, k).over(ordered).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(series).agg(
        F.count("*").alias("n"), F.sum(e * e).alias("_s0"),
        *[F.coalesce(F.sum(e * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)])
    n = F.col("n").cast("double")
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        r = F.try_divide(f"_s{k}", "_s0")
        total = total + F.try_divide(r * r, n - k)
    return (sums.withColumn("lb_stat", n * (n + 2) * total)
            .withColumn("lb_pvalue", chi2_tail_even(F.col("lb_stat"), lags))
            .withColumn("autocorrelated", F.col("lb_pvalue") < S.SIGNIFICANCE)
            .select(series, "n", "lb_stat", "lb_pvalue", "autocorrelated"))


def residuals_after(df: DataFrame, end: dt.date = S.COVID_END, least: int = 12, series: str = "series", ds: str = "ds") -> DataFrame:
    """Residual rows after the special period, or all of a series with fewer than ``least`` such rows."""
    rows = df.filter(F.col("actual").isNotNull() & F.col("yhat").isNotNull()).select(
        series, ds, (F.col("actual").cast("double") - F.col("yhat")).alias("residual"))
    after = F.col(ds) > F.lit(end)
    n_after = F.sum(after.cast("int")).over(Window.partitionBy(series))
    return rows.withColumn("_n", n_after).filter(after | (F.col("_n") < least)).drop("_n")


def verdict(mape: Column, good: float = S.MAPE_GOOD, acceptable: float = S.MAPE_ACCEPTABLE) -> Column:
    return F.when(mape <= good, "good").when(mape <= acceptable, "acceptable").otherwise("poor")


def diagnostics(fc: DataFrame, start: dt.date = S.COVID_START, end: dt.date = S.COVID_END, note_series: str = "TREN",
                series: str = "series", ds: str = "ds") -> DataFrame:
    """One row per series from fitted history rows (series, ds, actual, yhat)."""
    rows = stage(fc.filter(F.col("actual").isNotNull() & F.col("yhat").isNotNull()), "fitted")
    span = rows.groupBy(series).agg(
        F.count("*").alias("n_train"), F.min(ds).alias("train_start"), F.max(ds).alias("train_end"))
    table = (span.join(forecast_errors(rows, series), series)
             .join(errors_by_period(rows, start, end, series, ds), series)
             .join(ljung_box(residuals_after(rows, end, series=series, ds=ds), series=series, ds=ds).drop("n"), series))
    weak = (F.col(series) == note_series) & (F.col("mape_pre") > 12)
    return table.withColumns({
        "verdict": verdict(F.coalesce("mape_post", "mape")),
        "its_note": F.when(weak, "weaker fit before the special period: effect estimates carry more uncertainty"),
        **{c: sql_round(F.col(c), 2) for c in ("mape", "mape_pre", "mape_covid", "mape_post")},
        **{c: sql_round(F.col(c), 0) for c in ("rmse", "mae")},
    })


def verdict_summary(table: DataFrame, series: str = "series") -> DataFrame:
    """Series and autocorrelated series per verdict, as counts; members stay rows of ``table``."""
    return table.groupBy("verdict").agg(
        F.count(series).alias("n_series"),
        F.count_if(F.coalesce(F.col("autocorrelated"), F.lit(False))).alias("n_autocorrelated"))


def verdict_members(table: DataFrame, series: str = "series") -> DataFrame:
    """The members behind the summary, one row per series."""
    return table.select("verdict", series, F.coalesce("autocorrelated", F.lit(False)).alias("autocorrelated"))
