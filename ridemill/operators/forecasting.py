"""Monthly forecasts for many series: log-linear ridge with a piecewise trend.

The model is log y = level + trend with hinges at known break dates + month effects +
special-period and shock flags + standardized cumulative-fare and recovery-momentum terms.
It keeps the structure of a decomposable trend/seasonality/regressor model with
multiplicative seasonality, but not the numbers of any particular sampler. Features, cross
products and predictions are columns and sums; Python solves one small system per series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions.numeric import momentum, month_number, sql_round, window_flag
from ridemill.operators.calendars import asof_cumsum, break_dates, macro_shock
from ridemill.operators.regression import dot, full_products, product_sums
from ridemill.session import stage
from ridemill.sources.historical import on_or_after_start

BAND_Z = 1.2815515655446004  # two-sided 80 %
BASE_PENALTY, HINGE_NOISE = 1e-6, 0.0025
MONTH_LENGTH = 365.25 / 12


def floor_by_series(df: DataFrame, series: str = "series", y: str = "y") -> DataFrame:
    """Half of each series' minimum."""
    return df.groupBy(series).agg((F.min(y) * F.lit(0.5)).alias("floor"))


def future_spine(history: DataFrame, horizon: int = S.FORECAST_MONTHS, series: str = "series", ds: str = "ds",
                 y: str = "y") -> DataFrame:
    """History plus the next ``horizon`` month starts of every series."""
    last = history.groupBy(series).agg(F.max(ds).alias("_last"))
    months = F.expr(f"sequence(add_months(_last, 1), add_months(_last, {int(horizon)}), interval 1 month)")
    ahead = last.select(series, F.explode(months).alias(ds)).withColumn("is_forecast", F.lit(True))
    return (history.select(series, ds, y).withColumn("is_forecast", F.lit(False))
            .unionByName(ahead, allowMissingColumns=True))


def training_rows(monthly: DataFrame, starts: dict[str, dt.date] | None = None, default_start: dt.date | None = None,
                  least_months: int = 24, series: str = "series", ds: str = "ds") -> DataFrame:
    """Series with enough months, clipped to their training start."""
    n = F.count("*").over(Window.partitionBy(series))
    return (monthly.withColumn("_n", n).filter(F.col("_n") >= least_months).drop("_n")
            .filter(on_or_after_start(F.col(series), F.col(ds), starts or {}, default_start)))


def _standard(c: Column, history: Column, whole) -> Column:
    known = F.when(history, c)
    z = F.try_divide(c - F.avg(known).over(whole), F.stddev_samp(known).over(whole))
    return F.coalesce(z, F.lit(0.0))


def forecast_features(spine: DataFrame, hikes: DataFrame, events: DataFrame, breaks: DataFrame,
                      special: tuple[dt.date, dt.date], reopening: dt.date, series: str = "series", ds: str = "ds",
                      y: str = "y") -> DataFrame:
    """The regressor array ``x`` and the per-series constants used to predict.

    ``breaks`` (date) are few rows of calendar dimensions, at most one per day; they travel
    as one ascending array, and each gives one hinge at the end of ``x``.
    """
    rows = asof_cumsum(spine, hikes, ds)
    rows = rows.withColumns({
        "macro_shock": macro_shock(F.col(ds), events),
        "covid_impact": window_flag(F.col(ds), *special),
        "recovery_momentum": momentum(F.col(ds), reopening),
    })
    whole = Window.partitionBy(series)
    known = ~F.col("is_forecast")
    rows = rows.withColumns({
        "_first": F.min(F.when(known, F.col(ds))).over(whole),
        "_last": F.max(F.when(known, F.col(ds))).over(whole),
        "_low": F.min(F.when(known, F.col(y))).over(whole).cast("double"),
        "_fare": _standard(F.col("fare_pressure").cast("double"), known, whole),
        "_momentum": _standard(F.col("recovery_momentum"), known, whole),
    })
    span = F.greatest(F.datediff("_last", "_first"), F.lit(1)).cast("double")

    dates = breaks.agg(F.array_sort(F.collect_set(F.col("date").cast("date")))).scalar()

    def hinge(day: Column) -> Column:
        inside = (day >= F.col("_first")) & (day < F.col("_last"))
        return F.when(inside, F.greatest(F.datediff(F.col(ds), day), F.lit(0)) / span).otherwise(F.lit(0.0))

    x = [F.lit(1.0), F.datediff(ds, "_first") / span, F.col("covid_impact"), F.col("macro_shock"),
         F.col("_fare"), F.col("_momentum"),
         *[(F.month(ds) == m).cast("int") for m in range(2, 13)]]
    return rows.withColumn("_breaks", dates).withColumns({
        "x": F.concat(F.array(*[c.cast("double") for c in x]), F.transform("_breaks", lambda day: hinge(day).cast("double"))),
        # a series with empty months is lifted so that its logarithm exists
        "_shift": F.when(F.col("_low") <= 0, 1 - F.col("_low")).otherwise(0.0),
        "_steps": F.greatest(month_number(F.col(ds)) - month_number(F.col("_last")), F.lit(0)),
        "_months": span / MONTH_LENGTH,
    }).drop("_breaks")


HINGES_FROM = 17


def fit_ridge(features: DataFrame, flexibility: dict[str, float], default_flexibility: float,
              series: str = "series", y: str = "y") -> DataFrame:
    """(series, beta, noise, drift): coefficients, residual variance and the variance one
    more break adds per squared month.

    The penalised normal equations come from summed products, so a series' rows never reach
    Python: it solves one small system per series, several series per Arrow batch.
    """
    scale = F.lit(float(default_flexibility))
    for name, value in flexibility.items():
        scale = F.when(F.col(series) == name, F.lit(float(value))).otherwise(scale)
    rows = features.filter(~F.col("is_forecast")).select(
        series, "x", scale.alias("scale"), "_months",
        F.log(F.col(y).cast("double") + F.col("_shift")).alias("z"))
    k = features.agg(F.max(F.size("x"))).first()[0] or HINGES_FROM  # one width for all series
    sums = rows.groupBy(series).agg(
        product_sums(k, "z").alias("products"), F.count("*").alias("n"), F.max("scale").alias("scale"), F.max("_months").alias("months"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            full = full_products(pdf["products"], k)
            gram, moment, square = full[:, :k, :k], full[:, :k, k], full[:, k, k]
            penalty = np.full((len(pdf), k), BASE_PENALTY)
            penalty[:, 0] = 0.0
            penalty[:, HINGES_FROM:] = HINGE_NOISE / pdf["scale"].to_numpy()[:, None] ** 2
            system = gram + penalty[:, :, None] * np.eye(k)
            solved = np.linalg.solve(system, np.concatenate([moment[:, :, None], gram], axis=2))
            beta, used = solved[:, :, 0], np.einsum("sii->s", solved[:, :, 1:])
            error = square - 2 * np.einsum("si,si->s", beta, moment) + np.einsum("si,sij,sj->s", beta, gram, beta)
            active = np.einsum("sii->si", gram)[:, HINGES_FROM:] > 0
            months = pdf["months"].to_numpy()
            slopes = (np.abs(beta[:, HINGES_FROM:]) * active).sum(1) / np.maximum(active.sum(1), 1) / months
            yield pd.DataFrame({
                series: pdf[series], "beta": list(beta), "noise": np.maximum(error, 0) / np.maximum(pdf["n"].to_numpy() - used, 1.0),
                "drift": 2 * slopes ** 2 * active.sum(1) / months})

    kind = features.schema[series].dataType.simpleString()
    return sums.mapInPandas(solve, f"{series} {kind}, beta array<double>, noise double, drift double")


def predict(features: DataFrame, fit: DataFrame, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """Point forecast, 80 % band and trend; only future rows are held above the floor."""
    rows = features.join(fit, series)
    eta = dot(F.col("beta"), F.col("x"))
    trend = F.col("beta")[0] + F.col("beta")[1] * F.col("x")[1]
    hinges = [F.slice(c, F.lit(HINGES_FROM + 1), F.size("x") - HINGES_FROM) for c in ("beta", "x")]
    trend = trend + dot(*hinges)
    h = F.col("_steps")
    spread = F.sqrt(F.col("noise") + F.col("drift") * h * (h + 1) * (2 * h + 1) / 6) * BAND_Z
    rows = rows.withColumns({"_eta": eta, "_spread": spread, "_trend": trend})

    def level(log_value: Column) -> Column:
        value = F.exp(log_value) - F.col("_shift")
        return F.when(F.col("is_forecast"), F.greatest(value, F.col("_low") * 0.5)).otherwise(value)

    return rows.select(
        series, ds,
        level(F.col("_eta")).alias("yhat"),
        level(F.col("_eta") - F.col("_spread")).alias("yhat_lower"),
        level(F.col("_eta") + F.col("_spread")).alias("yhat_upper"),
        (F.exp("_trend") - F.col("_shift")).alias("trend"),
        F.lit(0.0).alias("additive_terms"),
        "is_forecast", F.col(y).cast("double").alias("actual"))


def forecast(monthly: DataFrame, hikes: DataFrame, events: DataFrame, horizon: int = S.FORECAST_MONTHS,
             starts: dict[str, dt.date] | None = None, default_start: dt.date | None = S.TRAIN_START_DEFAULT,
             special: tuple[dt.date, dt.date] = (S.COVID_START, S.COVID_END), reopening: dt.date = S.REOPENING,
             flexibility: dict[str, float] | None = None, default_flexibility: float = S.TREND_FLEXIBILITY_DEFAULT,
             series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """Fitted history and ``horizon`` future months per series of (series, ds, y) rows."""
    breaks = break_dates(hikes, events)
    starts = S.TRAIN_START if starts is None else starts
    flexibility = S.TREND_FLEXIBILITY if flexibility is None else flexibility
    history = training_rows(monthly, starts, default_start, series=series, ds=ds)
    features = forecast_features(future_spine(history, horizon, series, ds, y), hikes, events, breaks, special,
                                 reopening, series, ds, y)
    features = stage(features, "features")  # read by the fit and by the prediction
    fit = fit_ridge(features, flexibility, default_flexibility, series, y)
    return predict(features, fit, series, ds, y)


def forecast_summary(fc: DataFrame, months: int = 6, series: str = "series", ds: str = "ds") -> DataFrame:
    """Mean forecast against the mean of the last months' actuals; series lacking either are left out."""
    known = fc.filter(~F.col("is_forecast") & F.col("actual").isNotNull())
    age = F.row_number().over(Window.partitionBy(series).orderBy(F.col(ds).desc()))
    past = known.withColumn("_age", age).filter(F.col("_age") <= months).groupBy(series).agg(
        F.avg("actual").alias("baseline"), F.max_by("actual", ds).alias("last_actual"))
    ahead = fc.filter("is_forecast").groupBy(series).agg(F.avg("yhat").alias("mean_forecast"))
    change = F.try_divide(F.col("mean_forecast") - F.col("baseline"), F.col("baseline")) * 100
    return past.join(ahead, series).withColumn("_change", change).select(
        series, "last_actual", "mean_forecast", sql_round(F.col("_change"), 1).alias("pct_change"),
        F.when(F.col("_change") > 5, "up").when(F.col("_change") < -5, "down").otherwise("flat").alias("direction"))


def forecast_joined(fc: DataFrame, series: str = "series", ds: str = "ds") -> DataFrame:
    """The forecast line with each series' last historical point in front."""
    last = (fc.filter(~F.col("is_forecast")).groupBy(series)
            .agg(F.max(ds).alias(ds), F.max_by("yhat", ds).alias("yhat")))
    return fc.filter("is_forecast").select(series, ds, "yhat").unionByName(last.select(series, ds, "yhat"))
