"""Interrupted time series: segmented least squares over many monthly series at once.

Features, cross products, residuals, lagged score products, tails and bounds are DataFrame
columns and sums; Python only inverts one small matrix per series, several series per Arrow batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions import tails
from ridemill.functions.numeric import stars, window_flag
from ridemill.operators.calendars import cumulative_hike_pct
from ridemill.session import stage

FEATURES = ["const", "t", "D", "t_post", "covid", *[f"m_{m}" for m in range(2, 13)]]
LEVEL, SLOPE = FEATURES.index("D"), FEATURES.index("t_post")


def its_features(df: DataFrame, treatment: dt.date = S.TREATMENT, special: tuple[dt.date, dt.date] = (S.COVID_START, S.COVID_END),
                 series: str = "series", ds: str = "ds") -> DataFrame:
    """Row index, treatment level and slope terms, special-period flag, month dummies."""
    w = Window.partitionBy(series).orderBy(ds)
    after = F.col(ds) >= F.lit(treatment)
    out = df.withColumns({"t": F.row_number().over(w) - 1, "D": after.cast("int")})
    first = F.min(F.when(F.col("D") == 1, F.col("t"))).over(Window.partitionBy(series))
    out = out.withColumn("t_post", F.when(F.col("D") == 1, F.col("t") - first).otherwise(0))
    return out.withColumns({
        "covid": window_flag(F.col(ds), *special),
        **{f"m_{m}": (F.month(ds) == m).cast("int") for m in range(2, 13)},
    })


def enough_after(features: DataFrame, least: int = 6, series: str = "series") -> DataFrame:
    """Only series with at least ``least`` treated months."""
    n_post = F.sum("D").over(Window.partitionBy(series))
    return features.withColumn("_n_post", n_post).filter(F.col("_n_post") >= least).drop("_n_post")


def with_vector(features: DataFrame, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """The regressors as one array column ``x``."""
    parts = [F.lit(1.0) if n == "const" else F.col(n).cast("double") for n in names]
    return features.withColumn("x", F.array(*parts))


def product_sums(k: int, y: str = "y") -> Column:
    """Upper triangle of [x, y]ᵀ[x, y] as an aggregate, summed map-side like any other."""
    columns = [F.col("x")[i] for i in range(k)] + [F.col(y).cast("double")]
    return F.array(*[F.sum(columns[i] * columns[j]) for i in range(k + 1) for j in range(i, k + 1)])


def cross_products(df: DataFrame, k: int, series: str = "series", y: str = "y") -> DataFrame:
    return df.groupBy(series).agg(product_sums(k, y).alias("products"))


def full_products(upper: Sequence[Sequence[float]], k: int) -> np.ndarray:
    """Symmetric matrices of :func:`product_sums`, one per row."""
    rows, columns = np.triu_indices(k + 1)
    full = np.zeros((len(upper), k + 1, k + 1))
    full[:, rows, columns] = np.stack(list(upper))
    return full + np.triu(full, 1).transpose(0, 2, 1)


def solve_normal_equations(products: DataFrame, k: int, series: str = "series") -> DataFrame:
    """(series, beta, inverse, rank); directions without variation are left out (pseudo-inverse)."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            full = full_products(pdf["products"], k)
            gram, moment = full[:, :k, :k], full[:, :k, k]
            size = np.sqrt(np.einsum("sii->si", gram))
            scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
            values, vectors = np.linalg.eigh(gram * scale[:, :, None] * scale[:, None, :])
            kept = values > 1e-11 * values[:, -1:]
            inverted = np.divide(1.0, values, out=np.zeros_like(values), where=kept)
            inverse = (vectors * inverted[:, None, :]) @ vectors.transpose(0, 2, 1)
            inverse = inverse * scale[:, :, None] * scale[:, None, :]
            beta = np.einsum("sij,sj->si", inverse, moment)
            yield pd.DataFrame({
                series: pdf[series], "beta": list(beta),
                "inverse": list(inverse.reshape(len(pdf), k * k)), "rank": kept.sum(axis=1),
            })

    kind = products.schema[series].dataType.simpleString()
    return products.mapInPandas(solve, f"{series} {kind}, beta array<double>, inverse array<double>, rank int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def its_fit(features: DataFrame, series: str = "series", y: str = "y") -> DataFrame:
    """Least-squares coefficients per series from :func:`its_features` rows."""
    k = len(FEATURES)
    return solve_normal_equations(cross_products(with_vector(features), k, series, y), k, series)


def counterfactual(features: DataFrame, fit: DataFrame, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """Fitted values, and what they would be without the level and slope terms, for all rows."""
    joined = with_vector(features).join(fit.select(series, "beta"), series)
    fitted = dot(F.col("beta"), F.col("x"))
    effect = F.col("beta")[LEVEL] * F.col("D") + F.col("beta")[SLOPE] * F.col("t_post")
    return joined.select(
        series, ds, F.col(y).cast("double").alias("actual"), fitted.alias("fitted"),
        (fitted - effect).alias("counterfactual"), F.col("D").alias("post"),
    ).withColumn("gap", F.col("actual") - F.col("counterfactual"))


def its_hac(features: DataFrame, fit: DataFrame, lags: int = S.HAC_LAGS, series: str = "series", y: str = "y") -> DataFrame:
    """Residual sums and Newey–West variance sums per series.

    With u = (XᵀX)⁻¹xₜ·eₜ the variance of coefficient j is the long-run variance of the
    scalar series u_j, so only k sums of u·(u + 2·Σ weighted lagged u) are needed instead
    of a k×k matrix per lag.
    """
    k = len(FEATURES)
    joined = with_vector(features).join(fit, series)
    error = joined.withColumn("e", F.col(y).cast("double") - dot(F.col("beta"), F.col("x")))
    rows = F.sequence(F.lit(0), F.lit(k - 1))
    score = F.transform(rows, lambda i: dot(F.slice("inverse", i * k + 1, F.lit(k)), F.col("x")) * F.col("e"))
    scored = error.withColumn("u", score)
    earlier = F.collect_list("u").over(Window.partitionBy(series).orderBy("t").rowsBetween(-lags, -1))
    lagged = scored.withColumn("_past", earlier)

    def long_run(i: Column) -> Column:
        weighted = F.transform(
            F.col("_past"), lambda v, pos: v[i] * (1 - (F.size("_past") - pos) / F.lit(lags + 1.0)))
        return F.col("u")[i] * (F.col("u")[i] + 2 * F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v))

    products = lagged.withColumn("_v", F.transform(rows, long_run))
    return products.groupBy(series).agg(
        F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.array(*[F.sum(F.col("_v")[i]) for i in range(k)]).alias("hac_sums"))


def observed(features: DataFrame, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    value = F.col(y).cast("double")
    return features.groupBy(series).agg(
        F.count("*").alias("n_obs"), F.min(ds).alias("train_start"), F.sum("D").alias("n_post"),
        F.avg(F.when(F.col("D") == 0, value)).alias("pre_mean"),
        (F.var_pop(value) * F.count("*")).alias("sst"))


def _effect(name: str, j: int, k: int) -> dict[str, Column]:
    """Estimate, standard error, p-value and 95 % bounds of coefficient ``j``; NaN without degrees of freedom or spread."""
    beta, robust, nan = F.col("beta")[j], F.col("se_type") != "OLS", F.lit(float("nan"))
    df = (F.col("n_obs") - F.col("rank")).cast("int")
    variance = F.when(robust, F.try_divide(F.col("hac_sums")[j] * F.col("n_obs"), df)).otherwise(F.try_divide(F.col("inverse")[j * k + j] * F.col("sse"), df))
    known = (df > 0) & (variance > 0)
    error = F.when(known, F.sqrt(variance)).otherwise(nan)
    ratio = beta / error
    p = F.when(~known, nan).when(robust, tails.normal_p(ratio)).otherwise(tails.student_p(ratio, df))
    width = error * F.when(~known | robust, F.lit(tails.NORMAL_CRITICAL)).otherwise(tails.student_critical(df))
    return {f"beta_{name}": beta, f"beta_{name}_se": error, f"pvalue_{name}": p, f"ci_{name}_lo": beta - width, f"ci_{name}_hi": beta + width}


def its_inference(features: DataFrame, fit: DataFrame, hac_series: Sequence[str] | None = tuple(S.HAC_SERIES),
                  lags: int = S.HAC_LAGS, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """Level and slope effects with standard errors; ``hac_series=None`` means HAC for all."""
    robust = F.lit(True) if hac_series is None else F.col(series).isin(*hac_series)
    joined = (
        fit.join(its_hac(features, fit, lags, series, y), series)
        .join(observed(features, series, ds, y), series)
        .withColumn("se_type", F.when(robust, f"HAC-{lags}").otherwise("OLS"))
        .withColumn("r2", 1 - F.try_divide("sse", "sst"))
    )
    effects = {**_effect("level", LEVEL, len(FEATURES)), **_effect("slope", SLOPE, len(FEATURES))}
    out = joined.select(series, "n_obs", "train_start", "n_post", "pre_mean", "se_type", "r2", *[c.alias(name) for name, c in effects.items()])
    return out.withColumns({"stars_level": stars(F.col("pvalue_level")), "stars_slope": stars(F.col("pvalue_slope"))})


def its_effect(inference: DataFrame, hikes: DataFrame, after: dt.date = S.SHOCK_FROM, until: dt.date = S.SHOCK_TO,
               benchmark: float = S.ELASTICITY_BENCHMARK) -> DataFrame:
    """Level change in percent of the untreated mean, and the elasticity it implies."""
    return (
        inference.withColumn("initial_hike_pct", cumulative_hike_pct(hikes, after, until))
        .withColumn("pct_level_change", F.try_divide("beta_level", "pre_mean") * 100)
        .withColumn("implied_elasticity", F.try_divide("pct_level_change", "initial_hike_pct") * 10)
        .withColumn("wb_elasticity", F.lit(benchmark))
    )


def its_analysis(monthly: DataFrame, hikes: DataFrame, treatment: dt.date = S.TREATMENT,
                 special: tuple[dt.date, dt.date] = (S.COVID_START, S.COVID_END), hac_series: Sequence[str] | None = tuple(S.HAC_SERIES),
                 after: dt.date = S.SHOCK_FROM, until: dt.date = S.SHOCK_TO, series: str = "series", ds: str = "ds", y: str = "y") -> DataFrame:
    """The full table, one row per series with enough treated months.

    ``monthly`` holds (series, ds, y) already clipped to each series' training start.
    """
    # both are read several times below, and the input may be a scan of the whole fact
    features = stage(enough_after(its_features(monthly, treatment, special, series, ds), series=series), "features")
    fit = stage(its_fit(features, series, y), "fit")
    inference = its_inference(features, fit, hac_series, series=series, ds=ds, y=y)
    return its_effect(inference, hikes, after, until)


def its_metrics(projection: DataFrame, inference: DataFrame, series: str = "series", ds: str = "ds") -> DataFrame:
    """Cumulative and latest shortfall against the counterfactual, and the drift class."""
    post = projection.filter(F.col("post") == 1)
    lost = F.col("counterfactual") - F.col("actual")
    sums = post.groupBy(series).agg(
        F.sum(lost).alias("cumulative_gap"),
        F.max_by(F.try_divide(lost, F.col("counterfactual")) * 100, ds).alias("latest_gap_pct"))
    drift = (F.when(F.coalesce(F.col("pvalue_slope"), F.lit(1.0)) >= S.SIGNIFICANCE, "flat")
             .when(F.col("beta_slope") < 0, "falling").otherwise("rising"))
    return (sums.join(inference.select(series, "beta_slope", "pvalue_slope"), series)
            .withColumn("drift", drift))
