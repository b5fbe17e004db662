"""Robust seasonal-trend decomposition by LOESS (Cleveland, Cleveland, McRae and
Terpenning 1990), one daily series per task.

Spark aggregates, fills and partitions the series; numpy smooths one series at a time. A
series has one row per calendar day, which bounds the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INNER, OUTER, SEASONAL_SPAN = 2, 15, 7


def _odd(value: float) -> int:
    whole = int(np.ceil(value))
    return whole if whole % 2 else whole + 1


def _moments(n: int, span: int, at: np.ndarray) -> np.ndarray:
    """Tricube weights times offset powers 0..2 of the ``span`` points nearest each target."""
    q = min(span, n)
    start = np.clip(at - (q - 1) // 2, 0, n - q)[:, None]
    points = np.arange(n)
    offset = points - at[:, None]
    inside = (points >= start) & (points < start + q)
    reach = np.abs(np.where(inside, offset, 0)).max(axis=1, keepdims=True) + max(span - n, 0) // 2
    near = np.minimum(np.abs(offset) / np.maximum(reach, 1), 1)
    weight = np.where(near <= 0.001, 1.0, np.where(near <= 0.999, (1 - near ** 3) ** 3, 0.0)) * inside
    return np.stack([weight, weight * offset, weight * offset ** 2])


def _line(rho: np.ndarray, y: np.ndarray, extent: int) -> np.ndarray:
    """Weighted straight-line fit at offset 0 from moments of weights (3) and values (2)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        centre, mean = rho[1] / rho[0], y[0] / rho[0]
        spread = rho[2] / rho[0] - centre ** 2
        slope = (y[1] / rho[0] - centre * mean) / spread
        return np.where(spread > (0.001 * extent) ** 2, mean - slope * centre, mean)


def smooth_rows(moments: np.ndarray, y: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """LOESS of every row of ``y`` at the targets ``moments`` was made for."""
    weights = np.einsum("ptn,bn->pbt", moments, rho)
    values = np.einsum("ptn,bn->pbt", moments[:2], rho * y)
    return _line(weights, values, y.shape[1] - 1)


def long_kernels(n: int, span: int) -> tuple[np.ndarray, ...]:
    """Moments for one long series: both ends, and the kernel shared by all points between."""
    if n <= 2 * span:
        return (_moments(n, span, np.arange(float(n))),)
    half = (span - 1) // 2
    left = _moments(span, span, np.arange(float(half)))
    middle = _moments(span, span, np.array([float(half)]))[:, 0]
    right = _moments(span, span, np.arange(half + 1.0, span))
    return left, middle, right


def smooth_long(kernels: tuple[np.ndarray, ...], y: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """LOESS of one series at all its points; the interior is a convolution."""
    if len(kernels) == 1:
        return smooth_rows(kernels[0], y[None], rho[None])[0]
    left, middle, right = kernels
    span, extent = len(middle[0]), len(y) - 1

    def ends(moments: np.ndarray, part: slice) -> np.ndarray:
        return _line(moments @ rho[part], moments[:2] @ (rho * y)[part], extent)

    weights = np.stack([np.correlate(rho, k, "valid") for k in middle])
    values = np.stack([np.correlate(rho * y, k, "valid") for k in middle[:2]])
    return np.concatenate([ends(left, slice(0, span)), _line(weights, values, extent), ends(right, slice(-span, None))])


def _mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], x]))
    return (total[width:] - total[:-width]) / width


def _subseries(n: int, period: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, extended positions, moments) of the long and the short cycle-subseries."""
    full, groups = n // period, []
    split = n - full * period
    for length, phases in ((full + 1, np.arange(split)), (full, np.arange(split, period))):
        if len(phases):
            rows = phases[:, None] + period * np.arange(length)
            wide = phases[:, None] + period * np.arange(length + 2)
            groups.append((rows, wide, _moments(length, SEASONAL_SPAN, np.arange(-1.0, length + 1))))
    return groups


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) with bisquare robustness weights."""
    n = len(y)
    groups = _subseries(n, period)
    trend_kernels = long_kernels(n, _odd(1.5 * period / (1 - 1.5 / SEASONAL_SPAN)))
    low_kernels = long_kernels(n, _odd(period + 1))
    one, rho, trend, seasonal = np.ones(n), np.ones(n), np.zeros(n), np.zeros(n)
    cycle = np.empty(n + 2 * period)
    for _ in range(OUTER + 1):
        for _ in range(INNER):
            detrended = y - trend
            for rows, wide, moments in groups:
                own = detrended[rows]
                fit = smooth_rows(moments, own, rho[rows])
                # where robustness leaves no weight nearby a point stands for itself
                cycle[wide] = np.where(np.isfinite(fit), fit, np.pad(own, ((0, 0), (1, 1)), "edge"))
            low = _mean(_mean(_mean(cycle, period), period), 3)
            seasonal = cycle[period:period + n] - smooth_long(low_kernels, low, one)
            fit = smooth_long(trend_kernels, y - seasonal, rho)
            trend = np.where(np.isfinite(fit), fit, y - seasonal)
        size = np.abs(y - trend - seasonal)
        limit = 6 * np.median(size)
        if limit <= 0:
            break
        ratio = size / limit
        rho = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - ratio ** 2) ** 2, 0.0))
    return trend, seasonal


def decompose_loess(filled: DataFrame, period: int = 365, series: str = "series", ds: str = "ds", y: str = "y",
                    short_period: int = 7) -> DataFrame:
    """Robust LOESS decomposition of gap-filled daily series; short ones use weekly seasons.

    The explicit repartition keeps AQE from packing many small series, each seconds of
    work, into one task.
    """
    key_type = filled.schema[series].dataType.simpleString()

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds", ignore_index=True)
        values = pdf["original"].to_numpy(float)
        chosen = period if len(values) >= 2 * period else short_period
        if len(values) < 2 * chosen:  # too short for any season: all trend
            trend, seasonal = values.copy(), np.zeros(len(values))
        else:
            trend, seasonal = stl(values, chosen)
        return pdf.assign(period=chosen, trend=trend, seasonal=seasonal, residual=values - trend - seasonal)

    columns = filled.select(F.col(series).alias("series"), F.col(ds).alias("ds"), F.col(y).cast("double").alias("original"))
    tasks = int(filled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return columns.repartition(tasks, "series").groupBy("series").applyInPandas(
        one_series,
        f"series {key_type}, ds date, original double, period int, trend double, seasonal double, residual double")
