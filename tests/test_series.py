import datetime as dt

import numpy as np
import pytest

from ridemill.operators import loess as L
from ridemill.operators import series as Z

DAY = dt.date


def daily(spark, values, name="s", start=DAY(2020, 1, 1)):
    return spark.createDataFrame([(name, start + dt.timedelta(i), v) for i, v in enumerate(values) if v is not None],
                                 "series string, ds date, y long")


def test_gap_fill(spark, rows):
    out = Z.gap_fill(daily(spark, [5, None, None, 8, 9]).unionByName(daily(spark, [1], "t")))
    assert rows(out) == [("s", DAY(2020, 1, 1), 5, False), ("s", DAY(2020, 1, 2), 5, True), ("s", DAY(2020, 1, 3), 5, True),
                         ("s", DAY(2020, 1, 4), 8, False), ("s", DAY(2020, 1, 5), 9, False), ("t", DAY(2020, 1, 1), 1, False)]


def centred(y, before, after):
    return np.array([np.mean(y[max(i - before, 0):i + after + 1]) for i in range(len(y))])


@pytest.mark.parametrize("period", [7, 12, 365])
def test_decompose_against_numpy(spark, period):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1000, 60)
    out = Z.decompose(daily(spark, [int(v) for v in y]), period).orderBy("ds").toPandas()
    used = 7 if len(y) < 2 * period else period
    assert (out["period"] == used).all()
    trend = centred(y, 3, 3) if used == 7 else (centred(y, 6, 5) + centred(y, 5, 6)) / 2
    raw = np.array([np.mean((y - trend)[i % used::used]) for i in range(len(y))])
    seasonal = raw - np.mean([raw[i] for i in range(used)])
    np.testing.assert_allclose(out["trend"], trend)
    np.testing.assert_allclose(out["seasonal"], seasonal)
    np.testing.assert_allclose(out["trend"] + out["seasonal"] + out["residual"], y)


def test_anomalies_exact(spark):
    df = spark.createDataFrame([("s", DAY(2024, 1, 1) + dt.timedelta(i), float(i)) for i in range(5)], "series string, ds date, residual double")
    z = [r.z_score for r in Z.anomalies(df).orderBy("ds").collect()]
    np.testing.assert_allclose(z, (np.arange(5) - 2) / np.std(np.arange(5), ddof=1))
    strict = Z.anomalies(df, z[-1])
    assert strict.filter("is_anomaly").count() == 0
    flat = spark.createDataFrame([("s", DAY(2024, 1, i), 1.0) for i in (1, 2)], "series string, ds date, residual double")
    assert Z.anomalies(flat).filter("is_anomaly OR z_score IS NOT NULL").count() == 0


def test_explained_split(spark, rows):
    df = spark.createDataFrame([("s", DAY(2024, 1, 1), -4.0, True, "x"), ("s", DAY(2024, 1, 2), 5.0, True, ""), ("s", DAY(2024, 1, 3), 6.0, True, None),
                                ("s", DAY(2024, 1, 4), 0.0, False, "y")], "series string, ds date, z_score double, is_anomaly boolean, event_label string")
    assert rows(Z.anomaly_counts(df)) == [("s", 3, 1, 2)]
    assert [r.z_score for r in Z.anomaly_table(df).collect()] == [6.0, 5.0, -4.0]
    assert [r.z_score for r in Z.anomaly_table(df, only_unexplained=True).collect()] == [6.0, 5.0]


def brute(y, rho, span, at):
    """LOESS by its definition, one weighted least-squares fit per target."""
    n, out = len(y), []
    for a in at:
        q = min(span, n)
        start = int(np.clip(a - (q - 1) // 2, 0, n - q))
        idx = np.arange(start, start + q)
        d = np.abs(idx - a)
        h = d.max() + max(span - n, 0) // 2
        w = np.sqrt(np.where(d <= 0.001 * h, 1, np.where(d <= 0.999 * h, (1 - (d / h) ** 3) ** 3, 0)) * rho[idx])
        design = np.stack([np.ones(q), idx - a], 1)
        out.append(np.linalg.lstsq(w[:, None] * design, w * y[idx], rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("span", [5, 41, 149, 301, 401])
def test_long_smoother_against_definition(span):
    rng = np.random.default_rng(2)
    y, rho = rng.normal(size=300), rng.uniform(0.2, 1, 300)
    got = L.smooth_long(L.long_kernels(300, span), y, rho)
    np.testing.assert_allclose(got, brute(y, rho, span, range(300)), atol=1e-9)


def test_short_smoother_extends_both_ends():
    rng = np.random.default_rng(3)
    y, rho, at = rng.normal(size=(2, 9)), rng.uniform(0.2, 1, (2, 9)), np.arange(-1.0, 10)
    got = L.smooth_rows(L._moments(9, 7, at), y, rho)
    for i in range(2):
        np.testing.assert_allclose(got[i], brute(y[i], rho[i], 7, at), atol=1e-9)


def test_stl_recovers_parts_despite_outliers():
    t = np.arange(400)
    season = np.array([5, 3, 0, -1, -2, -4, -1.0])[t % 7]
    clean = 100 + 0.5 * t + season + np.random.default_rng(6).normal(0, 1, 400)
    spoiled = clean.copy()
    spoiled[[50, 200, 333]] += 20
    trend, seasonal = L.stl(clean, 7)
    assert np.abs(trend - (100 + 0.5 * t)).max() < 2 and np.abs(seasonal - season).max() < 2.5
    robust_trend, robust_seasonal = L.stl(spoiled, 7)
    assert np.abs(robust_trend - trend).max() < 1 and np.abs(robust_seasonal - seasonal).max() < 1.5


def test_decompose_loess_many_series(spark):
    values = [int(1000 + 3 * i + 50 * ((i % 7) < 5)) for i in range(100)]
    df = daily(spark, values, "a").unionByName(daily(spark, values[:50], "b")).unionByName(daily(spark, values[:5], "c"))
    out = L.decompose_loess(df, 30).toPandas()
    np.testing.assert_allclose(out["trend"] + out["seasonal"] + out["residual"], out["original"])
    assert out.groupby("series")["period"].first().to_dict() == {"a": 30, "b": 7, "c": 7}
    assert len(out) == 155
