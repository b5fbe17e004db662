import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridemill.functions import numeric as N
from ridemill.operators import diagnostics as G
from ridemill.operators import forecasting as FC
from ridemill.sources import dimensions as D

DAY = dt.date


def frame(spark, sets, start=2018):
    data = [(name, DAY(start + i // 12, i % 12 + 1, 1), int(v)) for name, values in sets.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "series string, ds date, y long")


def dims(spark):
    return D.fare_hikes(spark), D.events(spark)


@pytest.fixture(scope="module")
def result(spark):
    rng = np.random.default_rng(0)
    t = np.arange(84)
    good = 1e6 * np.exp(0.004 * t + 0.2 * np.sin(t * np.pi / 6) + rng.normal(0, 0.01, 84))
    zero = np.where(t % 12 == 5, 0, 1000 + t)
    fc = FC.forecast(frame(spark, {"TREN": good, "SHORT": good[:20], "ZERO": zero}), *dims(spark))
    return good, fc.cache()


def test_horizon_and_minimum_history(result):
    _, fc = result
    counts = {r["series"]: r["n"] for r in fc.groupBy("series").agg(F.count_if("is_forecast").alias("n")).collect()}
    assert counts == {"TREN": 6, "ZERO": 6}
    ahead = [r.ds for r in fc.filter("series = 'TREN' AND is_forecast").orderBy("ds").collect()]
    assert ahead == [DAY(2025, m, 1) for m in range(1, 7)]
    assert fc.filter("is_forecast AND actual IS NOT NULL").count() == 0
    assert fc.filter("NOT is_forecast AND actual IS NULL").count() == 0


def test_fit_and_projection(result):
    good, fc = result
    pdf = fc.filter("series = 'TREN'").orderBy("ds").toPandas()
    past = pdf[~pdf["is_forecast"]]
    assert (abs(past["yhat"] / past["actual"] - 1)).mean() < 0.02
    t = np.arange(84, 90)
    truth = 1e6 * np.exp(0.004 * t + 0.2 * np.sin(t * np.pi / 6))
    ahead = pdf[pdf["is_forecast"]]
    assert (abs(ahead["yhat"] / truth - 1)).max() < 0.15
    assert (ahead["yhat_lower"] <= ahead["yhat"]).all() and (ahead["yhat"] <= ahead["yhat_upper"]).all()
    width = np.log(ahead["yhat_upper"] / ahead["yhat_lower"]).to_numpy()
    assert (np.diff(width) >= -1e-12).all()


def test_floor_on_future_rows_only(spark, result):
    _, fc = result
    low = fc.filter("series = 'ZERO' AND is_forecast AND yhat_lower < 0").count()
    assert low == 0
    falling = 1e6 * np.exp(-0.3 * np.arange(36))
    out = FC.forecast(frame(spark, {"X": np.maximum(falling, 50)}), *dims(spark))
    assert out.filter("is_forecast").agg(F.min("yhat_lower")).first()[0] >= 25


def test_training_start(spark, rows):
    df = frame(spark, {"COLECTIVO": [1] * 60, "TREN": [1] * 60}, 2013)
    out = FC.training_rows(df, {"COLECTIVO": DAY(2013, 1, 1)}, DAY(2016, 1, 1))
    assert rows(out.groupBy("series").agg(F.min("ds"))) == [("COLECTIVO", DAY(2013, 1, 1)), ("TREN", DAY(2016, 1, 1))]


def test_floor_and_regressors(spark, rows):
    df = frame(spark, {"a": [500000, 900000]})
    assert rows(FC.floor_by_series(df)) == [("a", 250000.0)]
    days = spark.createDataFrame([(DAY(2020, 2, 1),), (DAY(2020, 3, 1),), (DAY(2021, 12, 1),), (DAY(2022, 1, 1),), (DAY(2022, 2, 1),), (DAY(2023, 1, 1),)], "ds date")
    flags = [r[0] for r in days.orderBy("ds").select(N.window_flag(F.col("ds"), DAY(2020, 3, 1), DAY(2021, 12, 1))).collect()]
    assert flags == [0, 1, 1, 0, 0, 0]
    momentum = [r[0] for r in days.orderBy("ds").select(N.momentum(F.col("ds"), DAY(2022, 1, 1))).collect()]
    np.testing.assert_allclose(momentum, [0, 0, 0, 0, math.log(2), math.log(13)])


@pytest.mark.parametrize("ahead,direction", [(110.0, "up"), (90.0, "down"), (104.0, "flat"), (105.0, "flat"), (95.0, "flat")])
def test_summary_direction(spark, ahead, direction):
    data = [("s", DAY(2024, m, 1), 0.0, 100.0, False) for m in range(1, 9)] + [("s", DAY(2024, 9, 1), ahead, None, True), ("only_past", DAY(2024, 1, 1), 1.0, 1.0, False)]
    out = FC.forecast_summary(spark.createDataFrame(data, "series string, ds date, yhat double, actual double, is_forecast boolean"))
    got = out.collect()
    assert [(r.series, r.direction, r.pct_change, r.last_actual) for r in got] == [("s", direction, ahead - 100, 100.0)]


def test_joined_line_starts_at_last_fit(result):
    _, fc = result
    line = FC.forecast_joined(fc).filter("series = 'TREN'").orderBy("ds").collect()
    assert len(line) == 7 and line[0].ds == DAY(2024, 12, 1)


def test_error_measures(spark):
    df = spark.createDataFrame([("s", DAY(2019, 1, 1), 100.0, 90.0), ("s", DAY(2020, 6, 1), 0.0, 5.0), ("s", DAY(2022, 1, 1), 50.0, 60.0)],
                               "series string, ds date, actual double, yhat double")
    row = G.forecast_errors(df).first()
    assert row.mape == pytest.approx(15.0) and row.rmse == pytest.approx(math.sqrt(225 / 3)) and row.mae == pytest.approx(25 / 3)
    split = G.errors_by_period(df).first()
    assert (split.mape_pre, split.mape_covid, split.mape_post) == (pytest.approx(10.0), None, pytest.approx(20.0))


def test_ljung_box(spark):
    rng = np.random.default_rng(4)
    e = np.convolve(rng.normal(size=83), np.ones(4), "valid")
    df = spark.createDataFrame([("s", DAY(2010 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(e)], "series string, ds date, residual double")
    row = G.ljung_box(df).first()
    c = e - e.mean()
    r = [(c[k:] @ c[:-k]) / (c @ c) for k in range(1, 13)]
    q = 80 * 82 * sum(v * v / (80 - k) for k, v in enumerate(r, 1))
    assert row.lb_stat == pytest.approx(q)
    assert row.autocorrelated
    exact = spark.range(1).select(N.chi2_tail_even(F.lit(21.02606981748307), 12)).first()[0]
    assert exact == pytest.approx(0.05, rel=1e-9)


def test_diagnostics_table(result):
    _, fc = result
    row = {r.series: r for r in G.diagnostics(fc).collect()}["TREN"]
    assert row.n_train == 84 and row.verdict == "good" and row.its_note is None
    assert (row.train_start, row.train_end) == (DAY(2018, 1, 1), DAY(2024, 12, 1))


def test_verdicts(spark, rows):
    df = spark.createDataFrame([("a", 5.0, True), ("b", 5.1, False), ("c", 12.0, None), ("d", 12.1, True)], "series string, m double, autocorrelated boolean")
    table = df.withColumn("verdict", G.verdict(F.col("m")))
    assert rows(table, "series", "verdict") == [("a", "good"), ("b", "acceptable"), ("c", "acceptable"), ("d", "poor")]
    assert rows(G.verdict_summary(table)) == [("acceptable", 2, 0), ("good", 1, 1), ("poor", 1, 1)]
    assert G.verdict_members(table).count() == 4


def test_rounding_is_scale_round_unscale(spark):
    values = [1.005, 8.325, -2.345, 2.5, -2.5, 0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(N.sql_round(F.col("v"), 2)).collect()]
    assert got == [math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v) for v in values]


def test_ridge_equals_the_solved_system_of_the_rows(spark):
    """Coefficients and noise from summed products are those of the rows themselves."""
    rng = np.random.default_rng(2)
    k = FC.HINGES_FROM + 2
    data, rows = {}, []
    for name, n in (("TREN", 60), ("X", 40)):
        x = np.concatenate([np.ones((n, 1)), rng.random((n, k - 1))], axis=1)
        y = np.exp(x @ rng.normal(0, 0.3, k) + rng.normal(0, 0.05, n) + 5)
        data[name] = x, np.log(y)
        rows += [(name, v.tolist(), float(t), False, 0.0, float(n)) for v, t in zip(x, y)]
    features = spark.createDataFrame(rows, "series string, x array<double>, y double, is_forecast boolean, _shift double, _months double").repartition(3)
    fitted = {r.series: r for r in FC.fit_ridge(features, {"TREN": 0.1}, 0.05).collect()}
    for name, (x, z) in data.items():
        penalty = np.full(k, FC.BASE_PENALTY)
        penalty[0], penalty[FC.HINGES_FROM:] = 0, FC.HINGE_NOISE / (0.1 if name == "TREN" else 0.05) ** 2
        system = x.T @ x + np.diag(penalty)
        beta = np.linalg.solve(system, x.T @ z)
        used = np.trace(np.linalg.solve(system, x.T @ x))
        np.testing.assert_allclose(fitted[name].beta, beta, rtol=1e-6, atol=1e-9)
        assert fitted[name].noise == pytest.approx(((z - x @ beta) ** 2).sum() / (len(z) - used), rel=1e-6)
        slopes = np.abs(beta[FC.HINGES_FROM:]) / len(z)
        assert fitted[name].drift == pytest.approx(2 * slopes.mean() ** 2 * 2 / len(z), rel=1e-6)
