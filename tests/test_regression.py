import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridemill.functions import tails
from ridemill.operators import regression as X
from ridemill.session import stage
from ridemill.sources import dimensions as D

DAY = dt.date
NAMES = X.FEATURES


def months(n, start=2013):
    return [DAY(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def series(spark, sets):
    data = [(name, d, int(v)) for name, values in sets.items() for d, v in zip(months(len(values)), values)]
    return spark.createDataFrame(data, "series string, ds date, y long")


def noisy(n, seed, treat=132):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    e = np.convolve(rng.normal(0, 2e6, n + 3), np.ones(4), "valid")
    return 2e8 + 3e5 * t + 1e7 * np.sin(t * np.pi / 6) - 2e7 * (t >= treat) - 5e5 * np.maximum(t - treat, 0) + e


@pytest.fixture(scope="module")
def case(spark):
    sets = {"TREN": noisy(150, 1), "COLECTIVO": noisy(150, 2), "SHORT": noisy(134, 3)}
    features = X.enough_after(X.its_features(series(spark, sets))).cache()
    fit = X.its_fit(features).cache()
    return sets, features, fit


def design(features, name):
    pdf = features.filter(f"series = '{name}'").orderBy("ds").toPandas()
    x = np.stack([np.ones(len(pdf)) if c == "const" else pdf[c].to_numpy(float) for c in NAMES], 1)
    return x, pdf["y"].to_numpy(float), pdf


def test_features(case):
    _, features, _ = case
    _, _, pdf = design(features, "TREN")
    assert list(pdf["t"]) == list(range(150))
    assert pdf["D"].sum() == 18 and list(pdf["t_post"][-18:]) == list(range(18)) and (pdf["t_post"][:132] == 0).all()
    assert pdf["covid"].sum() == 22
    assert (pdf[[f"m_{m}" for m in range(2, 13)]].sum(axis=1) == (pdf["ds"].map(lambda d: d.month) > 1)).all()


def test_too_few_treated_months_are_skipped(case):
    assert {r.series for r in case[2].collect()} == {"TREN", "COLECTIVO"}


def test_coefficients_equal_lstsq(case):
    _, features, fit = case
    for row in fit.collect():
        x, y, _ = design(features, row.series)
        np.testing.assert_allclose(row.beta, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-6)
        assert row["rank"] == 16


def newey_west(x, e, lags):
    n, k = x.shape
    s = x * e[:, None]
    middle = s.T @ s
    for lag in range(1, lags + 1):
        a = s[lag:].T @ s[:-lag]
        middle += (1 - lag / (lags + 1)) * (a + a.T)
    bread = np.linalg.inv(x.T @ x)
    return bread @ middle @ bread * n / (n - k)


def test_inference_equals_explicit_formulas(case):
    _, features, fit = case
    out = {r.series: r for r in X.its_inference(features, fit).collect()}
    for name, row in out.items():
        x, y, pdf = design(features, name)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        robust = name == "TREN"
        assert row.se_type == ("HAC-12" if robust else "OLS")
        v = newey_west(x, e, 12) if robust else np.linalg.inv(x.T @ x) * (e @ e) / (len(y) - 16)
        for term, j in (("level", X.LEVEL), ("slope", X.SLOPE)):
            se = math.sqrt(v[j, j])
            assert row[f"beta_{term}_se"] == pytest.approx(se, rel=1e-6)
            z = beta[j] / se
            p = plain_normal_p(z) if robust else plain_student_p(z, len(y) - 16)
            assert row[f"pvalue_{term}"] == pytest.approx(p, rel=1e-4, abs=1e-12)
            width = 1.959963984540054 if robust else 1.977825758
            assert row[f"ci_{term}_hi"] == pytest.approx(beta[j] + width * se, rel=1e-6)
        assert row.r2 == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum(), rel=1e-9)
        assert (row.n_obs, row.n_post, row.train_start) == (150, 18, DAY(2013, 1, 1))
        assert row.pre_mean == pytest.approx(y[:132].mean())


def test_counterfactual_identities(case):
    _, features, fit = case
    out = X.counterfactual(features, fit).toPandas()
    np.testing.assert_allclose(out["gap"], out["actual"] - out["counterfactual"])
    before = out[out["post"] == 0]
    np.testing.assert_allclose(before["fitted"], before["counterfactual"])
    assert len(out) == 300


def test_effect_and_metrics(spark, case):
    _, features, fit = case
    inference = X.its_inference(features, fit)
    hikes = D.fare_hikes(spark)
    row = {r.series: r for r in X.its_effect(inference, hikes).collect()}["TREN"]
    assert row.initial_hike_pct == pytest.approx(140.7)
    assert row.pct_level_change == pytest.approx(row.beta_level / row.pre_mean * 100)
    assert row.implied_elasticity == pytest.approx(row.pct_level_change / 140.7 * 10)
    projection = X.counterfactual(features, fit)
    metrics = {r.series: r for r in X.its_metrics(projection, inference).collect()}["TREN"]
    pdf = projection.filter("series = 'TREN' AND post = 1").orderBy("ds").toPandas()
    assert metrics.cumulative_gap == pytest.approx((pdf["counterfactual"] - pdf["actual"]).sum())
    last = pdf.iloc[-1]
    assert metrics.latest_gap_pct == pytest.approx((last["counterfactual"] - last["actual"]) / last["counterfactual"] * 100)
    expected = "flat" if row.pvalue_slope >= 0.05 else "falling" if row.beta_slope < 0 else "rising"
    assert metrics.drift == expected


def test_constant_columns_are_left_out(spark):
    """Ten months: most month dummies and the special flag never vary."""
    rng = np.random.default_rng(5)
    y = 1e6 + 1e4 * np.arange(10) + rng.normal(0, 1e3, 10)
    data = [("x", DAY(2023, 6 + i, 1) if i < 7 else DAY(2024, i - 6, 1), int(v)) for i, v in enumerate(y)]
    features = X.its_features(spark.createDataFrame(data, "series string, ds date, y long"), DAY(2024, 1, 1))
    row = X.its_fit(features).first()
    x, target, _ = design(features, "x")
    assert row["rank"] == np.linalg.matrix_rank(x)
    np.testing.assert_allclose(x @ np.array(row.beta), x @ np.linalg.lstsq(x, target, rcond=None)[0], rtol=1e-6)


def plain_normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h
    raise ArithmeticError(f"the incomplete beta function at {a}, {b}, {x} does not converge")


def plain_student_p(t: float, df: float) -> float:
    """P(|T| > |t|) as a regularized incomplete beta at df / (df + t²)."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def plain_critical(p_of, level: float = 0.05) -> float:
    """The value whose two-sided tail is ``level``, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if p_of(mid) > level else (low, mid)
    return (low + high) / 2


def test_tail_columns_equal_the_incomplete_beta(spark):
    points = [(t, df) for df in (1, 2, 3, 4, 5, 10, 29, 30, 134, 1000) for t in (0.0, -0.3, 1.0, 1.96, -2.5, 4.0, 7.0)]
    out = spark.createDataFrame(points, "t double, df int").select(
        "t", "df", tails.student_p(F.col("t"), F.col("df")).alias("student"), tails.normal_p(F.col("t") * 2).alias("normal"))
    for row in out.collect():
        assert row.student == pytest.approx(plain_student_p(row.t, row.df), rel=1e-9, abs=1e-13)
        assert row.normal == pytest.approx(plain_normal_p(2 * row.t), rel=1e-12, abs=1e-15)


def test_critical_values(spark):
    tabulated = {10: 2.228138852, 134: 1.977825758, 1: 12.70620474, 30: 2.042272456, 2: 4.30265273}
    out = spark.createDataFrame([(k,) for k in tabulated], "df int").select("df", tails.student_critical(F.col("df")).alias("t"))
    assert {r.df: r.t for r in out.collect()} == pytest.approx(tabulated, rel=1e-8)
    assert tails.NORMAL_CRITICAL == pytest.approx(plain_critical(plain_normal_p), rel=1e-12)


def test_inference_needs_no_python(spark, case):
    _, features, fit = case
    fitted = stage(fit, "fit")
    plan = X.its_inference(stage(features, "features"), fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
