"""SQL of the inference and forecast queries: elimination, integration and bisection in the shared tables of ``oracles``."""

from __future__ import annotations

from ridemill import schema as S
from ridemill.operators import forecasting as FC
from ridemill.operators.regression import FEATURES
from ridemill.plans import testdata as T

K = len(FEATURES)
LAGS = range(1, 13)


def _integral(integrand: str, low: str, high: str, panels: int = 4000) -> str:
    """Simpson's rule; ``integrand`` is in ``{v}``."""
    width = f"(({high}) - ({low})) / {panels}.0"
    weight = f"CASE WHEN i IN (0, {panels}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum(list_transform(generate_series(0, {panels}), lambda i: ({weight}) * {integrand.format(v=f'(({low}) + i * {width})')})) * {width} / 3"


def _student(t: str, df: str) -> str:
    area = _integral("power(cos({v}), " + df + " - 1)", f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
    return f"(2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {area})"


def _normal(z: str) -> str:
    return f"(2 / sqrt(2 * pi()) * {_integral('exp(-{v} * {v} / 2)', f'abs({z})', f'abs({z}) + 12')})"


def _term(n: str) -> str:
    stars = f"CASE WHEN pvalue_{n} < 0.001 THEN '***' WHEN pvalue_{n} < 0.01 THEN '**' WHEN pvalue_{n} < 0.05 THEN '*' ELSE '' END"
    return (f"ROUND(beta_{n}, 4) AS beta_{n}, ROUND(beta_{n}_se, 4) AS beta_{n}_se, ROUND(pvalue_{n}, 8) AS pvalue_{n}, "
            f"ROUND(beta_{n} - width * beta_{n}_se, 4) AS ci_{n}_lo, ROUND(beta_{n} + width * beta_{n}_se, 4) AS ci_{n}_hi, {stars} AS stars_{n}")


def _tail(n: str) -> str:
    ratio = f"beta_{n} / beta_{n}_se"
    return f"CASE WHEN hac THEN {_normal(ratio)} ELSE {_student(ratio, 'df')} END AS pvalue_{n}"


INFERENCE = f"""
WITH fits AS (
  SELECT series, COUNT(*) AS n_obs, MIN(ds) AS train_start, CAST(SUM(D) AS BIGINT) AS n_post, AVG(y) FILTER (D = 0) AS pre_mean,
         SUM(e * e) AS sse, VAR_POP(y) * COUNT(*) AS sst, ANY_VALUE(beta[3]) AS beta_level, ANY_VALUE(beta[4]) AS beta_slope,
         ANY_VALUE(inv_level[3]) AS var_level, ANY_VALUE(inv_slope[4]) AS var_slope, COUNT(*) - {K} AS df,
         series IN ('2-HIGH', '3-MEDIUM') AS hac FROM projected GROUP BY series),
critical(df, i, low, high) AS (
  SELECT DISTINCT df, 0, 0.0::DOUBLE, 100.0::DOUBLE FROM fits UNION ALL
  SELECT df, i + 1, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END
  FROM (SELECT df, i, low, high, mid, {_student("mid", "df")} AS p FROM (SELECT *, (low + high) / 2 AS mid FROM critical WHERE i < 50))),
errors_of AS (
  SELECT f.*, 1 - sse / sst AS r2, CASE WHEN hac THEN r.beta_level_se ELSE SQRT(var_level * sse / f.df) END AS beta_level_se,
         CASE WHEN hac THEN r.beta_slope_se ELSE SQRT(var_slope * sse / f.df) END AS beta_slope_se,
         CASE WHEN hac THEN 1.959963984540054 ELSE low END AS width
  FROM fits f JOIN robust r ON f.series = r.series JOIN critical c ON c.df = f.df AND c.i = 50),
inferred AS (SELECT *, {_tail("level")}, {_tail("slope")} FROM errors_of),
inference AS (
  SELECT series, n_obs, train_start, n_post, pre_mean AS raw_pre_mean, beta_level AS raw_level, ROUND(pre_mean, 6) AS pre_mean,
         CASE WHEN hac THEN 'HAC-12' ELSE 'OLS' END AS se_type, ROUND(r2, 8) AS r2, {_term("level")}, {_term("slope")}
  FROM inferred)"""


def _ridge() -> str:
    """The forecast by elimination of the penalised normal equations."""
    breaks = sorted({r[0] for r in T.HIKE_ROWS} | {r[0] for r in T.EVENT_ROWS if r[3] in S.SHOCK_COLORS})
    first_hinge, k = FC.HINGES_FROM + 1, FC.HINGES_FROM + len(breaks)
    hinges = range(first_hinge, k + 1)
    start = " ".join(f"WHEN '{name}' THEN " + ("TRUE" if day is None else f"ds >= DATE '{day}'") for name, day in T.STARTS.items())
    scale = " ".join(f"WHEN '{name}' THEN {value}" for name, value in T.FLEXIBILITY.items())
    shock = min(r[0] for r in T.EVENT_ROWS if r[3] in S.SHOCK_COLORS)

    def standard(c: str) -> str:
        known = f"CASE WHEN NOT is_forecast THEN {c} END"
        return f"COALESCE(({c} - AVG({known}) OVER w) / NULLIF(STDDEV_SAMP({known}) OVER w, 0), 0)"

    x = ["1", "days / span", "covid", "macro", "fare", "recovery", *(f"(month(ds) = {m})::INT" for m in range(2, 13)),
         *(f"CASE WHEN DATE '{d}' >= first AND DATE '{d}' < last THEN GREATEST(date_diff('day', DATE '{d}', ds), 0) / span ELSE 0 END" for d in breaks)]

    def row(i: int) -> str:
        penalty = "0" if i == 1 else f"{FC.HINGE_NOISE} / ANY_VALUE(scale * scale)" if i in hinges else f"{FC.BASE_PENALTY}"
        gram = [f"SUM(x[{i}] * x[{j}])" for j in range(1, k + 1)]
        system = [g + (f" + {penalty}" if j == i else "") for j, g in enumerate(gram, 1)]
        return "[" + ", ".join([*system, f"SUM(x[{i}] * z)", *gram]) + "]"

    active = [f"s.m[{i}][{k + 1 + i}] > 0" for i in hinges]
    levels = ", ".join(f"CASE WHEN is_forecast THEN GREATEST(EXP({v}) - shift, low * 0.5) ELSE EXP({v}) - shift END AS {n}"
                       for v, n in (("eta", "yhat"), ("eta - spread", "yhat_lower"), ("eta + spread", "yhat_upper")))
    return f"""
WITH trained AS (
  SELECT * FROM (SELECT modo AS series, month_start AS ds, total_usos AS y, COUNT(*) OVER (PARTITION BY modo) AS n FROM monthly)
  WHERE n >= 24 AND CASE series {start} ELSE ds >= DATE '{T.BASE_MONTH}' END),
months_of AS (
  SELECT series, ds, y, FALSE AS is_forecast FROM trained UNION ALL
  SELECT series, CAST(UNNEST(generate_series(MAX(ds) + INTERVAL 1 MONTH, MAX(ds) + INTERVAL {S.FORECAST_MONTHS} MONTH, INTERVAL 1 MONTH)) AS DATE), NULL, TRUE
  FROM trained GROUP BY series),
regressors AS (
  SELECT *, (ds >= DATE '{shock}')::INT AS macro, (ds BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}')::INT AS covid,
         CAST(COALESCE((SELECT SUM(magnitude) FROM hikes h WHERE h.date <= m.ds), 0) AS DOUBLE) AS pressure,
         LN(1 + GREATEST(0, (year(ds) - {T.REOPENING.year}) * 12 + month(ds) - {T.REOPENING.month})) AS since
  FROM months_of m),
spans AS (
  SELECT *, date_diff('day', first, ds) AS days, CAST(GREATEST(date_diff('day', first, last), 1) AS DOUBLE) AS span,
         CASE WHEN low <= 0 THEN 1 - low ELSE 0 END AS shift, CAST(CASE series {scale} ELSE {S.TREND_FLEXIBILITY_DEFAULT} END AS DOUBLE) AS scale
  FROM (SELECT *, MIN(CASE WHEN NOT is_forecast THEN ds END) OVER w AS first, MAX(CASE WHEN NOT is_forecast THEN ds END) OVER w AS last,
               CAST(MIN(y) OVER w AS DOUBLE) AS low, {standard("pressure")} AS fare, {standard("since")} AS recovery
        FROM regressors WINDOW w AS (PARTITION BY series))),
vectors AS (
  SELECT *, CAST([{", ".join(x)}] AS DOUBLE[]) AS x, CASE WHEN NOT is_forecast THEN LN(CAST(y AS DOUBLE) + shift) END AS z,
         GREATEST((year(ds) - year(last)) * 12 + month(ds) - month(last), 0) AS h, span / {FC.MONTH_LENGTH} AS months FROM spans),
ridge_system AS (
  SELECT series, [{", ".join(row(i) for i in range(1, k + 1))}] AS m, COUNT(*) AS n, ANY_VALUE(months) AS months FROM vectors WHERE NOT is_forecast GROUP BY series),
ridge(series, k, m) AS (
  SELECT series, 1, m FROM ridge_system UNION ALL
  SELECT series, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
           THEN list_transform(r, lambda v: v / m[k][k])
           ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
  FROM ridge WHERE k <= {k}),
betas AS (
  SELECT r.series, list_transform(r.m, lambda q: q[{k + 1}]) AS beta, list_sum(list_transform(r.m, lambda q, i: q[{k + 1} + i])) AS used, n, months,
         {" + ".join(f"({a})::INT" for a in active)} AS n_active,
         {" + ".join(f"CASE WHEN {a} THEN abs(r.m[{i}][{k + 1}]) ELSE 0 END" for i, a in zip(hinges, active))} AS slopes
  FROM ridge r JOIN ridge_system s ON r.series = s.series WHERE r.k = {k + 1}),
noises AS (
  SELECT b.series, SUM((z - list_dot_product(beta, x)) * (z - list_dot_product(beta, x))) / ANY_VALUE(GREATEST(n - used, 1)) AS noise
  FROM betas b JOIN vectors v ON b.series = v.series WHERE NOT is_forecast GROUP BY b.series),
bands AS (
  SELECT v.*, list_dot_product(beta, x) AS eta,
         beta[1] + beta[2] * x[2] + list_dot_product(beta[{first_hinge}:], x[{first_hinge}:]) AS line,
         SQRT(noise + CASE WHEN n_active = 0 THEN 0 ELSE 2 * POWER(slopes / n_active / b.months, 2) * n_active / b.months END * h * (h + 1) * (2 * h + 1) / 6) * {FC.BAND_Z} AS spread
  FROM vectors v JOIN betas b ON v.series = b.series JOIN noises e ON v.series = e.series),
forecasts AS (SELECT series, ds, {levels}, EXP(line) - shift AS trend, is_forecast, CAST(y AS DOUBLE) AS actual FROM bands)"""


FORECAST = _ridge()
POST = f"ds > DATE '{T.SPECIAL[1]}'"

SQL: dict[str, str] = {
    "its_inference": INFERENCE + "SELECT * EXCLUDE (raw_pre_mean, raw_level) FROM inference",
    "its_effect": INFERENCE + f"""
SELECT i.* EXCLUDE (raw_pre_mean, raw_level), ROUND(pct, 6) AS initial_hike_pct, ROUND(raw_level / raw_pre_mean * 100, 6) AS pct_level_change,
       ROUND(raw_level / raw_pre_mean * 100 / pct * 10, 6) AS implied_elasticity, CAST({S.ELASTICITY_BENCHMARK} AS DOUBLE) AS wb_elasticity
FROM inference i, (SELECT (COALESCE(product(1 + magnitude / 100.0), 1) - 1) * 100 AS pct FROM hikes
  WHERE date > DATE '{T.SHOCK[0]}' AND date <= DATE '{T.SHOCK[1]}' AND scope IN ('national','amba','amba_local') AND magnitude > 0)""",
    "its_metrics": INFERENCE + f"""
SELECT i.series, cumulative_gap, latest_gap_pct, beta_slope, pvalue_slope,
       CASE WHEN COALESCE(pvalue_slope, 1) >= {S.SIGNIFICANCE} THEN 'flat' WHEN beta_slope < 0 THEN 'falling' ELSE 'rising' END AS drift
FROM inference i JOIN (
  SELECT series, ROUND(SUM(without - y), 4) AS cumulative_gap, ROUND(arg_max((without - y) / without * 100, ds), 6) AS latest_gap_pct
  FROM (SELECT *, fitted - beta[3] * D - beta[4] * t_post AS without FROM projected) WHERE D = 1 GROUP BY series) g ON i.series = g.series""",
    "forecast": FORECAST + """
SELECT series, ds, ROUND(yhat, 2) AS yhat, ROUND(yhat_lower, 2) AS yhat_lower, ROUND(yhat_upper, 2) AS yhat_upper, ROUND(trend, 2) AS trend,
       0.0::DOUBLE AS additive_terms, is_forecast, actual FROM forecasts""",
    "diagnostics": FORECAST + f""",
rel AS (SELECT series, ds, actual, yhat, ABS((actual - yhat) / NULLIF(actual, 0)) * 100 AS e FROM forecasts WHERE NOT is_forecast),
measured AS (
  SELECT series, COUNT(*) AS n_train, MIN(ds) AS train_start, MAX(ds) AS train_end, AVG(e) AS mape, SQRT(AVG((actual - yhat) * (actual - yhat))) AS rmse,
         AVG(ABS(actual - yhat)) AS mae, AVG(e) FILTER (ds < DATE '{T.SPECIAL[0]}') AS mape_pre,
         AVG(e) FILTER (ds BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}') AS mape_covid, AVG(e) FILTER ({POST}) AS mape_post
  FROM rel GROUP BY series),
left_over AS (
  SELECT series, ds, r - AVG(r) OVER (PARTITION BY series) AS e FROM (
    SELECT series, ds, actual - yhat AS r, COUNT(*) FILTER ({POST}) OVER (PARTITION BY series) AS n_after FROM rel)
  WHERE {POST} OR n_after < 12),
shifted AS (SELECT series, e, {", ".join(f"LAG(e, {k}) OVER w AS l{k}" for k in LAGS)} FROM left_over WINDOW w AS (PARTITION BY series ORDER BY ds)),
lag_sum AS (SELECT series, COUNT(*) AS n, SUM(e * e) AS s0, {", ".join(f"SUM(e * l{k}) AS s{k}" for k in LAGS)} FROM shifted GROUP BY series),
boxed AS (
  SELECT series, q, EXP(-q / 2) * (1 + q / 2 + POWER(q / 2, 2) / 2 + POWER(q / 2, 3) / 6 + POWER(q / 2, 4) / 24 + POWER(q / 2, 5) / 120) AS p
  FROM (SELECT series, n * (n + 2.0) * ({" + ".join(f"(s{k} / s0) * (s{k} / s0) / (n - {k})" for k in LAGS)}) AS q FROM lag_sum))
SELECT m.series, n_train, train_start, train_end, ROUND(mape, 2) AS mape, ROUND(rmse, 0) AS rmse, ROUND(mae, 0) AS mae, ROUND(mape_pre, 2) AS mape_pre,
       ROUND(mape_covid, 2) AS mape_covid, ROUND(mape_post, 2) AS mape_post, ROUND(q, 6) AS lb_stat, ROUND(p, 6) AS lb_pvalue, p < {S.SIGNIFICANCE} AS autocorrelated,
       CASE WHEN COALESCE(mape_post, mape) <= {S.MAPE_GOOD} THEN 'good' WHEN COALESCE(mape_post, mape) <= {S.MAPE_ACCEPTABLE} THEN 'acceptable' ELSE 'poor' END AS verdict,
       CASE WHEN m.series = 'TREN' AND mape_pre > 12 THEN 'weaker fit before the special period: effect estimates carry more uncertainty' END AS its_note
FROM measured m JOIN boxed b ON m.series = b.series""",
}
