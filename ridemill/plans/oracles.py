"""Equivalent SQL for the registered queries, over the same tables.

``PRELUDE`` holds the shared derivations as common table expressions; each entry of
``SQL`` is the statement that follows it.
"""

from __future__ import annotations

from ridemill import schema as S
from ridemill.operators.regression import FEATURES
from ridemill.plans import fit_oracles
from ridemill.plans import testdata as T


def _values(rows: list[tuple]) -> str:
    def literal(v: object) -> str:
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join(
        f"({i}, DATE '{r[0]}', {', '.join(literal(v) for v in r[1:])})" for i, r in enumerate(rows))


def _in(items) -> str:
    return "(" + ", ".join(f"'{m}'" for m in items) + ")"


M3 = _in(T.MODES3)
K = len(FEATURES)
LAGGED_L = " + ".join(f"(1 - {k} / 13.0) * COALESCE(LAG(ul, {k}) OVER w, 0)" for k in range(1, 13))
LAGGED_S = " + ".join(f"(1 - {k} / 13.0) * COALESCE(LAG(us, {k}) OVER w, 0)" for k in range(1, 13))

PRELUDE = f"""
WITH RECURSIVE rows_in AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week,
         o_orderpriority AS modo, CAST(l_quantity AS BIGINT) - 1 AS cantidad_usos,
         s_name AS nombre_empresa, p_brand AS linea,
         CASE WHEN r_name IN ('AMERICA','EUROPE') THEN 'SI' WHEN r_name IN ('ASIA','AFRICA') THEN 'NO' ELSE 'UNKNOWN' END AS amba,
         r_name AS jurisdiccion, n_name AS provincia, c_mktsegment AS municipio,
         CASE WHEN l_linestatus = 'O' THEN 'S' ELSE 'N' END AS dato_preliminar,
         concat('f-', CAST(year(l_shipdate) AS VARCHAR)) AS source_file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
spread AS (
  SELECT source_file, modo, AVG(cantidad_usos) AS mean, STDDEV_SAMP(cantidad_usos) AS std FROM rows_in GROUP BY 1, 2),
flagged AS (
  SELECT r.*, (cantidad_usos = 0 AND day_of_week < 5)
         OR COALESCE(std > 0 AND (cantidad_usos > mean + 4 * std OR cantidad_usos < mean - 4 * std), FALSE) AS is_suspicious
  FROM rows_in r JOIN spread s ON r.source_file = s.source_file AND r.modo = s.modo),
daily AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY fecha, modo, nombre_empresa, linea
                                 ORDER BY source_file, cantidad_usos, municipio, dato_preliminar) AS rn FROM flagged)
  WHERE rn = 1),
monthly AS (
  SELECT CAST(DATE_TRUNC('month', fecha) AS DATE) AS month_start, year, month, modo,
         CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos, AVG(cantidad_usos) AS avg_daily_usos,
         COUNT(DISTINCT fecha) AS days_with_data, CAST(SUM(is_suspicious::INT) AS BIGINT) AS suspicious_days
  FROM daily WHERE NOT is_suspicious GROUP BY 1, 2, 3, 4),
by_province AS (
  SELECT CAST(DATE_TRUNC('month', fecha) AS DATE) AS month_start, year, month, modo, provincia, amba,
         CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos, COUNT(DISTINCT fecha) AS days_with_data
  FROM daily WHERE NOT is_suspicious GROUP BY 1, 2, 3, 4, 5, 6),
operators AS (
  SELECT nombre_empresa, modo, CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos,
         COUNT(DISTINCT fecha) AS active_days, COUNT(DISTINCT linea) AS num_lineas
  FROM daily WHERE NOT is_suspicious AND nombre_empresa <> 'UNKNOWN' GROUP BY 1, 2),
total_by_day AS (
  SELECT fecha, year, month, day_of_week, CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos
  FROM daily WHERE NOT is_suspicious GROUP BY 1, 2, 3, 4),
mode_by_day AS (
  SELECT fecha, year, month, day_of_week, modo, CAST(SUM(cantidad_usos) AS BIGINT) AS cantidad_usos
  FROM daily WHERE NOT is_suspicious AND modo IN {M3} GROUP BY 1, 2, 3, 4, 5),
series_by_day AS (
  SELECT modo AS series, fecha AS ds, cantidad_usos AS y FROM mode_by_day
  UNION ALL SELECT 'ALL', fecha, CAST(SUM(cantidad_usos) AS BIGINT) FROM mode_by_day GROUP BY fecha),
span AS (SELECT series, MIN(ds) AS a, MAX(ds) AS z FROM series_by_day GROUP BY 1),
spine AS (SELECT series, CAST(UNNEST(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS ds FROM span),
filled AS (
  SELECT p.series, p.ds, last_value(s.y IGNORE NULLS) OVER (PARTITION BY p.series ORDER BY p.ds
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y, s.y IS NULL AS is_filled
  FROM spine p LEFT JOIN series_by_day s ON p.series = s.series AND p.ds = s.ds),
trended AS (
  SELECT series, ds, y AS original, CASE WHEN n < 730 THEN 7 ELSE 365 END AS period,
         CASE WHEN n < 730 THEN t7 ELSE t365 END AS trend, i
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY series) AS n, ROW_NUMBER() OVER w AS i,
               AVG(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t7,
               AVG(y) OVER (w ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) AS t365
        FROM filled WINDOW w AS (PARTITION BY series ORDER BY ds))),
phased AS (
  SELECT *, (i - 1) % period AS phase, AVG(original - trend) OVER (PARTITION BY series, (i - 1) % period) AS s0 FROM trended),
levels AS (SELECT series, AVG(s0) AS level FROM (SELECT DISTINCT series, phase, s0 FROM phased) GROUP BY 1),
parts AS (
  SELECT p.series, ds, period, original, trend, s0 - level AS seasonal, original - trend - (s0 - level) AS residual
  FROM phased p JOIN levels l ON p.series = l.series),
scored AS (
  SELECT series, ds, residual, (residual - AVG(residual) OVER w) / STDDEV_SAMP(residual) OVER w AS z_score
  FROM parts WINDOW w AS (PARTITION BY series)),
ev(seq, date, label_es, label_en, color) AS (VALUES {_values(T.EVENT_ROWS)}),
hikes(seq, date, scope, magnitude) AS (VALUES {_values(T.HIKE_ROWS)}),
hol(seq, date, name_es, name_en, type) AS (VALUES {_values(T.HOLIDAY_ROWS)}),
event_label AS (SELECT date, arg_max(label_en, seq) AS label FROM ev GROUP BY 1),
holiday_name AS (SELECT date, arg_max(name_en, seq) AS name FROM hol GROUP BY 1),
labels_of AS (
  SELECT d.ds,
    CASE WHEN e.label <> '' THEN e.label WHEN h.name IS NOT NULL THEN 'Holiday: ' || h.name
         WHEN b.name IS NOT NULL THEN 'Adjacent holiday (-1d): ' || b.name
         WHEN f.name IS NOT NULL THEN 'Adjacent holiday (+1d): ' || f.name ELSE '' END AS event_label
  FROM (SELECT DISTINCT ds FROM spine) d
  LEFT JOIN event_label e ON e.date = d.ds LEFT JOIN holiday_name h ON h.date = d.ds
  LEFT JOIN holiday_name b ON b.date = d.ds - 1 LEFT JOIN holiday_name f ON f.date = d.ds + 1),
anomaly AS (
  SELECT s.series, s.ds, s.residual, s.z_score, COALESCE(ABS(s.z_score) > 3, FALSE) AS is_anomaly, l.event_label
  FROM scored s JOIN labels_of l ON s.ds = l.ds),
src_a AS (
  SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, o_orderpriority AS modo,
         CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS total_usos, 'a' AS source
  FROM orders GROUP BY 1, 2),
src_b AS (
  SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, o_orderpriority AS modo,
         COUNT(*) * 1000 AS total_usos, 'b' AS source
  FROM orders WHERE o_orderdate >= DATE '{T.BASE_MONTH}' GROUP BY 1, 2),
merged AS (
  SELECT * FROM src_b UNION ALL
  SELECT * FROM src_a a WHERE NOT EXISTS (SELECT 1 FROM src_b b WHERE b.month_start = a.month_start AND b.modo = a.modo)),
hist AS (
  SELECT month_start, CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month, modo,
         total_usos, 'SI' AS amba, 'pre2020' AS era, source
  FROM merged WHERE month_start < DATE '{T.CUT}' AND (modo = '1-URGENT' OR month_start >= DATE '{T.BASE_MONTH}')),
combined AS (
  SELECT month_start, modo, total_usos FROM hist WHERE modo IN {M3}
  UNION ALL SELECT month_start, modo, total_usos FROM monthly WHERE modo IN {M3} AND month_start >= DATE '{T.CUT}'),
region_mode AS (
  SELECT month_start, amba, modo, CAST(SUM(total_usos) AS BIGINT) AS total FROM by_province
  WHERE amba IN ('SI','NO') AND modo IN {M3} GROUP BY 1, 2, 3),
region_total AS (
  SELECT month_start, amba, CAST(SUM(total) AS BIGINT) AS total FROM region_mode GROUP BY 1, 2),
region_ix AS (
  SELECT r.month_start, r.amba, r.total, CASE WHEN b.total > 0 THEN ROUND(100.0 * r.total / b.total, 1) END AS recovery_index
  FROM region_total r LEFT JOIN region_total b ON b.amba = r.amba AND b.month_start = DATE '{T.BASE_MONTH}'),
avg_pre AS (
  SELECT month_start, modo, total_usos, ROUND(CAST(total_usos AS DOUBLE) / day(last_day(month_start)), 0) AS avg_daily
  FROM combined WHERE month_start < DATE '{T.CUT}'),
fc AS (
  SELECT modo AS series, month_start AS ds, month_start > DATE '{T.LAST_KNOWN}' AS is_forecast,
         CAST(COALESCE(LAG(total_usos, 12) OVER (PARTITION BY modo ORDER BY month_start), total_usos) AS DOUBLE) AS yhat,
         CASE WHEN month_start <= DATE '{T.LAST_KNOWN}' THEN CAST(total_usos AS DOUBLE) END AS actual
  FROM monthly),
ape AS (
  SELECT series, ds, actual, yhat, ABS((actual - yhat) / NULLIF(actual, 0)) * 100 AS e FROM fc WHERE actual IS NOT NULL),
errors AS (
  SELECT series, AVG(e) AS mape, SQRT(AVG((actual - yhat) * (actual - yhat))) AS rmse, AVG(ABS(actual - yhat)) AS mae FROM ape GROUP BY 1),
period_errors AS (
  SELECT series, AVG(e) FILTER (ds < DATE '{T.SPECIAL[0]}') AS mape_pre,
         AVG(e) FILTER (ds BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}') AS mape_covid,
         AVG(e) FILTER (ds > DATE '{T.SPECIAL[1]}') AS mape_post FROM ape GROUP BY 1),
after_special AS (
  SELECT series, ds, r FROM (
    SELECT series, ds, actual - yhat AS r, COUNT(*) FILTER (ds > DATE '{T.SPECIAL[1]}') OVER (PARTITION BY series) AS n_after FROM ape)
  WHERE ds > DATE '{T.SPECIAL[1]}' OR n_after < 12),
centred AS (
  SELECT series, ds, r - AVG(r) OVER (PARTITION BY series) AS e FROM after_special),
lagged AS (
  SELECT series, e, {", ".join(f"LAG(e, {k}) OVER w AS l{k}" for k in range(1, 13))}
  FROM centred WINDOW w AS (PARTITION BY series ORDER BY ds)),
lag_sums AS (
  SELECT series, COUNT(*) AS n, SUM(e * e) AS s0, {", ".join(f"SUM(e * l{k}) AS s{k}" for k in range(1, 13))} FROM lagged GROUP BY 1),
portmanteau AS (
  SELECT series, n, n * (n + 2.0) * ({" + ".join(f"(s{k} / s0) * (s{k} / s0) / (n - {k})" for k in range(1, 13))}) AS q FROM lag_sums),
autocorrelation AS (
  SELECT series, n, q AS lb_stat,
         EXP(-q / 2) * (1 + q / 2 + POWER(q / 2, 2) / 2 + POWER(q / 2, 3) / 6 + POWER(q / 2, 4) / 24 + POWER(q / 2, 5) / 120) AS lb_pvalue
  FROM portmanteau),
verdicts AS (
  SELECT e.series, mape, mape_post, lb_pvalue < 0.05 AS autocorrelated,
         CASE WHEN COALESCE(mape_post, mape) <= 12 THEN 'good' WHEN COALESCE(mape_post, mape) <= 20 THEN 'acceptable' ELSE 'poor' END AS verdict
  FROM errors e JOIN period_errors p ON e.series = p.series JOIN autocorrelation a ON e.series = a.series),
segmented AS (
  SELECT series, ds, y, m, t, CAST(D AS INTEGER) AS D, covid,
         CAST(CASE WHEN D THEN t - MIN(CASE WHEN D THEN t END) OVER (PARTITION BY series) ELSE 0 END AS INTEGER) AS t_post
  FROM (SELECT modo AS series, month_start AS ds, total_usos AS y, month AS m,
          CAST(ROW_NUMBER() OVER (PARTITION BY modo ORDER BY month_start) - 1 AS INTEGER) AS t, month_start >= DATE '{T.TREATMENT}' AS D,
          CAST(month_start BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}' AS INTEGER) AS covid FROM monthly)),
design AS (
  SELECT series, ds, t, D, t_post, CAST(y AS DOUBLE) AS y,
         CAST([1, t, D, t_post, covid, {", ".join(f"(m = {m})::INT" for m in range(2, 13))}] AS DOUBLE[]) AS x FROM segmented),
system AS (  -- per series the rows of [XtX | Xty | I]
  SELECT series, [{", ".join("[" + ", ".join([f"SUM(x[{i}] * x[{j}])" for j in range(1, K + 1)] + [f"SUM(x[{i}] * y)"] + [f"{float(i == j)}::DOUBLE" for j in range(1, K + 1)]) + "]" for i in range(1, K + 1))}] AS m
  FROM design GROUP BY series HAVING SUM(D) >= 6),
elimination(series, k, m) AS (
  SELECT series, 1, m FROM system UNION ALL
  SELECT series, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
           THEN list_transform(r, lambda v: v / m[k][k])
           ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
  FROM elimination WHERE k <= {K}),
solved AS (
  SELECT series, list_transform(m, lambda r: r[{K + 1}]) AS beta, m[3][{K + 2}:] AS inv_level, m[4][{K + 2}:] AS inv_slope
  FROM elimination WHERE k = {K + 1}),
projected AS (
  SELECT d.*, beta, list_dot_product(beta, x) AS fitted, y - list_dot_product(beta, x) AS e, inv_level, inv_slope
  FROM design d JOIN solved s ON d.series = s.series),
scores AS (
  SELECT series, t, e, beta, list_dot_product(inv_level, x) * e AS ul, list_dot_product(inv_slope, x) * e AS us FROM projected),
lag_scores AS (
  SELECT *, {LAGGED_L} AS cl, {LAGGED_S} AS cs FROM scores WINDOW w AS (PARTITION BY series ORDER BY t)),
robust AS (
  SELECT series, COUNT(*) AS n_obs, ANY_VALUE(beta[3]) AS beta_level, ANY_VALUE(beta[4]) AS beta_slope,
         SQRT(SUM(ul * (ul + 2 * cl)) * COUNT(*) / (COUNT(*) - {K})) AS beta_level_se,
         SQRT(SUM(us * (us + 2 * cs)) * COUNT(*) / (COUNT(*) - {K})) AS beta_slope_se
  FROM lag_scores GROUP BY series)
"""

SQL: dict[str, str] = {
    "yoy": """
SELECT month_start, year, month, modo, total_usos,
       LAG(total_usos) OVER w AS prev_year_usos,
       ROUND(100.0 * (total_usos - LAG(total_usos) OVER w) / NULLIF(LAG(total_usos) OVER w, 0), 2) AS yoy_pct_change
FROM monthly WINDOW w AS (PARTITION BY month, modo ORDER BY year)""",
    "fact_daily": """
SELECT fecha, year, month, day_of_week, modo, cantidad_usos, is_suspicious, source_file,
       nombre_empresa, linea, amba, jurisdiccion, provincia, municipio, dato_preliminar FROM daily""",
    "monthly_rollup": "SELECT * FROM monthly",
    "monthly_by_province": "SELECT * FROM by_province",
    "operator_totals": "SELECT * FROM operators",
    "total_daily": "SELECT * FROM total_by_day",
    "weekday_heatmap": """
SELECT day_of_week, month, CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos, AVG(cantidad_usos) AS avg_usos,
       COUNT(DISTINCT fecha) AS num_days FROM daily WHERE NOT is_suspicious GROUP BY 1, 2""",
    "daily_by_mode": "SELECT * FROM mode_by_day",
    "daily_series": "SELECT * FROM series_by_day",
    "region_by_mode": "SELECT * FROM region_mode",
    "region_index": "SELECT * FROM region_ix",
    "province_totals": f"""
SELECT provincia, CAST(SUM(total_usos) AS BIGINT) AS total FROM by_province
WHERE provincia NOT IN ({", ".join(f"'{p}'" for p in S.UNKNOWN_PROVINCES)}) AND provincia IS NOT NULL GROUP BY 1""",
    "modal_statistics": f"""
SELECT modo, CAST(SUM(total_usos) AS BIGINT) AS total_all_time, ROUND(AVG(avg_daily_usos), 6) AS avg_daily,
       MAX(total_usos) AS peak_monthly, MIN(CASE WHEN total_usos > 0 THEN total_usos END) AS min_monthly
FROM monthly WHERE modo IN {M3} GROUP BY 1""",
    "adhoc_mode_totals": "SELECT modo, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM daily GROUP BY 1",
    "heatmap_pivot": f"""
SELECT day_of_week, {", ".join(f"AVG(v) FILTER (month = {m}) AS m{m}" for m in range(1, 13))}
FROM (SELECT fecha, day_of_week, month, SUM(cantidad_usos) AS v FROM mode_by_day
      WHERE NOT (fecha BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}') GROUP BY 1, 2, 3) GROUP BY 1""",
    "kpis": """
SELECT CAST((SELECT SUM(cantidad_usos) FROM mode_by_day) AS BIGINT) AS total,
       arg_max(fecha, v * 1000000 - date_diff('day', DATE '1970-01-01', fecha)) AS peak_day, CAST(MAX(v) AS BIGINT) AS peak_total, AVG(v) AS mean_daily,
       (SELECT modo FROM mode_by_day GROUP BY 1 ORDER BY SUM(cantidad_usos) DESC, modo LIMIT 1) AS top_mode
FROM (SELECT fecha, SUM(cantidad_usos) AS v FROM mode_by_day GROUP BY 1)""",
    "latest_share": f"""
SELECT month_start, modo, 100.0 * total_usos / SUM(total_usos) OVER () AS share_pct FROM monthly
WHERE modo IN {M3} AND month_start = (SELECT MAX(month_start) FROM monthly WHERE modo IN {M3})""",
    "profile": """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT source_file) AS n_files, MIN(fecha) AS first_day, MAX(fecha) AS last_day,
       COUNT(DISTINCT modo) AS n_modes FROM daily""",
    "profile_modes": "SELECT modo, COUNT(*) AS n_rows, MIN(fecha) AS first_day, MAX(fecha) AS last_day FROM daily GROUP BY 1",
    "seasonal_amplitude": """
SELECT amba, CAST(year(month_start) AS INTEGER) AS year, MAX(total) AS peak, MIN(total) AS trough,
       CAST(MAX(total) AS DOUBLE) / MIN(total) AS amplitude FROM region_total GROUP BY 1, 2""",
    "top_operators": f"""
SELECT nombre_empresa, modo, total_usos FROM operators WHERE modo IN {M3}
ORDER BY total_usos DESC, nombre_empresa, modo LIMIT 10""",
    "labelled_top": f"""
SELECT nombre_empresa, modo, total_usos,
       CASE modo WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE modo END AS modo_label,
       substring(nombre_empresa, 1, 12) AS empresa_short
FROM operators WHERE modo IN {M3} ORDER BY total_usos DESC, nombre_empresa, modo LIMIT 10""",
    "monthly_read": f"SELECT * FROM monthly WHERE modo IN {M3}",
    "historical_monthly": "SELECT * FROM hist",
    "historical_read": f"SELECT month_start, modo, total_usos, amba, era, source FROM hist WHERE modo IN {M3}",
    "merge_prefer": "SELECT * FROM merged",
    "clip_by_group": f"SELECT * FROM merged WHERE modo = '1-URGENT' OR month_start >= DATE '{T.BASE_MONTH}'",
    "combined_monthly": "SELECT * FROM combined",
    "rolling_stats": """
SELECT fecha, total_usos, AVG(total_usos) OVER (ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7d,
       AVG(total_usos) OVER (ORDER BY fecha ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma_30d FROM total_by_day""",
    "daily_selected": f"""
SELECT * FROM mode_by_day WHERE modo IN ('1-URGENT','2-HIGH') AND fecha BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
AND NOT (month = 1 AND day(fecha) = 1)""",
    "rolling_by_mode": """
SELECT fecha, modo, cantidad_usos, AVG(cantidad_usos) OVER (PARTITION BY modo ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma
FROM mode_by_day WHERE modo IN ('1-URGENT','2-HIGH') AND fecha BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
AND NOT (month = 1 AND day(fecha) = 1)""",
    "rolling_min_periods": """
SELECT month_start, amba, total, recovery_index,
       ROUND(CASE WHEN COUNT(recovery_index) OVER w >= 6 THEN AVG(recovery_index) OVER w END, 6) AS rolling_12
FROM region_ix WINDOW w AS (PARTITION BY amba ORDER BY month_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "modal_split": """
SELECT month_start, year, month, modo, total_usos,
       ROUND(100.0 * total_usos / SUM(total_usos) OVER (PARTITION BY month_start), 2) AS mode_share_pct FROM monthly""",
    "modal_share_full": f"""
SELECT month_start, modo, total_usos, CAST(SUM(total_usos) OVER w AS BIGINT) AS month_total,
       ROUND(CAST(total_usos AS DOUBLE) / SUM(total_usos) OVER w * 100, 2) AS mode_share_pct
FROM combined WHERE month_start >= DATE '{T.BASE_MONTH}' WINDOW w AS (PARTITION BY month_start)""",
    "amba_split": """
SELECT month_start, year, month, modo, amba, total_usos,
       ROUND(100.0 * total_usos / SUM(total_usos) OVER (PARTITION BY month_start, modo), 2) AS share_pct
FROM by_province WHERE amba IN ('SI','NO') GROUP BY 1, 2, 3, 4, 5, 6""",
    "amba_region_share": """
SELECT *, ROUND(100.0 * total_usos / SUM(total_usos) OVER (PARTITION BY month_start, modo), 2) AS share_pct
FROM (SELECT month_start, year, month, modo, amba, CAST(SUM(total_usos) AS BIGINT) AS total_usos
      FROM by_province WHERE amba IN ('SI','NO') GROUP BY 1, 2, 3, 4, 5)""",
    "mom_pct": """
SELECT * FROM (SELECT month_start, modo, total_usos,
  (CAST(total_usos AS DOUBLE) - LAG(total_usos) OVER w) / NULLIF(LAG(total_usos) OVER w, 0) * 100 AS mom_pct
  FROM combined WINDOW w AS (PARTITION BY modo ORDER BY month_start)) WHERE mom_pct IS NOT NULL""",
    "series_gaps": """
SELECT * FROM (SELECT o_custkey, month_start, LAG(month_start) OVER w AS prev,
  CAST((year(month_start) * 12 + month(month_start)) - (year(LAG(month_start) OVER w) * 12 + month(LAG(month_start) OVER w)) AS INTEGER) AS gap_months
  FROM (SELECT DISTINCT o_custkey, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY month_start)) WHERE gap_months > 2""",
    "avg_per_day": "SELECT * FROM avg_pre",
    "series_junction": """
SELECT l.modo, x0, y0, x1, y1 FROM
 (SELECT modo, MAX(month_start) AS x0, arg_max(avg_daily, month_start) AS y0 FROM avg_pre GROUP BY 1) l JOIN
 (SELECT modo, COALESCE(MIN(fecha) FILTER (fecha = DATE '1997-01-02'), MIN(fecha)) AS x1,
         CAST(COALESCE(MAX(cantidad_usos) FILTER (fecha = DATE '1997-01-02'), arg_min(cantidad_usos, fecha)) AS DOUBLE) AS y1
  FROM mode_by_day WHERE fecha >= DATE '1997-01-01' GROUP BY 1) r ON l.modo = r.modo""",
    "recovery_index": f"""
SELECT m.month_start, m.year, m.month, m.modo, m.total_usos, baseline_avg, ROUND(m.total_usos / baseline_avg * 100, 2) AS recovery_index
FROM monthly m LEFT JOIN (SELECT month, modo, AVG(total_usos) AS baseline_avg FROM monthly WHERE year IN (1996, 1997) GROUP BY 1, 2) b
ON m.month = b.month AND m.modo = b.modo WHERE m.modo IN {M3}""",
    "amba_recovery": f"""
WITH base AS (SELECT amba, SUM(total_usos) AS b FROM by_province WHERE month_start = DATE '{T.BASE_MONTH}' GROUP BY 1)
SELECT p.month_start, p.amba, CAST(SUM(p.total_usos) AS BIGINT) AS total,
       ROUND(100.0 * SUM(p.total_usos) / MAX(b.b), 1) AS recovery_index
FROM by_province p JOIN base b ON p.amba = b.amba WHERE p.amba IN ('SI','NO') GROUP BY 1, 2""",
    "index_to_baseline": f"""
SELECT c.month_start, c.modo, c.total_usos, CAST(c.total_usos AS DOUBLE) / b.total_usos * 100 AS index_val
FROM combined c JOIN combined b ON b.modo = c.modo AND b.month_start = DATE '{T.BASE_MONTH}'""",
    "gap_fill": "SELECT series, ds, y, is_filled FROM filled",
    "label_events": """
SELECT t.fecha, total_usos, COALESCE(NULLIF(label, ''), '') AS event_label FROM total_by_day t LEFT JOIN event_label e ON e.date = t.fecha""",
    "label_holidays": "SELECT t.fecha, total_usos, event_label FROM total_by_day t JOIN labels_of l ON l.ds = t.fecha",
    "asof_cumsum": """
SELECT fecha, total_usos, CAST(COALESCE((SELECT SUM(magnitude) FROM hikes h WHERE h.date <= t.fecha), 0) AS BIGINT) AS fare_pressure
FROM total_by_day t""",
    "compound_in_window": """
SELECT modo, month_start, win_start, win_end, COUNT(h.date) AS n_hikes,
       ROUND((COALESCE(product(1 + magnitude / 100.0), 1) - 1) * 100, 6) AS hike_pct
FROM (SELECT modo, month_start, CAST(month_start - INTERVAL 12 MONTH AS DATE) AS win_start, CAST(month_start - INTERVAL 1 DAY AS DATE) AS win_end FROM monthly) m
LEFT JOIN hikes h ON h.date BETWEEN win_start AND win_end AND scope IN ('national','amba','amba_local') AND magnitude > 0
GROUP BY 1, 2, 3, 4""",
    "changepoints": """
SELECT DISTINCT r.series, first_ds, last_ds, d.date AS changepoint
FROM (SELECT modo AS series, MIN(month_start) AS first_ds, MAX(month_start) AS last_ds FROM monthly GROUP BY 1) r
JOIN (SELECT date FROM hikes UNION SELECT date FROM ev WHERE color = 'purple') d ON d.date >= first_ds AND d.date < last_ds""",
    "macro_shock": "SELECT modo AS series, month_start AS ds, total_usos AS y, CAST(month_start >= DATE '2000-01-10' AS INTEGER) AS macro_shock FROM monthly",
    "window_flag": f"""
SELECT modo AS series, month_start AS ds, total_usos AS y,
       CAST(month_start BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}' AS INTEGER) AS covid_impact FROM monthly""",
    "momentum": f"""
SELECT modo AS series, month_start AS ds, total_usos AS y,
       ROUND(LN(1 + GREATEST(0, (year - {T.REOPENING.year}) * 12 + month - {T.REOPENING.month})), 10) AS recovery_momentum FROM monthly""",
    "future_spine": """
SELECT modo AS series, month_start AS ds, total_usos AS y, FALSE AS is_forecast FROM monthly UNION ALL
SELECT modo, CAST(UNNEST(generate_series(MAX(month_start) + INTERVAL 1 MONTH, MAX(month_start) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE),
       CAST(NULL AS BIGINT), TRUE FROM monthly GROUP BY modo""",
    "floor_by_series": "SELECT modo AS series, MIN(total_usos) * 0.5::DOUBLE AS floor FROM monthly GROUP BY 1",
    "decompose": """
SELECT series, ds, CAST(period AS INTEGER) AS period, original, ROUND(trend, 4) AS trend, ROUND(seasonal, 4) AS seasonal, ROUND(residual, 4) AS residual FROM parts""",
    "anomalies": "SELECT series, ds, ROUND(residual, 4) AS residual, ROUND(z_score, 4) AS z_score, is_anomaly, event_label FROM anomaly",
    "anomalies_explained": """
SELECT series, ds, ROUND(z_score, 4) AS z_score, event_label, event_label <> '' AS explained FROM anomaly WHERE is_anomaly""",
    "anomaly_counts": """
SELECT series, COUNT(*) FILTER (is_anomaly) AS n_anomalies, COUNT(*) FILTER (is_anomaly AND event_label <> '') AS n_explained,
       COUNT(*) FILTER (is_anomaly AND event_label = '') AS n_unexplained FROM anomaly GROUP BY 1""",
    "anomaly_table": """
SELECT series, ds, ROUND(z_score, 4) AS z_score, event_label FROM anomaly WHERE is_anomaly ORDER BY ABS(anomaly.z_score) DESC, series, ds""",
    "its_features": f"""
SELECT series, ds, y, t, D AS "D", t_post, covid, {", ".join(f"CAST(m = {m} AS INTEGER) AS m_{m}" for m in range(2, 13))} FROM segmented""",
    "its_fit": f"""
SELECT series, UNNEST([{", ".join(f"'{n}'" for n in FEATURES)}]) AS term, UNNEST(list_transform(beta, lambda b: ROUND(b, 4))) AS beta FROM solved""",
    "its_hac": """
SELECT series, n_obs, ROUND(beta_level, 4) AS beta_level, ROUND(beta_level_se, 4) AS beta_level_se,
       ROUND(beta_slope, 4) AS beta_slope, ROUND(beta_slope_se, 4) AS beta_slope_se FROM robust""",
    "counterfactual": """
SELECT series, ds, y AS actual, ROUND(fitted, 4) AS fitted, ROUND(fitted - beta[3] * D - beta[4] * t_post, 4) AS counterfactual,
       D AS post, ROUND(y - (fitted - beta[3] * D - beta[4] * t_post), 4) AS gap FROM projected""",
    "period_index": f"""
SELECT c.month_start, c.modo, c.total_usos, CAST(c.total_usos AS DOUBLE) / b.total_usos * 100 AS index_val
FROM monthly c JOIN monthly b ON b.modo = c.modo AND b.month_start = DATE '{T.SPECIAL[0]}'
WHERE c.modo IN {M3} AND c.month_start BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}'""",
    "yoy_period": f"""
SELECT * FROM (SELECT month_start, modo,
  ROUND(100.0 * (total_usos - LAG(total_usos) OVER w) / NULLIF(LAG(total_usos) OVER w, 0), 2) AS yoy_pct_change
  FROM monthly WINDOW w AS (PARTITION BY month, modo ORDER BY year))
WHERE yoy_pct_change IS NOT NULL AND modo IN {M3} AND month_start BETWEEN DATE '{T.SPECIAL[0]}' AND DATE '{T.SPECIAL[1]}'""",
    "forecast_summary": """
SELECT a.series, last_actual, mean_forecast, ROUND((mean_forecast - baseline) / baseline * 100, 1) AS pct_change,
       CASE WHEN (mean_forecast - baseline) / baseline * 100 > 5 THEN 'up' WHEN (mean_forecast - baseline) / baseline * 100 < -5 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT series, AVG(actual) AS baseline, arg_max(actual, ds) AS last_actual FROM
       (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds DESC) AS age FROM fc WHERE NOT is_forecast AND actual IS NOT NULL) WHERE age <= 6 GROUP BY 1) a
JOIN (SELECT series, AVG(yhat) AS mean_forecast FROM fc WHERE is_forecast GROUP BY 1) f ON a.series = f.series""",
    "forecast_joined": """
SELECT series, ds, yhat FROM fc WHERE is_forecast UNION ALL
SELECT series, MAX(ds), arg_max(yhat, ds) FROM fc WHERE NOT is_forecast GROUP BY 1""",
    "forecast_errors": "SELECT series, ROUND(mape, 8) AS mape, ROUND(rmse, 8) AS rmse, ROUND(mae, 8) AS mae FROM errors",
    "errors_by_period": """
SELECT series, ROUND(mape_pre, 8) AS mape_pre, ROUND(mape_covid, 8) AS mape_covid, ROUND(mape_post, 8) AS mape_post FROM period_errors""",
    "ljung_box": """
SELECT series, n, ROUND(lb_stat, 8) AS lb_stat, ROUND(lb_pvalue, 8) AS lb_pvalue, lb_pvalue < 0.05 AS autocorrelated FROM autocorrelation""",
    "verdict": "SELECT series, ROUND(mape_post, 8) AS mape_post, autocorrelated, verdict FROM verdicts",
    "verdict_members": "SELECT verdict, series, COALESCE(autocorrelated, FALSE) AS autocorrelated FROM verdicts",
    "verdict_summary": """
SELECT verdict, COUNT(*) AS n_series, COUNT(*) FILTER (autocorrelated) AS n_autocorrelated FROM verdicts GROUP BY 1""",
    "flag_outliers": """
SELECT event_id, event_type, value, COALESCE(s > 0 AND ABS(value - m) > 4 * s, FALSE) AS is_outlier
FROM events JOIN (SELECT event_type AS et, AVG(value) AS m, STDDEV_SAMP(value) AS s FROM events GROUP BY 1) ON et = event_type""",
    "dedup_first": """
SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                     l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""",
    "flag_zero_weekday": """
SELECT fecha, modo, COUNT(*) AS n_rows, COUNT(*) FILTER (cantidad_usos = 0 AND day_of_week < 5) AS n_flagged FROM rows_in GROUP BY 1, 2""",
    "unknown_modes": f"SELECT modo, COUNT(*) AS n_rows FROM rows_in WHERE modo NOT IN {M3} GROUP BY 1",
    "map_modes": """
SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '3-MEDIUM' ELSE o_orderpriority END AS modo
FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "filter_prefix": "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase')",
    "normalize_text": "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand FROM part",
    "parse_quantity": """
SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_extendedprice) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag <> 'A'""",
    "parse_dates": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha FROM orders WHERE o_orderstatus <> 'P'""",
    "parse_period": """
SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start FROM orders WHERE o_orderstatus <> 'P'""",
    "manifest_diff": """
SELECT doc_id AS name, CASE lang WHEN 'fr' THEN 'new' WHEN 'de' THEN 'updated' ELSE 'skipped' END AS status, md5(text) AS new_hash,
       CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN md5(text || 'x') ELSE md5(text) END AS old_hash FROM documents
UNION ALL SELECT -doc_id - 1, 'missing', NULL, md5(text) FROM documents WHERE lang = 'es'""",
    "scan_csv": """
SELECT fecha, modo, COUNT(*) AS n_rows, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM daily GROUP BY 1, 2""",
    "scan_all": """
SELECT fecha, modo, nombre_empresa, COUNT(*) AS n_rows, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM (
  SELECT fecha, modo, nombre_empresa, cantidad_usos FROM daily WHERE year < 1999
  UNION ALL SELECT fecha, modo, 'UNKNOWN', SUM(cantidad_usos) FROM daily WHERE year >= 1999 GROUP BY 1, 2) GROUP BY 1, 2, 3""",
    "scan_quoted": """
SELECT fecha, upper(nombre_empresa) || chr(10) || 'DICHA "' || upper(linea) || '",' || chr(10) || chr(10) || 'Y OTROS' AS nombre_empresa,
       COUNT(*) AS n_rows, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM daily GROUP BY 1, 2""",
    "source_files": """
SELECT 'part.csv' AS source_file, year, COUNT(*) AS n_rows, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM daily GROUP BY year""",
    "refused_files": """
SELECT fecha, modo, COUNT(*) AS n_rows, CAST(SUM(cantidad_usos) AS BIGINT) AS total FROM daily WHERE year < 1999 GROUP BY 1, 2""",
    "combined_without_history": f"""
SELECT month_start, modo, total_usos, CAST(NULL AS VARCHAR) AS era FROM monthly WHERE modo IN {M3} AND year >= {T.CUT.year}""",
    "hist_source_a": """
SELECT month_start, modo, CAST(SUM(v) AS BIGINT) AS total_usos, 'periodo_modo_2013_2019' AS source FROM (
  SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, CAST(FLOOR(o_totalprice) AS BIGINT) AS v,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'COLECTIVO' WHEN '2-HIGH' THEN 'TREN' ELSE 'SUBTE' END AS modo
  FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P') GROUP BY 1, 2""",
    "hist_source_b": """
SELECT month_start, modo, total_usos, 'mmodo_2016_2019' AS source FROM (
  SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, o_orderpriority,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'COLECTIVO' WHEN '2-HIGH' THEN 'TREN' ELSE 'SUBTE' END AS modo,
    CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS total_usos
  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2, 3)""",
    "incremental_refresh": """
SELECT month_start, modo, total_usos, n_rows FROM (
  SELECT CAST(DATE_TRUNC('month', fecha) AS DATE) AS month_start, modo, CAST(SUM(cantidad_usos) AS BIGINT) AS total_usos, COUNT(*) AS n_rows
  FROM daily GROUP BY 1, 2)""",
    "refresh_batch": """
SELECT CAST(DATE_TRUNC('month', fecha) AS DATE) AS month_start, modo,
       CAST(SUM(cantidad_usos + CASE WHEN year = 1996 THEN 1000 ELSE 0 END) AS BIGINT) AS total_usos, COUNT(*) AS n_rows
FROM daily WHERE year >= 1996 GROUP BY 1, 2""",
    "stream_daily": """
SELECT CAST(ts AS DATE) AS ds, event_type, COUNT(*) AS n_rows, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _attach(statement) for name, statement in (SQL | fit_oracles.SQL).items()}


def _attach(statement: str) -> str:
    body = statement.strip()
    if body.upper().startswith("WITH "):  # further expressions join the shared ones
        return PRELUDE.rstrip() + ",\n" + body[5:]
    return PRELUDE + body
