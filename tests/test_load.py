import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.operators import rollups as R
from ridemill.operators import windows as W
from ridemill.plans.warehouse import VIEW_NAMES, Warehouse

DAY = dt.date


def fact(spark, rows):
    """rows: (day, mode, count, suspicious, operator, line, region, province)"""
    full = [(d, d.year, d.month, d.weekday(), m, n, s, "f.csv", op, li, am, "J", pr, "M", "N") for d, m, n, s, op, li, am, pr in rows]
    return spark.createDataFrame(full, S.DAILY)


ROWS = [
    (DAY(2023, 1, 2), "COLECTIVO", 1000, False, "A", "1", "SI", "CABA"),
    (DAY(2024, 1, 1), "COLECTIVO", 700, False, "A", "1", "SI", "CABA"),
    (DAY(2024, 1, 1), "COLECTIVO", 100, False, "B", "9", "NO", "SALTA"),
    (DAY(2024, 1, 2), "COLECTIVO", 700, False, "A", "2", "SI", "CABA"),
    (DAY(2024, 1, 2), "COLECTIVO", 0, True, "A", "3", "SI", "CABA"),
    (DAY(2024, 1, 1), "TREN", 500, False, "T", "R", "NO", "SN"),
    (DAY(2024, 2, 1), "TREN", 300, False, "T", "R", "SI", "CABA"),
    (DAY(2024, 1, 1), "LANCHAS", 20, False, "UNKNOWN", "X", "UNKNOWN", "JN"),
]


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("wh")))
    house.load(fact(spark, ROWS))
    return house


def test_monthly(wh, rows):
    got = rows(wh.monthly.filter("modo = 'COLECTIVO'"), "month_start", "total_usos", "avg_daily_usos", "days_with_data", "suspicious_days")
    assert got == [(DAY(2023, 1, 1), 1000, 1000.0, 1, 0), (DAY(2024, 1, 1), 1500, 500.0, 2, 0)]


def test_load_twice_gives_the_same(wh, spark, rows):
    before = rows(wh.monthly)
    wh.load(fact(spark, ROWS))
    assert rows(wh.monthly) == before and wh.daily.count() == len(ROWS)


def test_operator_totals_leave_unknown_out(wh, rows):
    assert rows(wh.operators) == [("A", "COLECTIVO", 2400, 3, 2), ("B", "COLECTIVO", 100, 1, 1), ("T", "TREN", 800, 2, 1)]


def test_views(wh, rows):
    assert rows(wh.query("SELECT total_usos FROM v_total_daily WHERE fecha = DATE'2024-01-01'")) == [(1320,)]
    assert rows(wh.query("SELECT yoy_pct_change FROM v_yoy_monthly WHERE modo = 'COLECTIVO' AND year = 2024")) == [(50.0,)]
    shares = wh.query("SELECT SUM(mode_share_pct) FROM v_modal_split GROUP BY month_start").collect()
    assert all(abs(r[0] - 100) < 0.02 for r in shares)
    names = {t.name for t in wh.spark.catalog.listTables()}
    assert set(VIEW_NAMES) <= names


def test_mode_totals_order(wh):
    got = [tuple(r) for r in R.mode_totals(wh.daily).orderBy(F.desc("total")).collect()]
    assert got == [("COLECTIVO", 2500), ("TREN", 800), ("LANCHAS", 20)]


def test_region_split_collapses_equal_totals(spark, rows):
    same = [(DAY(2024, 1, 1), "TREN", 10, False, "A", "1", "SI", p) for p in ("P1", "P2")]
    province = R.monthly_by_province(fact(spark, same + [(DAY(2024, 1, 1), "TREN", 30, False, "A", "1", "NO", "P3")]))
    assert rows(W.amba_split(province), "amba", "total_usos", "share_pct") == [("NO", 30, 75.0), ("SI", 10, 25.0)]
    assert rows(W.amba_region_share(province), "amba", "total_usos", "share_pct") == [("NO", 30, 60.0), ("SI", 20, 40.0)]


def test_province_totals(wh, rows):
    assert rows(R.province_totals(wh.by_province)) == [("CABA", 2700), ("SALTA", 100)]


def test_without_historical_table(wh, rows):
    assert wh.historical is None
    assert wh.historical_read().count() == 0
    assert wh.historical_read().columns == ["month_start", "modo", "total_usos", "amba", "era", "source"]
    assert wh.combined_monthly().count() == 4  # LANCHAS is not reported


def test_with_historical_table(spark, tmp_path, rows):
    house = Warehouse(spark, str(tmp_path))
    house.load(fact(spark, ROWS))
    old = [(DAY(2018, m, 1), 2018, m, "TREN", 5, "SI", "pre2020", "x") for m in (1, 2, 6)]
    gaps = house.load_historical(spark.createDataFrame(old, S.HISTORICAL))
    assert rows(gaps) == [("TREN", DAY(2018, 6, 1), DAY(2018, 2, 1), 4)]
    assert house.combined_monthly().count() == 7 and house.historical_read().count() == 3


def test_kpis_and_latest_share(wh, rows):
    by_mode = R.daily_by_mode(wh.daily, S.REPORT_MODES)
    assert rows(R.kpis(by_mode)) == [(3300, DAY(2024, 1, 1), 1300, 825.0, "COLECTIVO")]
    assert rows(R.latest_share(wh.monthly, S.REPORT_MODES)) == [(DAY(2024, 2, 1), "TREN", 100.0)]


def test_labels_and_truncation(spark, wh, rows):
    from ridemill.sources.dimensions import labels
    top = R.top_operators(wh.operators, S.REPORT_MODES, 2)
    named = R.labelled(top, labels(spark, S.MODE_LABELS["en"], "modo", "modo_label"), "modo", "modo_label", "nombre_empresa", 35)
    assert rows(named, "nombre_empresa", "modo_label", "empresa_short") == [("A", "Bus", "A"), ("T", "Train", "T")]


def test_heatmap_averages_days(spark, rows):
    data = [(DAY(2024, 1, d), m, n, False, "A", "1", "SI", "P") for d, m, n in ((1, "TREN", 10), (1, "SUBTE", 20), (8, "TREN", 50))]
    pivot = R.heatmap_pivot(R.daily_by_mode(fact(spark, data), S.REPORT_MODES), S.REPORT_MODES)
    assert rows(pivot, "day_of_week", "m1", "m2") == [(0, 40.0, None)]


def test_rollups_from_parts_equal_those_of_the_rows(wh, rows):
    """Days by bits and lines by merged rows: the same as distinct counts over the fact, also in one part per row."""
    parts = R.month_parts(wh.daily)
    for direct, merged in ((R.monthly_rollup, R.monthly_from_parts), (R.monthly_by_province, R.provinces_from_parts), (R.operator_totals, R.operators_from_parts)):
        want = direct(wh.daily)
        assert rows(merged(parts), *want.columns) == rows(want)
