import datetime as dt

from ridemill.operators import baselines as B
from ridemill.operators import windows as W

DAY = dt.date


def frame(spark, data):
    return spark.createDataFrame(data, "month_start date, modo string, total_usos long")


def test_rolling_uses_available_rows(spark):
    days = [(DAY(2024, 1, 1) + dt.timedelta(i), float(i)) for i in range(40)]
    out = W.rolling_stats(spark.createDataFrame(days, "fecha date, total_usos double")).orderBy("fecha").collect()
    assert out[0].ma_7d == 0.0 and out[6].ma_7d == 3.0 and out[39].ma_7d == 36.0
    assert out[39].ma_30d == sum(range(10, 40)) / 30


def test_rolling_with_minimum(spark):
    data = [(DAY(2024, m, 1), "SI", 10.0 if m != 3 else None) for m in range(1, 9)]
    df = spark.createDataFrame(data, "month_start date, amba string, v double")
    out = [r.rolling_12 for r in W.rolling_min_periods(df, "v", ["amba"]).orderBy("month_start").collect()]
    assert out == [None] * 6 + [10.0, 10.0]


def test_mom(spark, rows):
    out = W.mom_pct(frame(spark, [(DAY(2024, 1, 1), "T", 100), (DAY(2024, 2, 1), "T", 150), (DAY(2024, 3, 1), "T", 75), (DAY(2024, 1, 1), "S", 5)]))
    assert rows(out, "modo", "month_start", "mom_pct") == [("T", DAY(2024, 2, 1), 50.0), ("T", DAY(2024, 3, 1), -50.0)]


def test_yoy_takes_previous_available_year(spark, rows):
    df = spark.createDataFrame([(DAY(y, 1, 1), y, 1, "T", v) for y, v in ((2020, 100), (2022, 150), (2023, 0), (2024, 9))],
                               "month_start date, year int, month int, modo string, total_usos long")
    assert rows(W.yoy(df), "year", "prev_year_usos", "yoy_pct_change") == [
        (2020, None, None), (2022, 100, 50.0), (2023, 150, -100.0), (2024, 0, None)]


def test_index(spark, rows):
    df = frame(spark, [(DAY(2020, 1, 1), "T", 1000), (DAY(2020, 4, 1), "T", 420), (DAY(2020, 4, 1), "S", 5)])
    assert rows(B.index_to_baseline(df, DAY(2020, 1, 1)), "modo", "month_start", "index_val") == [
        ("T", DAY(2020, 1, 1), 100.0), ("T", DAY(2020, 4, 1), 42.0)]


def test_recovery_index_without_baseline_is_null(spark, rows):
    df = spark.createDataFrame([(DAY(2022, 1, 1), 2022, 1, "TREN", 100), (DAY(2023, 1, 1), 2023, 1, "TREN", 300),
                                (DAY(2024, 1, 1), 2024, 1, "TREN", 100), (DAY(2024, 2, 1), 2024, 2, "TREN", 7)],
                               "month_start date, year int, month int, modo string, total_usos long")
    out = B.recovery_index(df, [2022, 2023], ["TREN"])
    assert rows(out, "month_start", "baseline_avg", "recovery_index")[2:] == [(DAY(2024, 1, 1), 200.0, 50.0), (DAY(2024, 2, 1), None, None)]


def test_new_year_left_out(spark, rows):
    df = spark.createDataFrame([(DAY(2024, 1, 1), "T", 1), (DAY(2024, 1, 2), "T", 2), (DAY(2024, 1, 3), "S", 3)],
                               "fecha date, modo string, cantidad_usos long")
    assert rows(W.daily_selected(df, ["T"], DAY(2024, 1, 1), DAY(2024, 12, 31))) == [(DAY(2024, 1, 2), "T", 2)]


def test_junction_falls_back_to_first_day(spark, rows):
    avg = spark.createDataFrame([(DAY(2019, 10, 1), "T", 31.0), (DAY(2019, 9, 1), "T", 30.0), (DAY(2019, 9, 1), "S", 9.0)],
                                "month_start date, modo string, avg_daily double")
    days = spark.createDataFrame([(DAY(2020, 1, 5), "T", 50), (DAY(2020, 1, 7), "T", 70), (DAY(2020, 1, 1), "S", 1), (DAY(2020, 1, 2), "S", 2)],
                                 "fecha date, modo string, cantidad_usos long")
    assert rows(W.series_junction(avg, days, DAY(2020, 1, 2))) == [
        ("S", DAY(2019, 9, 1), 9.0, DAY(2020, 1, 2), 2.0), ("T", DAY(2019, 10, 1), 31.0, DAY(2020, 1, 5), 50.0)]


def test_daily_average(spark, rows):
    out = W.with_daily_average(frame(spark, [(DAY(2016, 2, 1), "T", 2900), (DAY(2020, 1, 1), "T", 1)]), DAY(2020, 1, 1))
    assert rows(out, "avg_daily") == [(100.0,)]
