import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridemill.operators import calendars as K
from ridemill.sources import dimensions as D

DAY = dt.date


def hikes(spark, data):
    return D.from_rows(spark, [(d, s, m, "", "") for d, s, m in data], D.HIKE_SCHEMA)


def test_built_in_dimensions(spark):
    assert (D.events(spark).count(), D.fare_hikes(spark).count(), D.holidays(spark).count()) == (16, 22, 134)
    assert D.fare_hikes(spark).filter("magnitude < 0 OR date IS NULL OR scope = ''").count() == 0
    dates = [r.date for r in D.fare_hikes(spark).orderBy("seq").collect()]
    assert dates == sorted(dates)
    assert D.holidays(spark).select("type").distinct().count() == 5


def test_dimension_from_file(spark, tmp_path, rows):
    (tmp_path / "h.yaml").write_text("- date: '2024-01-15'\n  scope: national\n  magnitude: 45\n  label_es: a\n  label_en: b\n  notes: n\n")
    (tmp_path / "h.csv").write_text("date,scope,magnitude,label_es,label_en\n2024-01-15,national,45,a,b\n")
    expected = [(0, DAY(2024, 1, 15), "national", 45, "a", "b")]
    for name in ("h.yaml", "h.csv"):
        assert rows(D.read_dimension(spark, str(tmp_path / name), D.HIKE_SCHEMA)) == expected


def test_labels_by_priority(spark):
    events = D.from_rows(spark, [(DAY(2024, 1, 1), "uno", "one", "red"), (DAY(2024, 1, 1), "dos", "two", "red"),
                                 (DAY(2024, 5, 1), "", "", "red")], D.EVENT_SCHEMA)
    holidays = D.from_rows(spark, [(DAY(2024, 1, 1), "Año", "Year", "t"), (DAY(2024, 5, 1), "Mayo", "May", "t"),
                                   (DAY(2024, 5, 3), "Tres", "Three", "t")], D.HOLIDAY_SCHEMA)
    days = spark.createDataFrame([(DAY(2024, 1, 1),), (DAY(2024, 1, 2),), (DAY(2023, 12, 31),), (DAY(2024, 5, 1),), (DAY(2024, 5, 2),), (DAY(2024, 7, 1),)], "ds date")
    got = {r.ds: r.event_label for r in K.label_holidays(days, events, holidays, "ds", "en").collect()}
    assert got == {DAY(2024, 1, 1): "two", DAY(2024, 1, 2): "Adjacent holiday (-1d): Year", DAY(2023, 12, 31): "Adjacent holiday (+1d): Year",
                   DAY(2024, 5, 1): "Holiday: May", DAY(2024, 5, 2): "Adjacent holiday (-1d): May", DAY(2024, 7, 1): ""}
    es = {r.ds: r.event_label for r in K.label_holidays(days, events, holidays, "ds", "es").collect()}
    assert es[DAY(2024, 5, 1)] == "Feriado: Mayo" and es[DAY(2024, 1, 2)] == "Feriado adj. (-1d): Año"


def test_asof_sum_against_brute_force(spark):
    table = [(DAY(2016, 4, 1), "n", 92), (DAY(2018, 2, 1), "n", 28), (DAY(2018, 2, 1), "x", 3), (DAY(2019, 9, 1), "n", 0)]
    days = [DAY(2015, 1, 1) + dt.timedelta(37 * i) for i in range(60)] + [DAY(2018, 2, 1)] * 2
    df = spark.createDataFrame([(d,) for d in days], "ds date")
    got = sorted((r.ds, r.fare_pressure) for r in K.asof_cumsum(df, hikes(spark, table)).collect())
    assert got == sorted((d, sum(m for h, _, m in table if h <= d)) for d in days)


@pytest.mark.parametrize("table,start,end,scopes,expected", [
    ([(DAY(2024, 1, 15), "national", 10), (DAY(2024, 2, 6), "amba", 10)], DAY(2023, 12, 31), DAY(2024, 2, 28), ("national", "amba"), 21.0),
    ([(DAY(2024, 1, 15), "national", 45), (DAY(2024, 2, 6), "national", 66)], DAY(2023, 12, 31), DAY(2024, 2, 28), ("national",), 140.7),
    ([(DAY(2024, 1, 15), "national", 10)], DAY(2024, 1, 15), DAY(2024, 2, 28), ("national",), 0.0),
    ([(DAY(2024, 1, 15), "national", 10)], DAY(2024, 1, 1), DAY(2024, 1, 15), ("national",), 10.0),
    ([(DAY(2024, 1, 15), "interior", 10)], DAY(2024, 1, 1), DAY(2024, 2, 1), ("national",), 0.0),
    ([(DAY(2024, 1, 15), "national", 0)], DAY(2024, 1, 1), DAY(2024, 2, 1), ("national",), 0.0)])
def test_compounding(spark, table, start, end, scopes, expected):
    dim = hikes(spark, table)
    one = spark.range(1).select(K.cumulative_hike_pct(dim, start, end, scopes)).first()[0]
    df = spark.createDataFrame([(start, end)], "a date, b date")
    many = K.compound_in_window(df, dim, "a", "b", scopes).first().hike_pct
    assert one == pytest.approx(expected) and many == pytest.approx(expected)


def test_inclusive_start_and_counts(spark):
    dim = hikes(spark, [(DAY(2024, 1, 1), "amba", 10), (DAY(2024, 12, 31), "amba", 20), (DAY(2025, 1, 1), "amba", 5)])
    df = spark.createDataFrame([(DAY(2024, 1, 1), DAY(2024, 12, 31)), (DAY(2024, 1, 2), DAY(2024, 1, 1))], "a date, b date")
    got = sorted((r.n_hikes, round(r.hike_pct, 9)) for r in K.compound_in_window(df, dim, "a", "b", include_start=True).collect())
    assert got == [(0, 0.0), (2, 32.0)]


def test_shock_and_break_dates(spark, rows):
    events = D.from_rows(spark, [(DAY(2023, 12, 13), "", "", "purple"), (DAY(2024, 1, 15), "", "", "purple"), (DAY(2020, 1, 1), "", "", "gray")], D.EVENT_SCHEMA)
    df = spark.createDataFrame([(DAY(2023, 12, 1),), (DAY(2023, 12, 13),), (DAY(2025, 1, 1),)], "ds date")
    assert rows(df.withColumn("s", K.macro_shock(F.col("ds"), events)), "s") == [(0,), (1,), (1,)]
    assert rows(df.withColumn("s", K.macro_shock(F.col("ds"), events, ["none"])), "s") == [(0,)] * 3
    dim = hikes(spark, [(DAY(2024, 1, 15), "n", 45), (DAY(2019, 9, 1), "n", 0)])
    breaks = K.break_dates(dim, events)
    assert rows(breaks) == [(DAY(2019, 9, 1),), (DAY(2023, 12, 13),), (DAY(2024, 1, 15),)]
    ranges = spark.createDataFrame([("T", DAY(2023, 1, 1), DAY(2024, 1, 15)), ("S", DAY(2019, 9, 1), DAY(2020, 1, 1))], "series string, first_ds date, last_ds date")
    assert rows(K.changepoints(breaks, ranges), "series", "changepoint") == [("S", DAY(2019, 9, 1)), ("T", DAY(2023, 12, 13))]
