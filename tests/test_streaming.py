"""Streaming daily totals: several batches, late rows, bounded state, one parse per row."""

import datetime as dt

from pyspark.sql import functions as F

from ridemill.operators import cleaning as C
from ridemill.plans import catalog
from ridemill.sources import daily as SD
from ridemill.streaming import daily as JD

SCHEMA = "ts timestamp, event_type string, value double"


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def wave(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_state_stays_bounded(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    expected, sizes = {}, []
    for k in range(12):  # four days a wave, three kinds; the last day of the wave before is touched again
        new = [(at(4 * k + d), kind, float(d + 1)) for d in range(-1 if k else 0, 4) for kind in "abc"]
        for ts, kind, value in new:
            n, total = expected.get((ts.date(), kind), (0, 0.0))
            expected[(ts.date(), kind)] = (n + 1, total + value)
        late = [(at(4 * k - 9), "a", 1000.0)] if k >= 3 else []  # the day is beyond the watermark by now
        wave(spark, source, new + late)
        query = JD.start_daily_totals(spark, source, schema, out, late="2 days")
        query.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        if late:
            assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress if p.stateOperators) >= 1
    got = {(r.ds, r.event_type): (r.n_rows, r.total) for r in JD.read_daily_totals(spark, out).collect()}
    assert got == expected and len(expected) == 144
    assert max(sizes) <= 3 * 12  # the days of a wave and of the watermark, not of all time


def test_several_batches_and_a_repeated_one(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        wave(spark, source, [(at(0), "a", 1.0), (at(0), "b", float(k))])
    schema = spark.createDataFrame([], SCHEMA).schema
    query = JD.start_daily_totals(spark, source, schema, out, max_files=1)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    want = {("a", 4, 4.0), ("b", 4, 6.0)}
    assert {(r.event_type, r.n_rows, r.total) for r in JD.read_daily_totals(spark, out).collect()} == want
    part = spark.read.parquet(f"{out}/result/batch=3").collect()  # a batch that is repeated writes its own folder again
    spark.createDataFrame(part, JD.read_daily_totals(spark, out).schema).write.mode("overwrite").parquet(f"{out}/result/batch=3")
    assert {(r.event_type, r.n_rows, r.total) for r in JD.read_daily_totals(spark, out).collect()} == want
    assert JD.read_daily_totals(spark, str(tmp_path / "nothing")).collect() == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_parsed_once(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for query, sign in ((catalog.parse_quantity, "lower(l_linestatus"), (catalog.parse_dates, "not-a-date"), (catalog.parse_period, "not-a-date")):
        plan = _plan(query(spark, folder))
        lines = [line for line in plan.split("\n") if sign in line]
        assert len(lines) == 1 and "Project" in lines[0], plan
    path = tmp_path / "a.csv"
    path.write_text("fecha,modo,cantidad_usos\n2024-01-02,TREN,5\n")
    plan = _plan(C.parse_daily(SD.scan_csv(spark, str(path))).groupBy("fecha").agg(F.sum("cantidad_usos")))
    parsing = [line for line in plan.split("\n") if "RLIKE" in line]
    assert len(parsing) == 1, plan
