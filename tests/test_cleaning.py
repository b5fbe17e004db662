import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridemill.functions import parsing as P
from ridemill.operators import cleaning as C
from ridemill.session import stage
from ridemill.sources import daily as SD

FULL = (
    "dia_transporte,nombre_empresa,linea,amba,tipo_transporte,jurisdiccion,provincia,municipio,cantidad_usos,dato_preliminar\n"
    "2024-03-04,Línea Uno,L1,si,colectivo,nacional,caba,centro,1200,n\n"
    "2024-03-04,línea uno,L2,SI,COLECTIVO,NACIONAL,CABA,CENTRO,800,N\n"
    "2024-03-05,Ferro Sur,R1,NO, tren ,PROVINCIAL,CORDOBA,,500,S\n"
)


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def clean(spark, *paths):
    parsed = stage(C.parse_daily(SD.scan_paths(spark, list(paths))), "parsed")
    return C.clean_daily(parsed, [C.POSITION])


def test_full_layout(spark, tmp_path, rows):
    out = clean(spark, write(tmp_path, "a.csv", FULL))
    assert rows(out, "fecha", "modo", "nombre_empresa", "linea", "cantidad_usos", "municipio") == [
        (dt.date(2024, 3, 4), "COLECTIVO", "LÍNEA UNO", "L1", 1200, "CENTRO"),
        (dt.date(2024, 3, 4), "COLECTIVO", "LÍNEA UNO", "L2", 800, "CENTRO"),
        (dt.date(2024, 3, 5), "TREN", "FERRO SUR", "R1", 500, "UNKNOWN")]
    assert rows(out, "source_file")[0] == ("a.csv",)
    assert rows(out.filter("linea = 'R1'"), "year", "month", "day_of_week", "amba", "dato_preliminar") == [(2024, 3, 1, "NO", "S")]


def test_latin1_equals_utf8(spark, tmp_path, rows):
    utf8 = clean(spark, write(tmp_path, "u.csv", FULL)).drop("source_file")
    latin = clean(spark, write(tmp_path, "l.csv", FULL, "latin-1")).drop("source_file")
    assert rows(utf8) == rows(latin)


@pytest.mark.parametrize("header", ["FECHA;MODO;CANTIDAD_USOS", "fecha;tipo;transacciones", "﻿Date; mode ;usos", "DIA,LINEA_MODO,CANTIDAD"])
def test_header_variants(spark, tmp_path, rows, header):
    sep = ";" if ";" in header else ","
    text = "\n".join([header, sep.join(["2024-01-02", "SUBTE", "70"]), "", sep.join(["01/03/2024", "Subte", "3.000.000"])]) + "\r\n"
    out = clean(spark, write(tmp_path, "h.csv", text))
    assert rows(out, "fecha", "modo", "cantidad_usos", "nombre_empresa", "dato_preliminar") == [
        (dt.date(2024, 1, 2), "SUBTE", 70, "UNKNOWN", "N"), (dt.date(2024, 1, 3), "SUBTE", 3_000_000, "UNKNOWN", "N")]


def test_bad_rows_dropped(spark, tmp_path, rows):
    text = "fecha,modo,cantidad_usos\nnot-a-date,TREN,5\n2024-01-02,TREN,abc\n2024-01-03,TREN,-5\n2024-02-30,TREN,1\n"
    assert rows(clean(spark, write(tmp_path, "b.csv", text)), "fecha", "cantidad_usos") == [(dt.date(2024, 1, 3), 5)]


def test_quoted_separator(spark, tmp_path, rows):
    text = 'fecha,modo,cantidad_usos,nombre_empresa,linea\n2024-01-02,TREN,"1,000","Sur, S.A.",A\n'
    assert rows(clean(spark, write(tmp_path, "q.csv", text)), "cantidad_usos", "nombre_empresa") == [(1000, "SUR, S.A.")]


def test_duplicates_keep_first_in_file_and_across_files(spark, tmp_path, rows):
    head = "fecha,modo,cantidad_usos,nombre_empresa,linea\n"
    a = write(tmp_path, "y1.csv", head + "2024-01-02,TREN,10,X,1\n2024-01-02,TREN,99,X,1\n")
    b = write(tmp_path, "y2.csv", head + "2024-01-02,TREN,77,X,1\n2024-01-03,TREN,7,X,1\n")
    assert rows(clean(spark, b, a), "fecha", "cantidad_usos", "source_file") == [
        (dt.date(2024, 1, 2), 10, "y1.csv"), (dt.date(2024, 1, 3), 7, "y2.csv")]


def test_position_follows_the_file_over_splits(spark, tmp_path):
    lines = "".join(f"2024-01-02,TREN,{i},X,{i % 50}\n" for i in range(1, 20001))
    path = write(tmp_path, "big.csv", "fecha,modo,cantidad_usos,nombre_empresa,linea\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        out = clean(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = {r.linea: r.cantidad_usos for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {str(i % 50): i for i in range(1, 51)}


def test_four_sigma_flag_is_per_file_and_mode(spark, tmp_path):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i)).isoformat() for i in range(30)]
    text = "fecha,modo,cantidad_usos\n" + "".join(f"{d},TREN,{1000 if i < 29 else 1000000}\n" for i, d in enumerate(days))
    text += "".join(f"{d},SUBTE,1000000\n" for d in days)
    out = clean(spark, write(tmp_path, "o.csv", text))
    flagged = out.filter("is_suspicious").collect()
    assert [(r.modo, r.cantidad_usos) for r in flagged] == [("TREN", 1000000)]


def test_zero_on_weekday_only(spark, tmp_path):
    text = "fecha,modo,cantidad_usos\n2024-01-02,TREN,0\n2024-01-06,TREN,0\n"
    out = {r.fecha.day: r.is_suspicious for r in clean(spark, write(tmp_path, "z.csv", text)).collect()}
    assert out == {2: True, 6: False}


def test_broken_file_is_skipped(spark, tmp_path):
    write(tmp_path, "dat-ab-usos-2023.csv", "bad,data\n1,2\n")
    write(tmp_path, "dat-ab-usos-2024.csv", FULL)
    write(tmp_path, "other.csv", FULL)
    out = SD.scan_all(spark, str(tmp_path))
    assert {r.source_file for r in out.collect()} == {"dat-ab-usos-2024.csv"}


def test_no_usable_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SD.scan_all(spark, str(tmp_path))
    write(tmp_path, "dat-ab-usos-2023.csv", "bad,data\n1,2\n")
    with pytest.raises(RuntimeError):
        SD.scan_all(spark, str(tmp_path))
    with pytest.raises(ValueError, match="missing columns"):
        SD.scan_csv(spark, str(tmp_path / "dat-ab-usos-2023.csv"))
    with pytest.raises(ValueError, match="no separator"):
        SD.scan_csv(spark, write(tmp_path, "one.csv", "single\nx\n"))


def test_unknown_modes_are_kept_and_reported(spark, tmp_path, rows):
    text = "fecha,modo,cantidad_usos\n2024-01-02,tranvia,1\n2024-01-02,TREN,2\n"
    out = clean(spark, write(tmp_path, "m.csv", text))
    assert out.count() == 2
    assert rows(SD.unknown_modes(out)) == [("TRANVIA", 1)]


def test_headers_normalised(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" DIA_TRANSPORTE ", "Tipo", "otra"])
    assert SD.normalize_headers(df).columns == ["fecha", "modo", "otra"]


def test_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS v", "id AS pos")
    plan = C.keep_first(df, ["k"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_rows_are_sorted_after_the_shuffle_only(spark):
    """No split is sorted as a whole before it is dealt out, where no key stands out."""
    df = spark.range(2000).selectExpr("id % 1000 AS k", "id AS v", "-id AS pos")
    out = C.keep_first(df, ["k"], ["pos"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "Sort" not in plan[plan.index("Exchange"):]
    assert sorted(r.v for r in out.collect()) == list(range(1000, 2000))


def test_months_are_dealt_in_parts_by_one_shuffle(spark, rows):
    df = spark.range(6000).selectExpr("CAST(2024 + id DIV 100000 AS int) AS year", "CAST(IF(id < 5000, 1, 2) AS int) AS month", "id % 3000 AS k", "id AS v", "NULL AS none")
    keys = ["year", "month", "k", "none"]
    out = C.keep_first(df, keys, ["v"], by=C.MONTH, part_rows=1000)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(out, "v") == [(v,) for v in (*range(3000), *range(5000, 6000))]
    dealt = C.in_parts(df, keys, C.MONTH, df.groupBy(*C.MONTH).agg(F.count("*").alias("n")).collect(), part_rows=1000)
    assert rows(dealt.select("month", "_part").distinct()) == [*((1, part) for part in range(5)), (2, 0)]


def test_hot_key_among_others(spark, rows):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id AS v").withColumn("year", F.lit(2024))
    assert rows(C.keep_first(df, ["year", "k"], ["v"], by=["year"]), "k", "v") == [(-1, 0)] + [(i, i) for i in range(3000) if i % 3]


@pytest.mark.parametrize("text,expected", [
    ("2024-01-15", "2024-01-15"), ("01/15/2024", "2024-01-15"), ("15/01/2024", "2024-01-15"), ("2024/1/5", "2024-01-05"),
    ("20240115", "2024-01-15"), ("2024-01-15 10:30:00", "2024-01-15"), ("2024-01-15T10:30:00", "2024-01-15"),
    ("15-Jan-2024", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"), ("  2024-01-15 ", "2024-01-15"),
    ("not-a-date", None), ("", None), (None, None), ("2024-13-01", None), ("202401", None)])
def test_parse_date(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(P.parse_date(F.col("t"))).first()[0]
    assert got == (dt.date.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize("text,expected", [
    ("201301", "2013-01-01"), ("2013-01", "2013-01-01"), ("2013-1", "2013-01-01"), ("03/2014", "2014-03-01"), ("03/14", "2014-03-01"),
    ("03/75", "1975-03-01"), ("2014/03", "2014-03-01"), ("Jan-2013", "2013-01-01"), ("January-2013", "2013-01-01"),
    ("2013-01-15", "2013-01-15"), ("201313", None), ("junk", None), (None, None)])
def test_parse_period(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(P.parse_period(F.col("t"))).first()[0]
    assert got == (dt.date.fromisoformat(expected) if expected else None)


def test_grouped_numbers(spark):
    df = spark.createDataFrame([(" 1.234.567 ", "1,234"), ("x", ""), (None, "7")], "a string, b string")
    got = [tuple(r) for r in df.select(P.parse_grouped_number(F.col("a"), "."), P.parse_grouped_number(F.col("b"), ",")).collect()]
    assert got == [(1234567, 1234), (None, None), (None, 7)]
