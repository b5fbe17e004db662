"""The star-schema test tables in the role of ridership data.

Ship date is the day, order priority the mode, quantity - 1 the count, supplier the
operator, brand the line, supplier nation and region the geography. Everything below is
derived from the given tables by Spark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemill.operators import cleaning as C
from ridemill.plans.warehouse import Warehouse
from ridemill.session import fresh_path, stage
from ridemill.sources import dimensions as D
from ridemill.sources import historical as H

MODES3 = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MODES5 = (*MODES3, "4-NOT SPECIFIED", "5-LOW")
ROW_ORDER = ["cantidad_usos", "municipio", "dato_preliminar"]
CUT = dt.date(1997, 1, 1)  # historical months lie before it, current ones after
BASE_MONTH = dt.date(1996, 1, 1)
TREATMENT = dt.date(2000, 1, 1)
SPECIAL = (dt.date(1998, 3, 1), dt.date(1998, 12, 1))
REOPENING = dt.date(1999, 1, 1)
STARTS = {"1-URGENT": None}
LAST_KNOWN = dt.date(2001, 5, 1)
FLEXIBILITY = {"2-HIGH": 0.1, "3-MEDIUM": 0.2}
SHOCK = (dt.date(1999, 12, 31), dt.date(2000, 2, 28))

EVENT_ROWS = [
    ("1995-06-09", "Apertura", "Opening", "green"),
    ("1996-04-01", "Ajuste", "Adjustment", "gray"),
    ("1997-05-01", "", "", "blue"),
    ("1998-03-01", "Cierre", "Closure", "red"),
    ("1998-03-01", "Cierre total", "Full closure", "red"),
    ("1999-09-01", "Congelamiento", "Freeze", "blue"),
    ("2000-01-10", "Devaluacion", "Devaluation", "purple"),
    ("2000-06-15", "Segundo shock", "Second shock", "purple"),
]
HIKE_ROWS = [
    ("1996-04-01", "national", 92), ("1997-02-01", "national", 28), ("1997-04-01", "interior", 18),
    ("1998-06-01", "national", 14), ("1999-01-12", "amba", 16), ("1999-09-01", "national", 0),
    ("2000-01-15", "national", 45), ("2000-02-06", "national", 66), ("2000-08-12", "amba_local", 37),
    ("2001-03-01", "national", 10),
]
HOLIDAY_ROWS = [
    (f"{year}-{day}", name_es, name_en, "inamovible")
    for year in range(1995, 2002)
    for day, name_es, name_en in (
        ("01-01", "Ano Nuevo", "New Year"), ("05-01", "Dia del Trabajo", "Labour Day"),
        ("05-02", "Puente", "Bridge day"), ("07-09", "Independencia", "Independence Day"),
        ("12-25", "Navidad", "Christmas"))
]


def _dated(rows: list[tuple]) -> list[tuple]:
    return [(dt.date.fromisoformat(r[0]), *r[1:]) for r in rows]


def events_dim(spark: SparkSession) -> DataFrame:
    return D.from_rows(spark, _dated(EVENT_ROWS), D.EVENT_SCHEMA)


def hikes_dim(spark: SparkSession) -> DataFrame:
    rows = [(*r, "", "") for r in _dated(HIKE_ROWS)]
    return D.from_rows(spark, rows, D.HIKE_SCHEMA)


def holidays_dim(spark: SparkSession) -> DataFrame:
    return D.from_rows(spark, _dated(HOLIDAY_ROWS), D.HOLIDAY_SCHEMA)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed daily rows before flags and de-duplication."""
    nation = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.col("r_name")
    # orders get their customer's segment before the larger table is joined, whose rows are then dealt once less
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        read(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("fecha"),
            F.col("o_orderpriority").alias("modo"),
            (F.col("l_quantity").cast("bigint") - 1).alias("cantidad_usos"),
            F.col("s_name").alias("nombre_empresa"), F.col("p_brand").alias("linea"),
            F.when(region.isin("AMERICA", "EUROPE"), "SI").when(region.isin("ASIA", "AFRICA"), "NO")
            .otherwise("UNKNOWN").alias("amba"),
            region.alias("jurisdiccion"), F.col("n_name").alias("provincia"),
            F.col("c_mktsegment").alias("municipio"),
            F.when(F.col("l_linestatus") == "O", "S").otherwise("N").alias("dato_preliminar"))
    )
    return C.add_date_parts(rows).withColumn("source_file", F.concat(F.lit("f-"), F.col("year")))


def orders_by_month(spark: SparkSession, sf_dir: str, total: Column) -> DataFrame:
    return (read(spark, sf_dir, "orders")
            .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month_start"),
                     F.col("o_orderpriority").alias("modo"))
            .agg(total.cast("bigint").alias("total_usos")))


def _before(until: dt.date | None) -> Column:
    return F.lit(True) if until is None else F.col("month_start") < F.lit(until)


def source_a(spark: SparkSession, sf_dir: str, until: dt.date | None = CUT) -> DataFrame:
    """All months, or those before ``until``: in the stored tables the role of history ends there."""
    rows = orders_by_month(spark, sf_dir, F.sum(F.floor("o_totalprice")))
    return rows.filter(_before(until)).withColumn("source", F.lit("a"))


def source_b(spark: SparkSession, sf_dir: str, until: dt.date | None = CUT) -> DataFrame:
    """A source that starts later than the other one."""
    rows = orders_by_month(spark, sf_dir, F.count("*") * 1000)
    return rows.filter((F.col("month_start") >= F.lit(BASE_MONTH)) & _before(until)).withColumn("source", F.lit("b"))


_warehouses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The stored tables for one data folder, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _warehouses:
        _warehouses[key] = build(spark, sf_dir)
    return _warehouses[key]


def build(spark: SparkSession, sf_dir: str) -> Warehouse:
    wh = Warehouse(spark, fresh_path(spark, "warehouse"), MODES3)
    wh.load(C.clean_daily(stage(daily_rows(spark, sf_dir), "rows"), ROW_ORDER), dealt=True)
    merged = H.merge_prefer(source_b(spark, sf_dir), source_a(spark, sf_dir))
    wh.load_historical(H.historical_monthly(merged, starts=STARTS, default=BASE_MONTH))
    return wh


def current_monthly(wh: Warehouse) -> DataFrame:
    return wh.monthly.filter(F.col("month_start") >= F.lit(CUT))


def monthly_series(wh: Warehouse) -> DataFrame:
    """(series, ds, y) of all modes."""
    return wh.monthly.select(F.col("modo").alias("series"), F.col("month_start").alias("ds"),
                             F.col("total_usos").alias("y"))
