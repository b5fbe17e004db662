"""Declared schemas and the fixed domain vocabulary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# The public data files' column names, mode codes and markers.
KNOWN_MODES = ["COLECTIVO", "TREN", "SUBTE", "LANCHAS"]
REPORT_MODES = ["COLECTIVO", "TREN", "SUBTE"]
MODE_ALIASES = {
    "COLECTIVO": "COLECTIVO",
    "TREN": "TREN",
    "SUBTE": "SUBTE",
    "PREMETRO": "SUBTE",
}
HEADER_ALIASES = {
    "fecha": ["fecha", "date", "dia", "dia_transporte"],
    "modo": ["modo", "mode", "tipo", "linea_modo", "tipo_transporte"],
    "cantidad_usos": [
        "cantidad_usos", "usos", "transacciones", "cantidad", "cantidad_transacciones",
    ],
}
REQUIRED = ["fecha", "modo", "cantidad_usos"]
ENRICHMENT_DEFAULTS = {
    "nombre_empresa": "UNKNOWN",
    "linea": "UNKNOWN",
    "amba": "UNKNOWN",
    "jurisdiccion": "UNKNOWN",
    "provincia": "UNKNOWN",
    "municipio": "UNKNOWN",
    "dato_preliminar": "N",
}
UNKNOWN_PROVINCES = ["JN", "SN", "SD", "UNKNOWN"]
REGIONS = ["SI", "NO"]
MODE_LABELS = {
    "es": {"COLECTIVO": "Colectivo (Bus)", "TREN": "Tren", "SUBTE": "Subte"},
    "en": {"COLECTIVO": "Bus", "TREN": "Train", "SUBTE": "Subway"},
}
REGION_LABELS = {
    "es": {"SI": "AMBA", "NO": "Interior"},
    "en": {"SI": "AMBA", "NO": "Interior"},
}
DAILY_FILES = "dat-ab-usos-*.csv"
DAILY_START = dt.date(2020, 1, 1)
TRAIN_START_DEFAULT = dt.date(2016, 1, 1)
TRAIN_START = {"COLECTIVO": dt.date(2013, 1, 1)}
COVID_START, COVID_END = dt.date(2020, 3, 1), dt.date(2021, 12, 1)
LOCKDOWN_START, LOCKDOWN_END = dt.date(2020, 3, 1), dt.date(2021, 7, 31)
REOPENING = dt.date(2022, 1, 1)
TREATMENT = dt.date(2024, 1, 1)
SHOCK_FROM, SHOCK_TO = dt.date(2023, 12, 31), dt.date(2024, 2, 28)
SHOCK_COLORS = ["purple"]
FARE_SCOPES = ["national", "amba", "amba_local"]
ELASTICITY_BENCHMARK = -0.12
HAC_SERIES = ["TREN", "SUBTE"]
HAC_LAGS = 12
TREND_FLEXIBILITY = {"COLECTIVO": 0.05, "TREN": 0.10, "SUBTE": 0.20}
TREND_FLEXIBILITY_DEFAULT = 0.05
FORECAST_MONTHS = 6
MAPE_GOOD, MAPE_ACCEPTABLE = 5.0, 12.0
SIGNIFICANCE = 0.05
# End of fixed values.

DAILY = T.StructType([
    T.StructField("fecha", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("modo", T.StringType()),
    T.StructField("cantidad_usos", T.LongType()),
    T.StructField("is_suspicious", T.BooleanType()),
    T.StructField("source_file", T.StringType()),
    *[T.StructField(name, T.StringType()) for name in ENRICHMENT_DEFAULTS],
])

HISTORICAL = T.StructType([
    T.StructField("month_start", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("modo", T.StringType()),
    T.StructField("total_usos", T.LongType()),
    T.StructField("amba", T.StringType()),
    T.StructField("era", T.StringType()),
    T.StructField("source", T.StringType()),
])


def table_schema(columns: str) -> T.StructType:
    """A schema of plain columns from "name type, ..."; needs no session."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(),
             "timestamp": T.TimestampType(), "array<int>": T.ArrayType(T.IntegerType())}
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])
