"""Small dated dimensions as DataFrames: built in, from rows, or from a file."""

from __future__ import annotations

import csv
import datetime as dt
import io
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ridemill.sources import calendar_tables

EVENT_SCHEMA = "seq int, date date, label_es string, label_en string, color string"
HIKE_SCHEMA = "seq int, date date, scope string, magnitude int, label_es string, label_en string"
HOLIDAY_SCHEMA = "seq int, date date, name_es string, name_en string, type string"


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A dimension from literal rows; ``seq`` (entry order) is added in front.

    Built through Arrow it is a local relation of exact size, so joins against it are
    broadcast by Spark's own size check and by nothing else.
    """
    return local_table(spark, [(i, *row) for i, row in enumerate(rows)], schema)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    parsed = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(parsed)
    table = pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(parsed, columns)})
    return spark.createDataFrame(table, parsed)


def _built_in(spark: SparkSession, text: str, schema: str) -> DataFrame:
    table = list(csv.reader(io.StringIO(text.strip()), delimiter="|", quoting=csv.QUOTE_NONE))
    types = T._parse_datatype_string(schema)
    rows = []
    for record in table[1:]:
        row = []
        for value, field in zip(record, list(types)[1:], strict=True):
            if isinstance(field.dataType, T.DateType):
                row.append(dt.date.fromisoformat(value))
            elif isinstance(field.dataType, T.IntegerType):
                row.append(int(value))
            else:
                row.append(value)
        rows.append(row)
    return from_rows(spark, rows, schema)


def events(spark: SparkSession) -> DataFrame:
    return _built_in(spark, calendar_tables.EVENTS, EVENT_SCHEMA)


def fare_hikes(spark: SparkSession) -> DataFrame:
    return _built_in(spark, calendar_tables.FARE_HIKES, HIKE_SCHEMA)


def holidays(spark: SparkSession) -> DataFrame:
    return _built_in(spark, calendar_tables.HOLIDAYS, HOLIDAY_SCHEMA)


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A user's own dimension file (.csv, .json, .parquet, or a .yaml list of flat records).

    Records carry the schema's columns without ``seq``; extra fields are ignored.
    """
    fields = list(T._parse_datatype_string(schema))[1:]
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = spark.read.text(path, wholetext=True).first().value
        records = yaml.safe_load(text)
        rows = [[None if r.get(f.name) is None else str(r[f.name]) for f in fields] for r in records]
        raw = from_rows(spark, rows, ", ".join(["seq int", *[f"{f.name} string" for f in fields]]))
        return raw.select("seq", *[F.col(f.name).cast(f.dataType) for f in fields])
    reader = spark.read.schema(T.StructType(fields))
    if path.endswith(".csv"):
        raw = reader.csv(path, header=True, enforceSchema=False)
    elif path.endswith(".json"):
        raw = reader.json(path)
    else:
        raw = reader.parquet(path)
    return raw.select(F.monotonically_increasing_id().alias("seq"), "*")


def labels(spark: SparkSession, mapping: dict[str, str], code: str, label: str) -> DataFrame:
    return local_table(spark, list(mapping.items()), f"{code} string, {label} string")
