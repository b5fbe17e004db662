"""Stored tables that change together: readers see all of a publication or nothing of it.

Every publication writes its new partitions to folders of its own (``gen=…``) and leaves the
others where they are. The list of current partitions of all tables is written last, under the
next number; the highest number whose list was written in full is current. A run that fails
leaves the old list in force, and its folders are removed by the next one.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ridemill import schema as S

LISTS = "_published"
Months = list[tuple[int, int]]


class Entry(NamedTuple):
    """A current part of a table: a month, or the whole table (year and month null)."""

    table: str
    gen: str
    year: int | None
    month: int | None


ENTRY_SCHEMA = S.table_schema("table string, gen string, year int, month int")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table that nothing refers to any more."""
    fs, hadoop = _path(spark, path)
    fs.delete(hadoop, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, hadoop = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()) if fs.exists(hadoop) else []


class Store:
    """Published tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._number, self._entries = -1, []

    def number(self) -> int:
        """Of the current publication; 0 before the first."""
        lists = folders(self.spark, f"{self.root}/{LISTS}")
        return max((int(n) for n in lists if exists(self.spark, f"{self.root}/{LISTS}/{n}/_SUCCESS")), default=0)

    def entries(self) -> list[Entry]:
        number = self.number()
        if number != self._number:
            rows = self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.root}/{LISTS}/{number:08d}").collect() if number else []
            self._number, self._entries = number, [Entry(*r) for r in rows]
        return self._entries

    def has(self, table: str) -> bool:
        return any(e.table == table for e in self.entries())

    def read(self, table: str, schema: T.StructType, months: Months | None = None) -> DataFrame:
        """The current rows of a table, in the columns of ``schema``; only those of ``months`` if given."""
        return read_entries(self.spark, self.root, [e for e in self.entries() if e.table == table and (months is None or (e.year, e.month) in months)], schema)

    def publish(self) -> Publication:
        return Publication(self)


def _months(spark: SparkSession, path: str) -> Months:
    """Month partitions in a folder."""
    return [(int(y.removeprefix("year=")), int(m.removeprefix("month="))) for y in folders(spark, path) if y.startswith("year=") for m in folders(spark, f"{path}/{y}")]


def read_entries(spark: SparkSession, root: str, entries: list[Entry], schema: T.StructType) -> DataFrame:
    paths = []
    for gen in sorted({e.gen for e in entries}):
        path = f"{root}/{entries[0].table}/gen={gen}"
        months = sorted((e.year, e.month) for e in entries if e.gen == gen and e.year is not None)
        # a folder whose months are all current is read as one, without listing every month
        paths += [path] if not months or months == sorted(_months(spark, path)) else [f"{path}/year={y}/month={m}" for y, m in months]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{entries[0].table}").parquet(*paths).select(*schema.fieldNames())


class Publication:
    """Changes to several tables that become current at once, by :meth:`commit`."""

    def __init__(self, store: Store):
        self.spark, self.root, self.store = store.spark, store.root, store
        self.gen, self.base = uuid.uuid4().hex, store.number()
        self.entries = list(store.entries())
        self.schemas: dict[str, T.StructType] = {}

    def replace_months(self, table: str, df: DataFrame, touched: Months | None = None, dealt: bool = False) -> None:
        """Rows of the touched months, all of them; without ``touched`` every month is replaced.

        Rebalancing packs a month's rows into few files and still splits a month too big for one
        task. ``dealt``: the rows are dealt by month already, and another shuffle would be in vain.
        """
        path = f"{self.root}/{table}/gen={self.gen}"
        (df if dealt else df.hint("rebalance", "year", "month")).write.partitionBy("year", "month").parquet(path)
        self.schemas[table] = df.schema
        kept = [e for e in self.entries if e.table != table or (touched is not None and (e.year, e.month) not in touched)]
        self.entries = kept + [Entry(table, self.gen, y, m) for y, m in _months(self.spark, path)]

    def replace(self, table: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{table}/gen={self.gen}")
        self.schemas[table] = df.schema
        self.entries = [e for e in self.entries if e.table != table] + [Entry(table, self.gen, None, None)]

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """A table as it will be."""
        return read_entries(self.spark, self.root, [e for e in self.entries if e.table == table], schema or self.schemas[table])

    def written(self, table: str) -> DataFrame:
        """The rows that this publication has written to a table."""
        return read_entries(self.spark, self.root, [e for e in self.entries if e.table == table and e.gen == self.gen], self.schemas[table])

    def commit(self) -> None:
        """Make the changes current, then remove folders that neither this nor the last publication uses.

        The list is written under the number after the one that the changes were made from: of
        two writers that started from the same one, the second fails.
        """
        earlier = {(e.table, e.gen) for e in self.store.entries()}
        rows = self.spark.createDataFrame([tuple(e) for e in self.entries], ENTRY_SCHEMA).coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.root}/{LISTS}/{self.base + 1:08d}")
        used = earlier | {(e.table, e.gen) for e in self.entries}
        for table in {t for t, _ in used}:
            for gen in folders(self.spark, f"{self.root}/{table}"):
                if (table, gen.removeprefix("gen=")) not in used:
                    remove(self.spark, f"{self.root}/{table}/{gen}")
