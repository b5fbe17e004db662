"""The stored tables and the views on top of them.

``daily_transactions``, the monthly parts that all rollups are made of, and the rollups are
Parquet and published together; views are DataFrames registered as temporary views, so ad-hoc
SQL and the functions of this package see the same names.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.operators import rollups as R
from ridemill.operators import windows as W
from ridemill.plans.store import Months, Publication, Store

# Table and view names.
DAILY, MONTHLY, PROVINCE = "daily_transactions", "monthly_transactions", "monthly_by_provincia"
OPERATORS, HISTORICAL, PARTS = "top_empresas", "monthly_historical", "month_parts"
VIEW_NAMES = ["v_total_daily", "v_yoy_monthly", "v_modal_split", "v_weekday_heatmap", "v_amba_vs_interior"]
# End of fixed values.

TABLES = {
    DAILY: S.DAILY, HISTORICAL: S.HISTORICAL,
    PARTS: S.table_schema("year int, month int, modo string, nombre_empresa string, linea string, provincia string, amba string, total bigint, n bigint, days int"),
    MONTHLY: S.table_schema("month_start date, year int, month int, modo string, total_usos bigint, avg_daily_usos double, days_with_data bigint, suspicious_days bigint"),
    PROVINCE: S.table_schema("month_start date, year int, month int, modo string, provincia string, amba string, total_usos bigint, days_with_data bigint"),
    OPERATORS: S.table_schema("nombre_empresa string, modo string, total_usos bigint, active_days bigint, num_lineas bigint"),
}

@dataclass
class Warehouse:
    spark: SparkSession
    root: str
    modes: tuple[str, ...] = tuple(S.REPORT_MODES)

    store: Store = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, TABLES[name])

    @property
    def daily(self) -> DataFrame:
        return self.table(DAILY)

    @property
    def monthly(self) -> DataFrame:
        return self.table(MONTHLY)

    @property
    def by_province(self) -> DataFrame:
        return self.table(PROVINCE)

    @property
    def operators(self) -> DataFrame:
        return self.table(OPERATORS)

    @property
    def historical(self) -> DataFrame | None:
        """The historical table, or None where it was never loaded."""
        return self.table(HISTORICAL) if self.store.has(HISTORICAL) else None

    def load(self, fact: DataFrame, dealt: bool = False) -> None:
        """Store the daily fact and rebuild the rollups from it. Safe to repeat. ``dealt``: it is dealt by month already."""
        changes = self.store.publish()
        changes.replace_months(DAILY, fact.select(*S.DAILY.fieldNames()), dealt=dealt)
        publish_rollups(changes, changes.written(DAILY))
        changes.commit()

    def load_historical(self, historical: DataFrame) -> DataFrame:
        """Store the historical table; returns the gaps longer than two months."""
        changes = self.store.publish()
        changes.replace(HISTORICAL, historical.select(*S.HISTORICAL.fieldNames()))
        changes.commit()
        return W.series_gaps(self.historical)

    def monthly_read(self) -> DataFrame:
        return self.monthly.filter(F.col("modo").isin(*self.modes))

    def historical_read(self) -> DataFrame:
        """Historical rows of the reported modes; an empty typed frame without the table."""
        columns = ["month_start", "modo", "total_usos", "amba", "era", "source"]
        table = self.historical
        if table is None:
            return self.spark.createDataFrame([], S.HISTORICAL).select(*columns)
        return table.filter(F.col("modo").isin(*self.modes)).select(*columns)

    def combined_monthly(self) -> DataFrame:
        return W.union_monthly(self.historical, self.monthly, self.modes)

    def views(self) -> dict[str, DataFrame]:
        daily, monthly, province = self.daily, self.monthly, self.by_province
        return dict(zip(VIEW_NAMES, [
            R.total_daily(daily), W.yoy(monthly), W.modal_split(monthly),
            R.weekday_heatmap(daily), W.amba_split(province)], strict=True))

    def register(self) -> None:
        """Temporary views for all tables and views."""
        tables = {DAILY: self.daily, MONTHLY: self.monthly, PROVINCE: self.by_province, OPERATORS: self.operators}
        if self.historical is not None:
            tables[HISTORICAL] = self.historical
        for name, df in {**tables, **self.views()}.items():
            df.createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        """Ad-hoc SQL over the registered names."""
        self.register()
        return self.spark.sql(sql)


def publish_rollups(changes: Publication, daily: DataFrame, touched: Months | None = None) -> None:
    """The rollups after a change of the daily rows of the touched months (of all, if not given).

    One scan of those rows makes the months' parts. The rollups are made of the parts of all
    months, which are small beside the fact; the fact's other months are not read.
    """
    changes.replace_months(PARTS, R.month_parts(daily), touched, dealt=True)
    parts = changes.read(PARTS, TABLES[PARTS])
    rollups = {MONTHLY: R.monthly_from_parts, PROVINCE: R.provinces_from_parts, OPERATORS: R.operators_from_parts}
    with ThreadPoolExecutor(len(rollups)) as pool:
        list(pool.map(lambda name: changes.replace(name, rollups[name](parts).select(*TABLES[name].fieldNames())), rollups))
