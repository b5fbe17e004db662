"""Indices against a baseline. Each is one pass over the aggregated series: the baseline
is a conditional window aggregate of the group, so nothing is joined back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.functions.numeric import percent, sql_round


def recovery_index(monthly: DataFrame, baseline_years: Sequence[int], modes: Sequence[str], key: str = "modo",
                   value: str = "total_usos") -> DataFrame:
    """Total against the mean of the same month in the baseline years; NULL without one."""
    rows = monthly.filter(F.col(key).isin(*modes)).select("month_start", "year", "month", key, value)
    in_base = F.when(F.col("year").isin(*baseline_years), F.col(value))
    base = F.avg(in_base).over(Window.partitionBy("month", key))
    ratio = F.try_divide(F.col(value).cast("double"), F.col("baseline_avg")) * 100
    return rows.withColumn("baseline_avg", base).withColumn("recovery_index", sql_round(ratio, 2))


def region_recovery(by_province: DataFrame, base_month: dt.date) -> DataFrame:
    """Region totals per month against the region's total in the base month."""
    totals = (by_province.filter(F.col("amba").isin(*S.REGIONS))
              .groupBy("month_start", "amba").agg(F.sum("total_usos").alias("total")))
    at_base = F.when(F.col("month_start") == F.lit(base_month), F.col("total"))
    base = F.max(at_base).over(Window.partitionBy("amba"))
    return (totals.withColumn("_base", base).filter(F.col("_base").isNotNull())
            .select("month_start", "amba", "total", percent(F.col("total"), F.col("_base"), 1).alias("recovery_index")))


def index_to_baseline(df: DataFrame, base_date: dt.date, value: str = "total_usos", group: str = "modo",
                      ds: str = "month_start", out: str = "index_val") -> DataFrame:
    """Values as 100 at the base date, per group; groups without that date are dropped."""
    at_base = F.when(F.col(ds) == F.lit(base_date), F.col(value)).cast("double")
    base = F.max(at_base).over(Window.partitionBy(group))
    return (df.withColumn(out, F.try_divide(F.col(value).cast("double"), base) * 100)
            .filter(F.col(out).isNotNull()))


def region_index(region_totals: DataFrame, base_date: dt.date) -> DataFrame:
    """Region totals with a one-decimal index; NULL where the base is absent or not positive."""
    at_base = F.when(F.col("month_start") == F.lit(base_date), F.col("total"))
    base = F.max(at_base).over(Window.partitionBy("amba"))
    return region_totals.withColumn("_base", base).select(
        "month_start", "amba", "total",
        F.when(F.col("_base") > 0, percent(F.col("total"), F.col("_base"), 1)).alias("recovery_index"))
