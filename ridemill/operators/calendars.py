"""Joins with dated dimensions: labels, as-of sums, compounded changes, break dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemill import schema as S
from ridemill.session import stage

# Label prefixes per language.
PREFIXES = {
    "es": ("Feriado: ", "Feriado adj. ({}d): "),
    "en": ("Holiday: ", "Adjacent holiday ({}d): "),
}
# End of fixed values.


def event_labels(events: DataFrame, lang: str = "es") -> DataFrame:
    """One label per date: the last entry of a repeated date counts, an empty one counts as none."""
    text = F.coalesce(F.col(f"label_{lang}"), F.col("label_es"), F.lit(""))
    return (events.groupBy("date").agg(F.max_by(text, "seq").alias("label"))
            .filter(F.col("label") != ""))


def holiday_labels(holidays: DataFrame, lang: str = "es") -> DataFrame:
    """Labels for each holiday and its two neighbours: exact, then day before, then day after.

    Every holiday becomes three dated rows, which turns the ±1 day lookup into an equi-join.
    """
    exact, adjacent = PREFIXES["en" if lang == "en" else "es"]
    name = F.coalesce(F.col(f"name_{lang}"), F.col("name_es"), F.lit(""))
    single = holidays.groupBy("date").agg(F.max_by(name, "seq").alias("name"))
    spread = F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("date").alias("on"), F.lit(exact).alias("prefix")),
        F.struct(F.lit(2).alias("rank"), F.date_add("date", 1).alias("on"), F.lit(adjacent.format("-1")).alias("prefix")),
        F.struct(F.lit(3).alias("rank"), F.date_sub("date", 1).alias("on"), F.lit(adjacent.format("+1")).alias("prefix")),
    ))
    return (single.select("name", spread.alias("s"))
            .groupBy(F.col("s.on").alias("date"))
            .agg(F.min_by(F.concat("s.prefix", "name"), "s.rank").alias("label")))


def label_events(df: DataFrame, events: DataFrame, ds: str = "ds", lang: str = "es", out: str = "event_label") -> DataFrame:
    names = event_labels(events, lang).select(F.col("date").alias("_on"), F.col("label").alias(out))
    return (df.join(names, F.col(ds) == F.col("_on"), "left").drop("_on")
            .withColumn(out, F.coalesce(out, F.lit(""))))


def label_holidays(df: DataFrame, events: DataFrame, holidays: DataFrame, ds: str = "ds", lang: str = "es",
                   out: str = "event_label") -> DataFrame:
    """Event label, else holiday label, else ''. Both dimensions are folded into one label
    per date first, so the facts are joined once."""
    ranked = (event_labels(events, lang).withColumn("rank", F.lit(0))
              .unionByName(holiday_labels(holidays, lang).withColumn("rank", F.lit(1))))
    names = (ranked.groupBy("date").agg(F.min_by("label", "rank").alias(out))
             .withColumnRenamed("date", "_on"))
    return (df.join(names, F.col(ds) == F.col("_on"), "left").drop("_on")
            .withColumn(out, F.coalesce(out, F.lit(""))))


def running_by_date(points: DataFrame, ds: str, dim: DataFrame, dim_date: str, **amounts: Column) -> DataFrame:
    """(date, one column per amount): sums over dimension rows dated on or before each date in ``points``.

    Points and dimension are first reduced to one row per date, so the unpartitioned
    window sees at most the days of the calendar whatever the size of the facts. No
    range join is involved. The result is staged: its measured size, not an estimate
    inherited from the facts, then decides how it is joined to them.
    """
    steps = dim.groupBy(F.col(dim_date).alias("date")).agg(
        *[F.sum(amount).alias(name) for name, amount in amounts.items()])
    dates = points.select(F.col(ds).alias("date")).distinct().withColumn("wanted", F.lit(True))
    both = dates.join(steps, "date", "full_outer")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = [F.sum(F.coalesce(name, F.lit(0))).over(so_far).alias(name) for name in amounts]
    return stage(both.select("date", "wanted", *running).filter("wanted").drop("wanted"), "running")


def asof_cumsum(df: DataFrame, dim: DataFrame, ds: str = "ds", dim_date: str = "date", amount: str = "magnitude",
                out: str = "fare_pressure") -> DataFrame:
    """Sum of all amounts that took effect by each row's date (inclusive)."""
    table = running_by_date(df, ds, dim, dim_date, running=F.col(amount))
    return (df.join(table.select(F.col("date").alias("_on"), F.col("running").alias(out)),
                    F.col(ds) == F.col("_on"), "left").drop("_on"))


def fare_rises(hikes: DataFrame, scopes: Sequence[str] = tuple(S.FARE_SCOPES)) -> DataFrame:
    return hikes.filter(F.col("scope").isin(*scopes) & (F.col("magnitude") > 0))


def _log_growth(magnitude: str = "magnitude") -> Column:
    return F.log1p(F.col(magnitude).cast("double") / 100)


def compound_in_window(df: DataFrame, hikes: DataFrame, start: str, end: str, scopes: Sequence[str] = tuple(S.FARE_SCOPES),
                       include_start: bool = False) -> DataFrame:
    """Compounded % and number of rises in (start, end], or [start, end], per row of ``df``.

    The product over an interval is the ratio of two running products, so each end is an
    as-of lookup by date instead of an interval join.
    """
    rises = fare_rises(hikes, scopes)
    low = F.date_sub(start, 1) if include_start else F.col(start)
    keyed = df.withColumns({"_low": low, "_high": F.col(end)})
    ends = keyed.select(F.explode(F.array("_low", "_high")).alias("date"))
    table = running_by_date(ends, "date", rises, "date", g=_log_growth(), n=F.lit(1))
    lo = table.select(F.col("date").alias("_low"), F.col("g").alias("_g0"), F.col("n").alias("_n0"))
    hi = table.select(F.col("date").alias("_high"), F.col("g").alias("_g1"), F.col("n").alias("_n1"))
    empty = F.col("_high") <= F.col("_low")
    return (keyed.join(lo, "_low", "left").join(hi, "_high", "left")
            .withColumn("n_hikes", F.when(empty, 0).otherwise(F.col("_n1") - F.col("_n0")).cast("bigint"))
            .withColumn("hike_pct", F.when(empty, 0.0).otherwise(F.expm1(F.col("_g1") - F.col("_g0")) * 100))
            .drop("_low", "_high", "_g0", "_g1", "_n0", "_n1"))


def cumulative_hike_pct(hikes: DataFrame, after: dt.date, until: dt.date,
                        scopes: Sequence[str] = tuple(S.FARE_SCOPES)) -> Column:
    """The same for one fixed window (after, until], as a scalar subquery."""
    inside = fare_rises(hikes, scopes).filter(
        (F.col("date") > F.lit(after)) & (F.col("date") <= F.lit(until)))
    factor = F.product(1 + F.col("magnitude").cast("double") / 100)
    return inside.agg((F.coalesce(factor, F.lit(1.0)) - 1) * 100).scalar()


def macro_shock(ds: Column, events: DataFrame, colors: Sequence[str] = tuple(S.SHOCK_COLORS)) -> Column:
    """1 from the first event of the given colours on, 0 before it or without any."""
    first = events.filter(F.col("color").isin(*colors)).agg(F.min("date")).scalar()
    return F.coalesce((ds >= first).cast("int"), F.lit(0))


def break_dates(hikes: DataFrame, events: DataFrame, colors: Sequence[str] = tuple(S.SHOCK_COLORS)) -> DataFrame:
    """Distinct dates of all fare changes (freezes too) and of the shock events."""
    return (hikes.select("date")
            .union(events.filter(F.col("color").isin(*colors)).select("date")).distinct())


def changepoints(breaks: DataFrame, series_range: DataFrame, first: str = "first_ds", last: str = "last_ds") -> DataFrame:
    """Break dates inside each series' training range: first <= date < last.

    ``series_range`` has one row per series; the dates are a dimension of fixed size, so
    they travel as one array and are filtered in place instead of joined by range.
    """
    dates = breaks.select(F.col("date").cast("date")).distinct().agg(F.array_sort(F.collect_list("date"))).scalar()
    inside = F.filter(F.col("_dates"), lambda d: (d >= F.col(first)) & (d < F.col(last)))
    return (series_range.withColumn("_dates", dates)
            .withColumn("changepoint", F.explode(inside)).drop("_dates"))
