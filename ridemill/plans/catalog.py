"""The registered queries: every operator bound to the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemill.functions import numeric as N
from ridemill.functions import parsing as P
from ridemill.operators import baselines as B
from ridemill.operators import calendars as K
from ridemill.operators import cleaning as C
from ridemill.operators import diagnostics as G
from ridemill.operators import forecasting as FC
from ridemill.operators import loess as L
from ridemill.operators import regression as X
from ridemill.operators import rollups as R
from ridemill.operators import series as Z
from ridemill.operators import windows as W
from ridemill.plans import testdata as T
from ridemill.session import fresh_path, stage
from ridemill.sources import daily as SD
from ridemill.sources import dimensions as D
from ridemill.sources import historical as H
from ridemill.sources import manifest as M
from ridemill.streaming import daily as JD
from ridemill.streaming import refresh as JR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def wh_query(name: str, fn: Callable[[T.Warehouse], DataFrame]) -> None:
    """A query over the stored tables only."""
    QUERIES[name] = lambda spark, sf: fn(T.warehouse(spark, sf))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: N.sql_round(F.col(c), digits) for c in columns})


# Stored tables and rollups

wh_query("fact_daily", lambda wh: wh.daily)
wh_query("monthly_rollup", lambda wh: R.monthly_rollup(wh.daily))
wh_query("monthly_by_province", lambda wh: R.monthly_by_province(wh.daily))
wh_query("operator_totals", lambda wh: R.operator_totals(wh.daily))
wh_query("total_daily", lambda wh: R.total_daily(wh.daily))
wh_query("weekday_heatmap", lambda wh: R.weekday_heatmap(wh.daily))
wh_query("daily_by_mode", lambda wh: R.daily_by_mode(wh.daily, T.MODES3))
wh_query("daily_series", lambda wh: R.daily_series(wh.daily, T.MODES3))
wh_query("region_by_mode", lambda wh: R.region_by_mode(wh.by_province, T.MODES3))
wh_query("province_totals", lambda wh: R.province_totals(wh.by_province))
wh_query("modal_statistics", lambda wh: rounded(R.modal_statistics(wh.monthly, T.MODES3), 6, "avg_daily"))
wh_query("adhoc_mode_totals", lambda wh: wh.query(
    "SELECT modo, SUM(cantidad_usos) AS total FROM daily_transactions GROUP BY 1"))
wh_query("heatmap_pivot", lambda wh: R.heatmap_pivot(
    R.daily_by_mode(wh.daily, T.MODES3), T.MODES3, exclude=T.SPECIAL))
wh_query("kpis", lambda wh: R.kpis(R.daily_by_mode(wh.daily, T.MODES3)))
wh_query("latest_share", lambda wh: R.latest_share(wh.monthly, T.MODES3))
wh_query("profile", lambda wh: R.profile(wh.daily))
wh_query("profile_modes", lambda wh: R.profile_modes(wh.daily))
wh_query("seasonal_amplitude", lambda wh: R.seasonal_amplitude(_regions(wh)))
wh_query("top_operators", lambda wh: R.top_operators(wh.operators, T.MODES3))
wh_query("monthly_read", lambda wh: wh.monthly_read())
wh_query("historical_monthly", lambda wh: wh.historical)
wh_query("historical_read", lambda wh: wh.historical_read())


def _regions(wh: T.Warehouse) -> DataFrame:
    return R.region_totals(R.region_by_mode(wh.by_province, T.MODES3))


def _combined(wh: T.Warehouse) -> DataFrame:
    return W.union_monthly(wh.historical, T.current_monthly(wh), T.MODES3)


@query
def labelled_top(spark: SparkSession, sf: str) -> DataFrame:
    wh = T.warehouse(spark, sf)
    names = D.labels(spark, {"1-URGENT": "Urgent", "2-HIGH": "High"}, "modo", "modo_label")
    return R.labelled(R.top_operators(wh.operators, T.MODES3), names, "modo", "modo_label", "nombre_empresa", 12)


# Windows, unions, baselines

wh_query("yoy", lambda wh: W.yoy(wh.monthly))
wh_query("modal_split", lambda wh: W.modal_split(wh.monthly))
wh_query("amba_split", lambda wh: W.amba_split(wh.by_province))
wh_query("amba_region_share", lambda wh: W.amba_region_share(wh.by_province))
wh_query("combined_monthly", _combined)
wh_query("modal_share_full", lambda wh: W.modal_share_full(_combined(wh), T.MODES3, T.BASE_MONTH))
wh_query("mom_pct", lambda wh: W.mom_pct(_combined(wh)))
wh_query("rolling_stats", lambda wh: W.rolling_stats(R.total_daily(wh.daily)))
wh_query("recovery_index", lambda wh: B.recovery_index(wh.monthly, [1996, 1997], T.MODES3))
wh_query("amba_recovery", lambda wh: B.region_recovery(wh.by_province, T.BASE_MONTH))
wh_query("region_index", lambda wh: B.region_index(_regions(wh), T.BASE_MONTH))
wh_query("index_to_baseline", lambda wh: B.index_to_baseline(_combined(wh), T.BASE_MONTH))
wh_query("rolling_min_periods", lambda wh: rounded(
    W.rolling_min_periods(B.region_index(_regions(wh), T.BASE_MONTH), "recovery_index", ["amba"]), 6, "rolling_12"))


def _selected(wh: T.Warehouse) -> DataFrame:
    return W.daily_selected(R.daily_by_mode(wh.daily, T.MODES3), ["1-URGENT", "2-HIGH"],
                            dt.date(1996, 1, 1), dt.date(2000, 12, 31))


wh_query("daily_selected", _selected)
wh_query("rolling_by_mode", lambda wh: W.rolling_by_mode(_selected(wh)))
wh_query("avg_per_day", lambda wh: W.with_daily_average(_combined(wh), T.CUT))
wh_query("series_junction", lambda wh: W.series_junction(
    W.with_daily_average(_combined(wh), T.CUT),
    R.daily_by_mode(wh.daily, T.MODES3).filter(F.col("fecha") >= F.lit(T.CUT)), dt.date(1997, 1, 2)))


wh_query("period_index", lambda wh: B.index_to_baseline(
    W.in_period(wh.monthly_read(), *T.SPECIAL), T.SPECIAL[0]).select("month_start", "modo", "total_usos", "index_val"))
wh_query("yoy_period", lambda wh: W.in_period(R.in_modes(W.yoy(wh.monthly), T.MODES3), *T.SPECIAL).filter(
    F.col("yoy_pct_change").isNotNull()).select("month_start", "modo", "yoy_pct_change"))


@query
def series_gaps(spark: SparkSession, sf: str) -> DataFrame:
    months = T.read(spark, sf, "orders").select(
        "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month_start")).distinct()
    return W.series_gaps(months, "o_custkey")


@query
def merge_prefer(spark: SparkSession, sf: str) -> DataFrame:
    return H.merge_prefer(T.source_b(spark, sf, until=None), T.source_a(spark, sf, until=None))


@query
def clip_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return H.clip_by_group(merge_prefer(spark, sf), starts=T.STARTS, default=T.BASE_MONTH)


# Calendar dimensions

@query
def label_events(spark: SparkSession, sf: str) -> DataFrame:
    totals = R.total_daily(T.warehouse(spark, sf).daily).select("fecha", "total_usos")
    return K.label_events(totals, T.events_dim(spark), "fecha", "en")


@query
def label_holidays(spark: SparkSession, sf: str) -> DataFrame:
    totals = R.total_daily(T.warehouse(spark, sf).daily).select("fecha", "total_usos")
    return K.label_holidays(totals, T.events_dim(spark), T.holidays_dim(spark), "fecha", "en")


@query
def asof_cumsum(spark: SparkSession, sf: str) -> DataFrame:
    totals = R.total_daily(T.warehouse(spark, sf).daily).select("fecha", "total_usos")
    return K.asof_cumsum(totals, T.hikes_dim(spark), "fecha")


@query
def compound_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """For every month: the rises of the twelve months before it."""
    months = T.warehouse(spark, sf).monthly.select(
        "modo", "month_start", F.add_months("month_start", -12).alias("win_start"),
        F.date_sub("month_start", 1).alias("win_end"))
    return rounded(K.compound_in_window(months, T.hikes_dim(spark), "win_start", "win_end", include_start=True), 6, "hike_pct")


@query
def changepoints(spark: SparkSession, sf: str) -> DataFrame:
    ranges = T.monthly_series(T.warehouse(spark, sf)).groupBy("series").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    return K.changepoints(K.break_dates(T.hikes_dim(spark), T.events_dim(spark)), ranges)


@query
def macro_shock(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.monthly_series(T.warehouse(spark, sf))
    return rows.withColumn("macro_shock", K.macro_shock(F.col("ds"), T.events_dim(spark)))


wh_query("window_flag", lambda wh: T.monthly_series(wh).withColumn("covid_impact", N.window_flag(F.col("ds"), *T.SPECIAL)))
wh_query("momentum", lambda wh: rounded(
    T.monthly_series(wh).withColumn("recovery_momentum", N.momentum(F.col("ds"), T.REOPENING)), 10, "recovery_momentum"))
wh_query("future_spine", lambda wh: FC.future_spine(T.monthly_series(wh)))
wh_query("floor_by_series", lambda wh: FC.floor_by_series(T.monthly_series(wh)))


# Daily series

def _filled(wh: T.Warehouse) -> DataFrame:
    return Z.gap_fill(R.daily_series(wh.daily, T.MODES3))


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    parts = Z.decompose(_filled(T.warehouse(spark, sf)))
    return Z.anomalies(parts, 3.0, T.events_dim(spark), T.holidays_dim(spark), "en")


wh_query("gap_fill", _filled)
wh_query("decompose", lambda wh: rounded(Z.decompose(_filled(wh)), 4, "trend", "seasonal", "residual"))
wh_query("decompose_loess", lambda wh: L.decompose_loess(_filled(wh)))


@query
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_anomalies(spark, sf), 4, "residual", "z_score")


@query
def anomalies_explained(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Z.split_explained(_anomalies(spark, sf)).select("series", "ds", "z_score", "event_label", "explained"), 4, "z_score")


@query
def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Z.anomaly_counts(_anomalies(spark, sf))


@query
def anomaly_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Z.anomaly_table(_anomalies(spark, sf)), 4, "z_score")


# Regression

def _features(wh: T.Warehouse) -> DataFrame:
    return X.its_features(T.monthly_series(wh), T.TREATMENT, T.SPECIAL)


def _fitted(wh: T.Warehouse) -> tuple[DataFrame, DataFrame]:
    features = stage(X.enough_after(_features(wh)), "features")
    return features, stage(X.its_fit(features), "fit")


@query
def its_fit(spark: SparkSession, sf: str) -> DataFrame:
    _, fit = _fitted(T.warehouse(spark, sf))
    names = F.array(*[F.lit(n) for n in X.FEATURES])
    terms = F.explode(F.arrays_zip(F.col("beta").alias("beta"), names.alias("term"))).alias("c")
    return rounded(fit.select("series", terms).select("series", "c.term", "c.beta"), 4, "beta")


@query
def its_hac(spark: SparkSession, sf: str) -> DataFrame:
    """Robust standard errors of the level and slope terms of every series."""
    out = X.its_inference(*_fitted(T.warehouse(spark, sf)), None)
    columns = ["beta_level", "beta_level_se", "beta_slope", "beta_slope_se"]
    return rounded(out.select("series", "n_obs", *columns), 4, *columns)


INFERRED = {"pre_mean": 6, "r2": 8, **{f"{a}_{n}{b}": d for n in ("level", "slope") for a, b, d in (
    ("beta", "", 4), ("beta", "_se", 4), ("pvalue", "", 8), ("ci", "_lo", 4), ("ci", "_hi", 4))}}


def _rounded_to(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: N.sql_round(F.col(c), d) for c, d in digits.items()})


@query
def its_inference(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_to(X.its_inference(*_fitted(T.warehouse(spark, sf)), ["2-HIGH", "3-MEDIUM"]), INFERRED)


@query
def counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.counterfactual(*_fitted(T.warehouse(spark, sf))), 4, "fitted", "counterfactual", "gap")


@query
def its_metrics(spark: SparkSession, sf: str) -> DataFrame:
    features, fit = _fitted(T.warehouse(spark, sf))
    metrics = X.its_metrics(X.counterfactual(features, fit), X.its_inference(features, fit, ["2-HIGH", "3-MEDIUM"]))
    return _rounded_to(metrics, {"cumulative_gap": 4, "latest_gap_pct": 6, "beta_slope": 4, "pvalue_slope": 8})


wh_query("its_features", _features)


@query
def its_effect(spark: SparkSession, sf: str) -> DataFrame:
    effect = X.its_analysis(T.monthly_series(T.warehouse(spark, sf)), T.hikes_dim(spark), T.TREATMENT, T.SPECIAL,
                            ["2-HIGH", "3-MEDIUM"], *T.SHOCK)
    return _rounded_to(effect, {**INFERRED, "initial_hike_pct": 6, "pct_level_change": 6, "implied_elasticity": 6})


# Forecasts and diagnostics

def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return FC.forecast(
        T.monthly_series(T.warehouse(spark, sf)), T.hikes_dim(spark), T.events_dim(spark), starts=T.STARTS,
        default_start=T.BASE_MONTH, special=T.SPECIAL, reopening=T.REOPENING, flexibility=T.FLEXIBILITY)


@query
def forecast(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_forecast(spark, sf), 2, "yhat", "yhat_lower", "yhat_upper", "trend")


@query
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.diagnostics(_forecast(spark, sf), *T.SPECIAL), 6, "lb_stat", "lb_pvalue")


def _naive(wh: T.Warehouse) -> DataFrame:
    """A forecast table that SQL can build too: last year's value."""
    w = F.lag("y", 12).over(W.Window.partitionBy("series").orderBy("ds"))
    known = F.col("ds") <= F.lit(T.LAST_KNOWN)
    return T.monthly_series(wh).select(
        "series", "ds", (~known).alias("is_forecast"), F.coalesce(w, F.col("y")).cast("double").alias("yhat"),
        F.when(known, F.col("y").cast("double")).alias("actual"))


def _verdicts(wh: T.Warehouse) -> DataFrame:
    rows = stage(_naive(wh), "naive")
    table = (G.forecast_errors(rows).join(G.errors_by_period(rows, *T.SPECIAL), "series")
             .join(G.ljung_box(G.residuals_after(rows, T.SPECIAL[1])), "series"))
    return table.withColumn("verdict", G.verdict(F.coalesce("mape_post", "mape"), 12.0, 20.0))


wh_query("forecast_summary", lambda wh: FC.forecast_summary(_naive(wh)))
wh_query("forecast_joined", lambda wh: FC.forecast_joined(_naive(wh)))
wh_query("forecast_errors", lambda wh: rounded(G.forecast_errors(_naive(wh)), 8, "mape", "rmse", "mae"))
wh_query("errors_by_period", lambda wh: rounded(
    G.errors_by_period(_naive(wh), *T.SPECIAL), 8, "mape_pre", "mape_covid", "mape_post"))
wh_query("ljung_box", lambda wh: rounded(
    G.ljung_box(G.residuals_after(_naive(wh), T.SPECIAL[1])), 8, "lb_stat", "lb_pvalue"))
wh_query("verdict", lambda wh: rounded(
    _verdicts(wh).select("series", "mape_post", "autocorrelated", "verdict"), 8, "mape_post"))
wh_query("verdict_summary", lambda wh: G.verdict_summary(_verdicts(wh)))
wh_query("verdict_members", lambda wh: G.verdict_members(_verdicts(wh)))


# Cleaning

@query
def flag_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "events").select("event_id", "event_type", "value")
    return C.flag_outliers(rows, "value", ["event_type"])


@query
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    order = [c for c in rows.columns if c not in keys]
    return C.keep_first(rows, keys, order).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query
def flag_zero_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return T.daily_rows(spark, sf).groupBy("fecha", "modo").agg(
        F.count("*").alias("n_rows"), F.count_if(C.zero_on_weekday()).alias("n_flagged"))


@query
def unknown_modes(spark: SparkSession, sf: str) -> DataFrame:
    return SD.unknown_modes(T.daily_rows(spark, sf), known=T.MODES3)


@query
def map_modes(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.read(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("\t")).alias("modo"))
    return H.map_modes(raw, mapping={
        "1-URGENT": "1-URGENT", "2-HIGH": "2-HIGH", "3-MEDIUM": "3-MEDIUM", "4-NOT SPECIFIED": "3-MEDIUM"})


@query
def filter_prefix(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.read(spark, sf, "events").select("event_id", F.initcap("event_type").alias("_kind"), "event_type")
    return H.filter_prefix(raw, "_kind", "PUR").drop("_kind")


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.read(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("  "), F.lower("p_name"), F.lit("\t")).alias("p_name"),
        F.concat(F.lower("p_brand"), F.lit(" ")).alias("p_brand"))
    return C.normalize_text(raw, ["p_name", "p_brand", "absent"])


def _grouped(n: Column, separator: str) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(separator))


def parsed_once(df: DataFrame, name: str, text: Column, parse: Callable[[Column], Column], *keep: str) -> DataFrame:
    """The rows whose text can be read. The text is a column before it is parsed, so it is made once.

    The filter uses a row number made beside the parsed column, so it can neither be dropped
    nor let the filter pass below, where it would parse a second time.
    """
    rows = df.select(*keep, text.alias("_text")).select(*keep, parse(F.col("_text")).alias(name), F.monotonically_increasing_id().alias("_row"))
    return rows.filter(F.col(name).isNotNull() & (F.col("_row") >= 0)).drop("_row")


@query
def parse_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted, spaced and comma thousands; one return flag carries text without digits."""
    n = F.floor("l_extendedprice")
    text = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("n/d "), F.lower("l_linestatus")))
            .when(F.col("l_returnflag") == "N", _grouped(n, "."))
            .otherwise(F.concat(F.lit("$ "), _grouped(n, ","))))
    return parsed_once(T.read(spark, sf, "lineitem"), "quantity", text, P.parse_count, "l_orderkey", "l_linenumber")


def _by_priority(*choices: Column) -> Column:
    text = choices[-1]
    for mode, choice in zip(T.MODES5, choices[:-1]):
        text = F.when(F.col("o_orderpriority") == mode, choice).otherwise(text)
    return F.when(F.col("o_orderstatus") == "P", F.lit("not-a-date")).otherwise(text)


@query
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Five layouts by priority; one order status carries unreadable dates."""
    day = F.col("o_orderdate").cast("date")
    text = _by_priority(
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "yyyyMMdd"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.date_format(day, "d MMM yyyy"))
    return parsed_once(T.read(spark, sf, "orders"), "fecha", P.date_text(text), lambda c: P.parse_date(c, ready=True), "o_orderkey")


@query
def parse_period(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = _by_priority(
        F.date_format(day, "yyyyMM"), F.date_format(day, "yyyy-M"), F.date_format(day, "MM/yyyy"),
        F.date_format(day, "MMM-yyyy"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy/MM")).otherwise(F.date_format(day, "MMMM-yyyy")))
    return parsed_once(T.read(spark, sf, "orders"), "month_start", P.strip(text), P.parse_period, "o_orderkey")


# Text files written from the tables and scanned back

def _export_daily(spark: SparkSession, sf: str) -> str:
    """The fact as extracts of two layouts: full and comma-separated up to 1998, and
    minimal, aliased and semicolon-separated from 1999 on."""
    folder = fresh_path(spark, "raw")
    daily = T.warehouse(spark, sf).daily
    (daily.filter("year < 1999").select(
        F.date_format("fecha", "yyyy-MM-dd").alias("DIA_TRANSPORTE"),
        F.lower("nombre_empresa").alias("NOMBRE_EMPRESA"), F.col("linea").alias("LINEA"), F.col("amba").alias("AMBA"),
        F.lower("modo").alias("TIPO_TRANSPORTE"), F.col("jurisdiccion").alias("JURISDICCION"),
        F.col("provincia").alias("PROVINCIA"), F.col("municipio").alias("MUNICIPIO"),
        F.col("cantidad_usos").cast("string").alias("CANTIDAD_USOS"), F.col("dato_preliminar").alias("DATO_PRELIMINAR"))
     .write.option("header", True).csv(f"{folder}/full"))
    (daily.filter("year >= 1999").groupBy("fecha", "modo").agg(F.sum("cantidad_usos").alias("n"))
     .select(F.date_format("fecha", "M/d/yyyy").alias("Fecha"), F.col("modo").alias("TIPO"),
             _grouped(F.col("n"), ".").alias("transacciones"))
     .write.option("header", True).option("sep", ";").csv(f"{folder}/minimal"))
    return folder


@query
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "extract")
    (T.warehouse(spark, sf).daily.select(
        F.date_format("fecha", "M/d/yyyy").alias(" Fecha"), F.col("modo").alias("Modo "),
        F.col("cantidad_usos").cast("string").alias("USOS"))
     .write.option("header", True).option("sep", ";").csv(path))
    parsed = C.parse_daily(SD.scan_csv(spark, path))
    return parsed.groupBy("fecha", "modo").agg(F.count("*").alias("n_rows"), F.sum("cantidad_usos").alias("total"))


@query
def scan_all(spark: SparkSession, sf: str) -> DataFrame:
    folder = _export_daily(spark, sf)
    parsed = stage(C.parse_daily(SD.scan_all(spark, folder, "*/*.csv")), "parsed")
    fact = C.clean_daily(parsed, [C.POSITION])
    return fact.groupBy("fecha", "modo", F.initcap("nombre_empresa").alias("_op")).agg(
        F.count("*").alias("n_rows"), F.sum("cantidad_usos").alias("total")).select(
        "fecha", "modo", F.when(F.col("_op") == "Unknown", "UNKNOWN").otherwise(F.col("_op")).alias("nombre_empresa"),
        "n_rows", "total")


@query
def scan_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Operator names with line feeds, a blank line, doubled quotes and separators, read in splits."""
    path = fresh_path(spark, "quoted")
    name = F.concat(F.lower("nombre_empresa"), F.lit('\ndicha "'), F.lower("linea"), F.lit('",\n\ny otros'))
    (T.warehouse(spark, sf).daily.select(
        F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), F.col("modo"), name.alias("nombre_empresa"), F.col("linea"),
        F.col("cantidad_usos").cast("string").alias("cantidad"))
     .write.option("header", True).option("escape", '"').csv(path))
    parsed = C.parse_daily(SD.scan_csv(spark, path))
    return parsed.groupBy("fecha", "nombre_empresa").agg(F.count("*").alias("n_rows"), F.sum("cantidad_usos").alias("total"))


def _yearly_files(daily: DataFrame, folder: str, quantity: str) -> None:
    """Extracts of one year each, a file a month: no task holds a year's rows."""
    (daily.select("year", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), F.col("modo").alias("tipo_transporte"),
                  F.col("cantidad_usos").cast("string").alias(quantity))
     .repartition("year", F.substring("fecha", 1, 7)).write.partitionBy("year").option("header", True).csv(folder))


@query
def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per file they come from, by name; the files hold one year each."""
    folder = fresh_path(spark, "yearly")
    _yearly_files(T.warehouse(spark, sf).daily, folder, "usos")
    parsed = C.parse_daily(SD.scan_all(spark, folder, "*/*.csv"))
    return parsed.groupBy(F.regexp_replace("source_file", "^part-.*[.]csv$", "part.csv").alias("source_file"), "year").agg(
        F.count("*").alias("n_rows"), F.sum("cantidad_usos").alias("total"))


@query
def refused_files(spark: SparkSession, sf: str) -> DataFrame:
    """Of the yearly files those from 1999 on lack the required count column and are left out."""
    folder = fresh_path(spark, "partly")
    daily = T.warehouse(spark, sf).daily
    _yearly_files(daily.filter("year < 1999"), f"{folder}/good", "usos")
    _yearly_files(daily.filter("year >= 1999"), f"{folder}/bad", "algo")
    parsed = C.parse_daily(SD.scan_all(spark, folder, "*/*/*.csv"))
    return parsed.groupBy("fecha", "modo").agg(F.count("*").alias("n_rows"), F.sum("cantidad_usos").alias("total"))


@query
def combined_without_history(spark: SparkSession, sf: str) -> DataFrame:
    """Tables without the historical one: months and history reads still answer."""
    wh = T.Warehouse(spark, fresh_path(spark, "recent"), T.MODES3)
    wh.load(T.warehouse(spark, sf).daily.filter(F.col("year") >= T.CUT.year))
    return wh.combined_monthly().join(wh.historical_read().select("month_start", "modo", "era"), ["month_start", "modo"], "left")


def _as_source_mode() -> Column:
    names = {"1-URGENT": "colectivo", "2-HIGH": " Tren ", "3-MEDIUM": "SUBTE", "4-NOT SPECIFIED": "premetro", "5-LOW": "LANCHAS"}
    return P.map_values(F.col("o_orderpriority"), names)


@query
def hist_source_a(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices as a period/mode file: dotted counts, YYYYMM periods, three operation kinds."""
    path = fresh_path(spark, "source-a")
    kind = F.when(F.col("o_orderstatus") == "P", "Carga").when(F.col("o_orderstatus") == "O", "USO").otherwise("Uso con integracion")
    (T.read(spark, sf, "orders").select(
        F.date_format(F.col("o_orderdate").cast("date"), "yyyyMM").alias("Periodo"), _as_source_mode().alias("Modo"),
        kind.alias("Tipo de Operacion"), _grouped(F.floor("o_totalprice"), ".").alias("Suma de cantidad"))
     .write.option("header", True).option("sep", ";").csv(path))
    return H.read_source_a(spark, path)


@query
def hist_source_b(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "source-b")
    (T.read(spark, sf, "orders")
     .groupBy(F.date_format(F.col("o_orderdate").cast("date"), "MM/yyyy").alias("anio"), _as_source_mode().alias("MODO"))
     .agg(_grouped(F.sum(F.floor("o_totalprice")), ",").alias("TOTAL"))
     .write.option("header", True).option("sep", ";").csv(path))
    return H.read_source_b(spark, path)


# Change detection and streaming

@query
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    documents = T.read(spark, sf, "documents")
    current = documents.select(F.col("doc_id").alias("name"), F.md5("text").alias("content_hash"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    known = documents.filter(F.col("lang") != "fr").select(F.col("doc_id").alias("name"), F.md5(text).alias("content_hash"))
    gone = documents.filter(F.col("lang") == "es").select((-F.col("doc_id") - 1).alias("name"), F.md5("text").alias("content_hash"))
    return M.manifest_diff(current, known.unionByName(gone))


@query
def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two waves of extracts, overlapping in 1998, through the file stream."""
    daily = T.warehouse(spark, sf).daily
    raw, root = fresh_path(spark, "arriving"), fresh_path(spark, "tables")
    for wave, rows in enumerate((daily.filter("year <= 1998"), daily.filter("year >= 1998"))):
        (rows.select(
            F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "modo",
            F.col("cantidad_usos").cast("string").alias("cantidad_usos"), "nombre_empresa", "linea", "amba", "jurisdiccion",
            "provincia", "municipio", "dato_preliminar")
         .write.option("header", True).csv(f"{raw}/wave{wave}"))
        JR.stream_new_files(spark, f"{raw}/*", root, "*.csv").awaitTermination()
    return (JR.open_tables(spark, root).daily
            .groupBy(F.trunc("fecha", "MM").alias("month_start"), "modo")
            .agg(F.sum("cantidad_usos").alias("total_usos"), F.count("*").alias("n_rows")))


@query
def refresh_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two batch refreshes: the second sees a new file and misses one, whose keys another file of the same name also has."""
    daily = T.warehouse(spark, sf).daily
    raw, root = fresh_path(spark, "published"), fresh_path(spark, "tables")

    def put(wave: Column, rows: DataFrame) -> None:
        """A file for each wave from each task: a row of two waves is in two files of one name."""
        more = F.col("cantidad_usos") + F.when((F.col("wave") == "b") & (F.col("year") == 1996), 1000).otherwise(0)
        (rows.withColumn("wave", wave).select(
            "wave", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "modo", more.cast("string").alias("cantidad_usos"), "nombre_empresa", "linea")
         .write.mode("append").partitionBy("wave").option("header", True).csv(raw))

    year = F.col("year")
    waves = F.when(year < 1996, F.array(F.lit("a"))).when(year == 1996, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    put(F.explode(waves), daily.filter("year <= 1998"))
    JR.refresh(spark, raw, root, "wave={a,b}/*.csv")
    put(F.lit("c"), daily.filter("year >= 1999"))
    JR.refresh(spark, raw, root, "wave={b,c}/*.csv")
    return (JR.open_tables(spark, root).daily.groupBy(F.trunc("fecha", "MM").alias("month_start"), "modo")
            .agg(F.sum("cantidad_usos").alias("total_usos"), F.count("*").alias("n_rows")))


@query
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The events arrive in three waves of time; the stream goes on from where it was, in batches of two files."""
    events = T.read(spark, sf, "events")
    source, out = fresh_path(spark, "events"), fresh_path(spark, "stream")
    waves = F.ntile(3).over(W.Window.orderBy("day"))
    days = stage(events.groupBy(F.col("ts").cast("timestamp").cast("date").alias("day")).count().select("day", waves.alias("wave")), "days")
    dealt = stage(events.join(days, F.col("ts").cast("timestamp").cast("date") == F.col("day")).drop("day"), "waves", ["wave"])
    for wave in (1, 2, 3):
        dealt.filter(F.col("wave") == wave).drop("wave").repartition(3).write.mode("append").parquet(source)
        result = JD.run_daily_totals(spark, source, events.schema, out, max_files=2)
    return rounded(result, 2, "total")
