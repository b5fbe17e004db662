"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. ``build`` is the whole load: join, clean, flag, de-duplicate, store, roll up. The
other queries run over the stored tables unless they start from raw tables or files, and
are materialised into a no-op sink. Each is the better of two runs after the build.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridemill.operators import loess as L  # noqa: E402
from ridemill.operators import regression as X  # noqa: E402
from ridemill.operators import rollups as R  # noqa: E402
from ridemill.operators import series as Z  # noqa: E402
from ridemill.plans import catalog  # noqa: E402
from ridemill.plans import testdata as T  # noqa: E402
from ridemill.session import get_session  # noqa: E402

HEADLINE = [
    "monthly_rollup", "monthly_by_province", "operator_totals", "daily_by_mode", "weekday_heatmap", "kpis", "yoy", "modal_split",
    "amba_recovery", "rolling_stats", "gap_fill", "label_holidays", "asof_cumsum", "series_gaps", "decompose", "anomalies",
    "decompose_loess", "its_fit", "its_hac", "forecast", "ljung_box", "dedup_first", "flag_outliers", "parse_dates",
    "parse_quantity", "scan_all", "stream_daily", "incremental_refresh",
]


def _operator_series(wh):
    """One daily series per mode and operator instead of one per mode."""
    rows = R.trusted(wh.daily).groupBy(T.F.concat_ws("|", "modo", "nombre_empresa").alias("series"), T.F.col("fecha").alias("ds"))
    return Z.gap_fill(rows.agg(T.F.sum("cantidad_usos").alias("y")))


def _operator_months(wh):
    rows = R.trusted(wh.daily).groupBy(T.F.concat_ws("|", "modo", "nombre_empresa").alias("series"), T.F.trunc("fecha", "MM").alias("ds"))
    return X.enough_after(X.its_features(rows.agg(T.F.sum("cantidad_usos").alias("y")), T.TREATMENT, T.SPECIAL))


EXTRA = {
    "decompose_by_operator": lambda spark, sf: Z.decompose(_operator_series(T.warehouse(spark, sf))),
    "its_fit_by_operator": lambda spark, sf: X.its_fit(_operator_months(T.warehouse(spark, sf))),
    "loess_by_province": lambda spark, sf: L.decompose_loess(Z.gap_fill(
        R.trusted(T.warehouse(spark, sf).daily).groupBy(T.F.col("provincia").alias("series"), T.F.col("fecha").alias("ds"))
        .agg(T.F.sum("cantidad_usos").alias("y")))),
}


def timed(fn) -> float:
    started = time.perf_counter()
    df = fn()
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:]
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false",
    }
    if "SPARK_CHECKPOINT_DIR" not in os.environ:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="run-")
    spark = get_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not measured
    times = {"build": timed(lambda: T.warehouse(spark, sf) and None)}
    runs = {**{name: catalog.QUERIES[name] for name in HEADLINE}, **EXTRA}
    for name, fn in runs.items():
        if not wanted or name in wanted:
            times[name] = min(timed(lambda: fn(spark, sf)) for _ in range(2))
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
