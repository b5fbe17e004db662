"""Run every registered query beside its SQL and compare rows, types and values.

Usage: python tests/check_oracles.py [data folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ridemill.session import get_session  # noqa: E402

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences between the Spark result and the SQL result; empty when equal."""
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return [f"columns {names} / {sorted(result.columns)}"]
    problems = []
    theirs = dict(zip(result.columns, [str(t) for t in result.types]))
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != theirs[name]:
            problems.append(f"type of {name}: {kind} / {theirs[name]}")
    left = sorted([tuple(r[n] for n in names) for r in df.collect()], key=_key)
    place = [result.columns.index(n) for n in names]
    right = sorted([tuple(r[i] for i in place) for r in result.fetchall()], key=_key)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0][0]} / {bad[0][1]}")
    return problems


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": work})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problems = compare(df, con, sqls[name])
                note = "ok" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"no SQL, {df.count()} rows"
        except Exception as error:
            problems, note = ["error"], f"ERROR {str(error)[:1500]}"
        if problems:
            failed.append(name)
        print(f"{name:24s} {time.time() - started:6.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
