"""Streaming daily totals over arriving rows, with state for the days that may still change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ridemill.plans.store import exists


def daily_totals(rows: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                 late: str = "1 day") -> DataFrame:
    """Count and sum per day and key. Works on a stream and on a batch alike."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return (timed.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), key)
            .agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
            .select(F.to_date("window.start").alias("ds"), key, "n_rows", "total"))


def start_daily_totals(spark: SparkSession, source: str, schema: T.StructType, out: str, max_files: int | None = None, **columns: str) -> StreamingQuery:
    """Take in the files that have arrived under ``source`` since the last call, in batches of ``max_files``.

    Update mode: a batch writes the days it touches, as they are after it, to a folder of its
    own, so a repeated batch writes the same again. State ends with the watermark: days that no
    row can change any more are dropped from it, and rows for them are dropped as late.
    Runs in its own session with UTC days.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    reader = session.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        daily_totals(reader.parquet(source), **columns).writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/_stream").trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}"))
        .start())


def read_daily_totals(spark: SparkSession, out: str, key: str = "event_type") -> DataFrame:
    """Of each day and key the values of the last batch that touched it."""
    columns = f"ds DATE, `{key}` STRING, n_rows BIGINT, total DOUBLE"
    if not exists(spark, f"{out}/result"):
        return spark.createDataFrame([], columns)
    last = F.max_by(F.struct("n_rows", "total"), "batch").alias("last")
    stored = spark.read.schema(f"{columns}, batch BIGINT").parquet(f"{out}/result")
    return stored.groupBy("ds", key).agg(last).select("ds", key, "last.n_rows", "last.total")


def run_daily_totals(spark: SparkSession, source: str, schema: T.StructType, out: str, max_files: int | None = None, **columns: str) -> DataFrame:
    """Drain the files under ``source`` through the stream and read the result back."""
    start_daily_totals(spark, source, schema, out, max_files, **columns).awaitTermination()
    return read_daily_totals(spark, out, columns.get("key", "event_type"))
