"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes all rows that the one before kept. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemill.llm import catalog, decontaminate, langid, packing, secret_scan, simhash
from ridemill.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[SECRET]"
BATCH_ROWS = 1000  # texts that go to a worker at once: some MB of them


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts are rows here: Spark's own batches of 10,000 rows would take a large part of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: null texts and texts without a letter.

    The model learns from the rows that op2 may learn from. A null or wrong ``lang`` stays as
    it is: a document is judged by its text alone.
    """
    bounded_batches(spark)
    model = langid.train(docs.where(~langid.held_out()))
    if not model.languages:  # nothing to learn from: only the lack of letters can be told
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.select(*COLUMNS), model, keys=tuple(COLUMNS))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    bounded_batches(spark)
    return simhash.keep_one(docs.select(*COLUMNS), shingle=3, seed=42)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, at similarity 0.8 or more, go."""
    bounded_batches(spark)
    return decontaminate.clean(docs.select(*COLUMNS), catalog.read(spark, sf_dir, "benchmark"), similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and n_chars follows a changed text."""
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    cleaned = secret_scan.redact(docs.select(*COLUMNS, F.length("text").alias("__before")), model, mark=MARK)
    changed = F.coalesce(F.length("text") != F.col("__before"), F.lit(False))
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences of 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, catalog.TOKENIZER, capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # trained models, fingerprints, alignments and a tokenizer are not SQL; tests hold it against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
