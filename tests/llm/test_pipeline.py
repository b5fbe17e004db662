"""The pipeline against plain versions of its stages, on the smallest tables with awkward rows added."""

import hashlib
import re

import pytest
from test_decontaminate import brute as leak_pairs
from test_simhash import brute as components
from test_token_files import crc, ids

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(9000, None, "en", "s", 0), (9001, "12 34 !!", "en", "s", 8), (9002, "", None, None, None), (9003, f"Before it {item.text} and after it", None, "s", 5),
            (9004, f'the secret here is token = "{key}" indeed', "en", None, 1), (9005, "a copy of words to see twice", "en", "s", 1), (9005, "a copy of words to see twice", "en", "s", 1),
            (9006, "A copy of words to see twice", "xx", "s", 1), (None, "a text that has no number at all", None, None, None)]
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    more.withColumn("__extra", corpus_pipeline.F.lit("x")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def key(r):
    return tuple(str(x) for x in r)


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [tuple(r)[:5] for r in docs.collect()]
    by_name = dict(corpus_pipeline.STAGES)

    def stage(name):
        out = by_name[name](spark, docs, tables)
        path = f"{tables}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    docs = stage("language_id")
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(map(key, docs.collect())) == sorted(map(key, rows)) and docs.columns == corpus_pipeline.COLUMNS

    docs = stage("near_dedup")
    least = {(i, p): c for (known, i), p, c in components([(r[0], r[1]) for r in rows]) if known}
    named = {i for (i, _), c in least.items() if i == c}
    rows = sorted({r for r in rows if r[0] in named or r[0] is None}, key=key)
    assert sorted(map(key, docs.collect())) == sorted(map(key, rows))

    docs = stage("benchmark_decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    suspects = [r for r in rows if any(" ".join(t.lower().split()[2:5]) in r[1].lower() for _, t in items)]
    bad = {d for d, _ in leak_pairs([(r[0], r[1]) for r in suspects], items)}
    assert 9003 in bad
    rows = [r for r in rows if r[0] not in bad]
    assert sorted(map(key, docs.collect())) == sorted(map(key, rows))

    docs = stage("secret_scans")
    secret = re.compile('(?<=token = ")[0-9a-f]{40}(?=")|(?<=TOKEN = ")[0-9A-F]{40}(?=")')
    rows = [(r[0], t := secret.sub(corpus_pipeline.MARK, r[1]), r[2], r[3], len(t) if t != r[1] else r[4]) for r in rows]
    assert sorted(map(key, docs.collect())) == sorted(map(key, rows))
    assert any(corpus_pipeline.MARK in r[1] for r in rows)

    pieces = stage("best_fit_packing").collect()
    assert sum(p.length for p in pieces) == sum(len(ids(r[1])) + 1 for r in rows)
    expected = {r[0]: crc([*ids(r[1]), 2]) for r in rows if len(ids(r[1])) < 1024}
    assert {p.doc_id: p.ids_crc32 for p in pieces if p.doc_id in expected} == expected
    total = len({p.sequence_id for p in pieces})
    assert total <= 1.02 * -(-sum(p.length for p in pieces) // 1024) + 1


def test_run_is_the_registered_query(spark, tables):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_tables(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
