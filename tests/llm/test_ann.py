import numpy as np
import pytest
from pyspark.sql import functions as F

from ridemill.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, list int, score string"


def vectors(n, dim, seed, clusters=12):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dim))
    return (centers[rng.integers(0, clusters, n)] + 0.6 * rng.standard_normal((n, dim))).astype(np.float32)


def truth(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    out = {}
    for i in ids[ids % 20 == 0]:
        score = (x * good[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], SCHEMA)
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 100)
    monkeypatch.setattr(ann, "SAMPLE", 600)
    rows = list(enumerate(vectors(3000, 16, 0)))
    found, expected = run(spark, rows), truth(rows, 20)
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in found]) >= 0.9
    exact = {i: v.astype(float) for i, v in rows}
    assert all(abs(s - float((exact[q] * exact[i]).sum())) < 1e-9 for q in found for i, s in found[q])


def test_ties_bad_vectors_and_repeats(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(16).round(3)
    rows = [(i, same) for i in range(0, 90)]  # ties go to the smaller id
    rows += [(i, rng.standard_normal(16)) for i in range(100, 120)]
    rows += [(200, None), (220, [0.0] * 16), (240, [*same[:15], None]), (260, [*same[:15], float("nan")]), (280, [*same[:15], float("inf")]), (300, list(same[:5])), (None, same), (0, same), (40, same)]
    found, expected = run(spark, rows), truth(rows, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_more_vectors_than_any_fitting_sample_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1024)
    rows = list(enumerate(np.random.default_rng(5).standard_normal((9000, 16)).astype(np.float32)))  # without clusters
    found, expected = run(spark, rows), truth(rows, 20)
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in found]) >= 0.9


def test_the_probed_share_of_clustered_vectors_falls_as_they_grow(spark):
    shares = []
    for n in (1000, 16000):
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors(n, 16, 4, clusters=40))], "vec_id bigint, v array<double>")
        index = ann.fit(df)
        assert abs(len(index.centroids) - n**0.5) < 1
        shares.append(ann.calibrate(ann.assign(df, index), index, 20) / len(index.centroids))
    assert shares[1] < shares[0] / 2


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = list(enumerate(vectors(n, 16, 2)))
    assert {q: [i for i, _ in v] for q, v in run(spark, rows).items()} == {q: [i for i, _ in v] for q, v in truth(rows, 20).items() if v}


def test_abandoning_keeps_what_is_within_the_bound():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 33))
    rotation = np.linalg.qr(rng.standard_normal((34, 34)))[0]
    index = ann.Index(33, rotation, np.zeros((1, 34)), float((x * x).sum(1).max()), np.zeros(0, np.int64), np.zeros((0, 33)))
    queries = rng.standard_normal((40, 33))
    score = queries @ x.T
    kth = np.sort(score, 1)[:, -10]
    bounds = (queries * queries).sum(1) + index.norm2 - 2 * kth
    who, ids, _ = ann.scan_block(index, np.arange(2000), x, np.arange(5000, 5040), queries, bounds, 10)
    true = np.argsort(-score, 1)[:, :10]
    assert np.mean([len(set(true[q]) & set(ids[who == 5000 + q])) / 10 for q in range(40)]) > 0.97
