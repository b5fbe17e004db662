"""Hard negatives against scoring every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridemill.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, v int"
DIM = 6


def plain(rows, is_anchor, positives=5, negatives=3, scale=256.0):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or len(vector) != DIM or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(scale * float(np.float32(x))) for x in vector]
        kept[vec_id] = min(kept.get(vec_id, (label, v)), (label, v))
    out = []
    for a, (label, u) in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, other == label) for i, (other, v) in kept.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            window = [(n, i) for n, i, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, pid, rank, i, -p, -n) for rank, (n, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, **settings):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1) for i, v, label in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, is_anchor, **settings).collect())


def vectors(n, seed, noise):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((9, DIM))
    own = rng.integers(0, 9, n)
    return [(i, (centers[c] + noise * rng.standard_normal(DIM)).tolist(), int(rng.integers(0, 4))) for i, c in enumerate(own)]


@pytest.mark.parametrize("noise", [0.05, 0.7])
def test_same_as_scoring_every_pair(spark, monkeypatch, noise):
    monkeypatch.setattr(hard_negatives, "SEGMENT", 90 * DIM)
    monkeypatch.setattr(hard_negatives, "PART", 12)
    rows = vectors(700, 1, noise)
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == plain(rows, lambda i: i % 20 == 0)


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = vectors(150, 2, 0.3)
    rows += [(1000 + i, rows[10][1], i % 4) for i in range(200)]  # a large group of copies
    rows += [(2000, [0.0] * DIM, 1), (2001, [0.0] * DIM, 2), (2010, [1.0] * DIM, None), (None, [1.0] * DIM, 1), (2020, None, 1), (2030, [], 1)]
    rows += [(2040, [1.0, None] + [0.0] * 4, 1), (2050, [float("nan")] + [0.0] * 5, 1), (2060, [float("inf")] * DIM, 1), (2070, [1.0] * 5, 1)]
    rows += [(10, rows[10][1], 3), (10, rows[10][1], 3), (30, rows[31][1], 0)]  # repeated ids
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == plain(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-40, 40, DIM) * 2e4).tolist(), int(i % 3)) for i in range(60)]
    rows += [(100 + i, [x * 4 for x in v], label) for i, v, label in rows[:20]]
    assert mined(spark, rows, F.col("vec_id") % 5 == 0, positives=3, negatives=2) == plain(rows, lambda i: i % 5 == 0, 3, 2)


def test_empty_tables(spark):
    rows = vectors(20, 4, 0.3)
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") == 999).collect() == []


def test_members_end_their_walk(monkeypatch):
    """In clustered data, members read a small part of the list, and the rest cannot matter."""
    monkeypatch.setattr(hard_negatives, "STEP", 64)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 16)) * 60
    own = rng.integers(0, 20, 8000)
    v = (centers[own] + rng.standard_normal((8000, 16))).astype("<i2")
    shape = hard_negatives.Shape(16, "<i2", True, 8000, 40)
    segment = hard_negatives.Segment(np.arange(8000), rng.integers(0, 3, 8000), v, shape)
    members = np.flatnonzero(own == 0)[:40]
    taken = []
    monkeypatch.setattr(segment, "products", lambda m, c, f=segment.products: (taken.append(len(m) * len(c)), f(m, c))[1])
    best = hard_negatives.walk_positives(segment, members, segment.labels[members], v[members], 5)
    assert sum(taken) < 0.2 * 40 * 8000
    score = v.astype(int) @ v[members].astype(int).T
    for i, m in enumerate(members):
        order = [j for j in np.lexsort((np.arange(8000), -score[:, i])) if segment.labels[j] == segment.labels[m] and j != m][:5]
        assert best.id[i].tolist() == order
