import random

import numpy as np
import pytest

from ridemill.llm import decontaminate as D


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(map(max, h))


def words(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()


def brute(docs, items, similarity=0.8):
    out = {}
    for d, t in docs:
        for i, q in items:
            a, b = words(q), words(t)
            if d is None or i is None or t is None or q is None or len(a) < 3:
                continue
            alike = 1 - (2 * len(a) - plain_score(a, b)) / (3 * len(a))
            if alike >= similarity - 1e-9:
                out[d, i] = max(alike, out.get((d, i), 0))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "is"] * 6 + [f"word{i}" for i in range(60)] + ["élan", "ñu"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.choice([3, 8, 20, 45]))) for i in range(25)]
    docs = []
    for d in range(160):
        text = prose(rng.choice([0, 5, 80, 300]))
        if d % 2:
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(copy) // 4))):
                spot = rng.randrange(len(copy))
                edit = rng.choice(["swap", "drop", "add"])
                copy[spot : spot + (edit != "add")] = [] if edit == "drop" else [rng.choice(vocabulary)]
                copy = copy or ["the"]
            at = rng.randint(0, len(text))
            text = text[:at] + copy + text[at:]
        docs.append((d, "!! ".join(w.upper() if d % 3 == 0 else w for w in text)))
    items = [(i, ", ".join(q)) for i, q in items] + [(90, None), (91, ""), (92, "one two"), (None, "the of and is the of"), (0, ", ".join(items[0][1]))]
    docs += [(None, docs[1][1]), (500, None), (501, ""), docs[3], docs[3], (502, " ".join([docs[5][1]] * 40))]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, similarity int")
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    found = D.leaks(df, benchmark).collect()
    expected = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(found) == len(expected) > 50
    texts = dict(docs)
    for r in found:
        a, b = words(dict(items)[r.item_id]), words(texts[r.doc_id])[r.first_word : r.last_word + 1]
        assert abs(1 - (2 * len(a) - plain_score(a, b)) / (3 * len(a)) - r.similarity) < 1e-9
    kept = D.clean(df, benchmark)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {k[0] for k in expected})
    assert D.leaks(df.limit(0), benchmark).collect() == [] and D.leaks(df, benchmark.limit(0)).collect() == []


def test_short_items_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample("abcdefgh", n))) for i, n in enumerate([3, 4, 4, 4, 5, 5, 5, 6, 7] * 3)]
    docs = [(0, "a b X d e"), (1, "a b X c d")]
    for d in range(2, 300):
        copy = rng.choice(items)[1].split()
        copy.insert(rng.randrange(len(copy) + 1), "x") if d % 2 else copy.__setitem__(rng.randrange(len(copy)), "y")
        docs.append((d, " ".join(["z"] * rng.randrange(9) + copy + ["w", "z"])))
    items += [(100, "a b c d e"), (101, "a b c d")]
    found = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    expected = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}
    assert (0, 100) in expected and (1, 101) in expected


@pytest.mark.parametrize("similarity", [0.6, 0.45])
def test_low_similarities(spark, similarity):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for i, n in enumerate([3, 4, 6, 9, 12])]
    docs = [(d, " ".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(30))) for d in range(60)]
    found = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), similarity).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in brute(docs, items, similarity).items()}


def test_other_spaces_marks_and_scripts(spark):
    item = "the quick brown fox jumps over it"
    docs = [(0, item.replace(" ", "\u00a0")), (1, "\u201cthe quick\u201d brown \u2014 fox\u2014jumps\u3000over\u2026it\u00bb"), (2, "so: 我们今天去公园散步吧。再见"), (3, "the quick brown"), (4, "ไป " + "สวัสดีครับ" + "นะ")]
    found = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item), (8, "我们今天去公园散步"), (9, "สวัสดีครับ")], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(0, 7, 1.0), (1, 7, 1.0), (2, 8, 1.0), (4, 9, 1.0)}


def test_alignment_in_batches():
    rng = np.random.default_rng(0)
    left = [rng.integers(2, 9, rng.integers(3, 20)).astype(np.uint64) for _ in range(60)]
    right = [rng.integers(2, 9, rng.integers(0, 30)).astype(np.uint64) for _ in range(60)]
    best, _ = D.align(left, right)
    assert best.tolist() == [plain_score(a.tolist(), b.tolist()) for a, b in zip(left, right)]
