"""Ranked lexical search against a plain scorer over every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ridemill.llm import lexical


def plain(docs, items, k):
    def terms(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())

    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(t.encode(), texts.get(i, t.encode()))
    out = []
    for i, t in texts.items():
        ranked = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(t.decode()) if x in c)
            if score > 0:
                ranked.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Été", "ÀB", "naïve", "語", "it's", "a-b", "X9", " x"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(60)]  # copies: equal scores
    docs += [(3, docs[3][1]), (None, docs[7][1]), (None, None), (n + 100, None), (n + 101, ""), (n + 102, "... -- ...")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(12)]
    items += [(2, "w1 w1 w2"), (50, None), (51, ""), (52, "notheld"), (None, docs[5][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "k"), [(1, 20), (2, 3), (3, 1)])
def test_same_as_scoring_every_document(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical, "TREE_DOCS", 64)
    docs, items = corpus(seed, 300)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(d, i, k=k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted([tuple(r) for r in found], key=str) == plain(docs, items, k)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(4, 80)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted([tuple(r) for r in lexical.search(d, i, k=5).collect()], key=str) == plain(docs, items, 5)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 7)
    items = lexical.item_block([(1, "alpha beta é x")])
    import pyarrow as pa

    text = "Alpha, beta alphabeta é" + "z" * 40 + " ALPHA é x x x"
    n, row, term, count = lexical.term_counts(pa.array([text]), items.vocabulary)
    names = [items.vocabulary[t].as_py().decode() for t in term.tolist()]
    assert (n.tolist(), dict(zip(names, count.tolist()))) == ([9], {"alpha": 2, "beta": 1, "é": 1, "x": 3})


def test_subtrees_are_left_out(spark, monkeypatch):
    """A bound below the k-th score ends a subtree: a common term's many documents are not all scored."""
    rng = np.random.default_rng(5)
    rank = [np.unique(rng.integers(0, 40, 12)) for _ in range(3000)]
    rank[:30] = [np.arange(40)] * 30
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rank])])
    flat = np.concatenate(rank)
    tree = lexical.Tree(np.arange(3000), np.zeros(3000, bool), np.full(3000, 100), bounds, flat, np.ones(len(flat), np.int64))
    items = lexical.item_block([(1, " ".join(f"t{i}" for i in range(40)))])
    search = lexical.Search(items, np.arange(40), np.full(40, 10), 20)
    scored = []
    monkeypatch.setattr(search, "_leaf", lambda t, a, b, alive, f=search._leaf: (scored.append(b - a), f(t, a, b, alive)))
    search.run(tree)
    assert search.found.doc_id[0].tolist() == list(range(20)) and sum(scored) < 300


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, n bigint, terms string, rank int, score double, item_id string"
    d = spark.createDataFrame([(1, "alpha beta", 3, "x", 1, 0.5, "q")], schema)
    i = spark.createDataFrame([(9, "ALPHA", "z")], "item_id bigint, text string, doc_id string")
    assert [tuple(r)[:3] for r in lexical.search(d, i).collect()] == [(9, 1, 1)]
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []
