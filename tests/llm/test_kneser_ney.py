import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridemill.llm import kneser_ney as K

TRAIN = ["the cat sat on the mat.", "the dog sat on the log", "a cat and a dog", "", "ñandú élan the", "the the the cat"] * 2 + ["one more line of text"]


def plain(train):
    """Interpolated modified Kneser-Ney by dictionaries; a character is its own sign."""
    pad = ["<s>"] * (K.ORDER - 1)
    high = Counter(tuple([*pad, *t, "</s>"][i : i + K.ORDER]) for t in train for i in range(len(t) + 1))
    tables = {K.ORDER: high}
    for k in range(K.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cut, context = {}, {}
    for k, table in tables.items():
        n = [sum(c == j for c in table.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        cut[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else j / 2, 0.1 * j), 0.95 * j) for j in (1, 2, 3)]
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][1] += cut[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        below = 1 / (len(tables[1]) + 1) if k == 1 else p(gram[1:])
        if gram[:-1] not in context[k]:
            return below
        total, left = context[k][gram[:-1]]
        c = tables[k].get(gram, 0)
        return (c - cut[k][min(c, 3) - 1] if c else 0) / total + left / total * below

    def perplexity(text):
        signs = [*pad, *(text or ""), "</s>"]
        logs = [math.log(p(tuple(signs[i : i + K.ORDER]))) for i in range(len(text or "") + 1)]
        return math.exp(-sum(logs) / len(logs))

    return perplexity, p, [g[0] for g in tables[1]]


@pytest.mark.parametrize("shard,block", [(65_536, 8 << 20), (20, 60)])
def test_perplexities_against_plain_version(spark, monkeypatch, shard, block):
    monkeypatch.setattr(K, "SHARD", shard)
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "SLICE", min(block, 40))
    model, unseen = K.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    texts = ["the cat", "dog on the", "", None, "zzz qqq", "é 🙂", "the cat", "the log and a mat. " * 50, TRAIN[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the cat", 2), (0, "the cat", 1)], "doc_id bigint, text string, key int").repartition(2)
    found = K.perplexities(docs, model, unseen).collect()
    own, _, _ = plain(TRAIN)
    assert len(found) == len(texts) + 2
    for r in found:
        assert r.perplexity == pytest.approx(own("the cat" if r.doc_id is None else texts[r.doc_id]), rel=1e-5)
    assert K.perplexities(docs.limit(0), model, unseen).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over the known signs and one unknown one, after known and unknown contexts, by the model's own answers."""
    _, p, signs = plain(TRAIN)
    model, unseen = K.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    signs = [s for s in signs if s != "</s>"]
    contexts = ["the ", " cat", "zq t", "xxxx"]
    texts = sorted({c + s for c in contexts for s in [*signs, "~", ""]})
    rows = K.perplexities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), model, unseen).collect()
    log = {texts[r.doc_id]: -math.log(r.perplexity) * (len(texts[r.doc_id]) + 1) for r in rows}  # of the text and its end
    for c in contexts:
        end = math.exp(log[c] - sum(math.log(p(tuple((["<s>"] * (K.ORDER - 1) + list(c))[i : i + K.ORDER]))) for i in range(len(c))))
        after = [math.exp(log[c + s] - log[c] + math.log(end)) / p((*(c + s)[-(K.ORDER - 1) :], "</s>")) for s in [*signs, "~"]]
        assert sum(after) + end == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("n, share", [(200, 0.95), (2000, 0.97)])  # some 15 and 150 held-out texts a language
def test_quality(spark, n, share):
    rng = np.random.default_rng(0)
    prose = lambda: " ".join(rng.choice("the of cat dog sat mat and with lime".split(), 40))
    junk = lambda: "".join(rng.choice(list("!%&$#*0123456789|"), 200))
    rows = [(i, prose() if i % 5 else junk(), "aa" if i % 2 else "bb") for i in range(n)] + [(n + 100, prose(), None), (None, prose(), "aa"), (n + 101, None, "cc"), (n + 102, prose(), "aa"), (n + 102, prose(), "aa")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, threshold int")
    trusted = spark.createDataFrame([(i,) for i in range(n * 3 // 4) if i % 5] + [(None,)], "doc_id bigint")
    out = K.quality(docs, trusted).collect()
    assert len(out) == len(rows)
    assert not any(r.keep for r in out if r.doc_id is not None and r.doc_id < n and r.doc_id % 5 == 0)
    clean = [r.keep for r in out if r.doc_id is None or r.doc_id in (n + 100, n + 102) or (r.doc_id < n and r.doc_id % 5)]
    assert np.mean(clean) > share
    nothing = K.quality(docs, trusted.limit(0)).collect()
    assert all(r.keep and r.perplexity is None and r.threshold is None for r in nothing) and len(nothing) == len(rows)
    assert K.quality(docs.limit(0), trusted).count() == 0
