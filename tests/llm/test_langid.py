import numpy as np
import pyarrow as pa
import pytest

from ridemill.llm import langid

SYLLABLES = {"aa": "ba ka lo mi tu ra".split(), "bb": "sch ein ung keit ver".split(), "cc": "ción que los ña rro".split()}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(3, 60)))), lang)
            for i, lang in enumerate(rng.choice(list(SYLLABLES), n).tolist())]


def plain_set(text):
    folded, last = [], None
    for c in text.lower():
        symbol = c if c.isalpha() else " "
        if symbol != " " or last != " ":
            folded.append(symbol)
        last = symbol
    grams = {"".join(folded[i : i + k]) for k in (1, 2, 3) for i in range(len(folded) - k + 1)}
    return grams - {" "}


@pytest.mark.parametrize("text", ["Hello, wörld!!", "", "..", "ÀB c", "x" * 9])
def test_grams_are_the_presence_set(text):
    codes, rows, lettered = langid.grams(pa.array(["zz", text, None]))
    assert len(np.unique(codes[rows == 1])) == len(plain_set(text)) and lettered.tolist() == [True, any(map(str.isalpha, text)), False]


def test_scores_equal_the_kernel_machine():
    sample = [(lang, np.unique(langid.grams(pa.array([text]))[0])) for _, text, lang in texts(60, 1)]
    model = langid.fit(sample, landmarks=8, ridge=1e-2)
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    chosen = [g for lang in model.languages for g in [g for x, g in sample if x == lang][:8]]
    inside = [np.intersect1d(g, model.grams) for _, g in sample]  # the feature space is spanned by the landmarks' n-grams
    k_mm = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    k_nm = np.array([[kernel(a, b) for b in chosen] for a in inside])
    values, vectors = np.linalg.eigh(k_mm)
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    phi = k_nm @ root
    y = (np.array([x for x, _ in sample])[:, None] == np.array(model.languages)).astype(float)
    w = np.linalg.solve(phi.T @ phi + 1e-2 * len(sample) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    present = np.array([np.isin(model.grams, g) for g in inside]).astype(float)
    assert np.allclose(present @ model.weights / np.sqrt(present.sum(1, keepdims=True)), phi @ w, atol=2e-3)


def test_held_out_accuracy_and_cases(spark):
    rows = [(i, t, lang, "x") for i, t, lang in texts(600, 2)] + [(900, None, "aa", "x"), (901, "12 -- !!", "bb", None), (None, "ba ka lo", None, "x"), (902, "", "aa", "x"), (902, "", "aa", "x"), (903, "ba ka lo " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").withColumn("held", langid.held_out())
    model = langid.train(docs.where("NOT held"), per_language=60, landmarks=20)
    out = langid.predict(docs, model, keys=("doc_id", "lang", "held")).collect()
    assert len(out) == len(rows)
    judged = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 600]
    assert len(judged) > 80 and np.mean([r.lang == r.lang_pred for r in judged]) > 0.97
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out if r.doc_id in (None, 903)} == {"aa"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [] and {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.train(docs.limit(0)).languages == []
